"""The line-oriented JSON layouts for site tables and spectra.

Each configuration and each site (or block count) sits on a line of its own, so a file splits into tasks at any line. Line
order gives the configuration ids; it is restored from (file, split start, row) by a range-partitioned ranking. Files are
written as a folder of parts whose concatenation in name order is the JSON document.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.operators.ordering import with_global_index
from freqloom.operators.sites import SiteTable, accounting
from freqloom.operators.spectrum import Spectrum, length_row
from freqloom.session import cut_lineage

PLACE = ["file", "split", "row"]
# Configurations of up to this many bytes are broadcast; more of them are joined as adaptive execution decides.
CONFIG_BYTES = 32 << 20
SITE_KEYS = ("populations", "non_ascertained_pops", "use_folded_sfs", "length", "n_read_snps", "n_excluded_snps")
SPECTRUM_KEYS = ("sampled_pops", "folded", "length")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value",
        # Part numbers may outgrow their leading zeros: longer names come later.
        F.expr("concat(lpad(length(_metadata.file_path), 6, '0'), _metadata.file_path)").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


NUMBER = r"-?[0-9.]+([eE][-+]?[0-9]+)?"
#: What a line may be; only a line that is one of these by itself can be placed.
KINDS = {
    "config": r"^\s*\[\s*\[[0-9,\s\[\]]*\]\s*\]\s*,?\s*$",
    "row": rf'^\s*\[\s*("[^"]*"|{NUMBER})\s*,\s*({NUMBER}|null)\s*,\s*{NUMBER}\s*\]\s*,?\s*$',
    "header": r'^\s*"[a-z_]+"\s*:\s*[^\[{]*$|^\s*"[a-z_]+"\s*:\s*\[[^\[\]]*\]\s*,?\s*$',
    "frame": r'^\s*$|^\s*[{}\]]+\s*,?\s*$|^\s*"(configs|\([a-z_,]+\))"\s*:\s*\[\s*$',
}


def checked(lines: DataFrame) -> DataFrame:
    """Lines with their ``kind``; a line that can't be placed stops the job, so nothing is left out unseen."""
    kind = F.raise_error(F.concat(F.lit("not one entry of the line layout: "), F.substring("value", 1, 120))).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    return lines.withColumn("kind", kind)


def _about(lines: DataFrame) -> DataFrame:
    """The header and configuration lines, fixed: the one pass over all lines that both need."""
    return cut_lineage(lines.where("kind in ('header', 'config')"))


def _header(lines: DataFrame, keys: tuple[str, ...], needed: str) -> dict:
    """The few scalar entries at the top, as Python values."""
    rows = lines.where("kind = 'header'").select("value").collect()
    found = json.loads("{" + ",".join(row.value.strip().rstrip(",") for row in rows) + "}")
    if needed not in found:
        raise ValueError(f"no line with {needed!r}: a document that is not laid out in lines needs the compact loader")
    return {k: v for k, v in found.items() if k in keys}


def _small(configs: DataFrame, n: int, n_pops: int) -> DataFrame:
    """``n`` configurations marked for broadcast where their size allows it, so that the rows joined stay where they are."""
    return F.broadcast(configs) if n * (64 + 8 * n_pops) <= CONFIG_BYTES else configs


def _configs(lines: DataFrame, n_pops: int) -> DataFrame:
    """``(config_id, anc, der)`` by order of the configuration lines."""
    found = lines.where("kind = 'config'")
    n = found.count()
    ranked = with_global_index(found, PLACE, ["value"], n)
    parsed = ranked.selectExpr(
        "row_index as config_id", "from_json(trim(trailing ',' from trim(value)), 'array<array<int>>') as pairs"
    )
    return _small(parsed.selectExpr("config_id", "transform(pairs, p -> p[0]) as anc", "transform(pairs, p -> p[1]) as der"), n, n_pops)


def load_sites(spark: SparkSession, path: str) -> SiteTable:
    """Site table from the line layout; rows are not sorted again."""
    return sites_from_lines(spark, _lines(spark, path))


def sites_from_lines(spark: SparkSession, lines: DataFrame) -> SiteTable:
    """The same from ``lines(value, file, split, row)``; a line that can't be placed is an error."""
    lines = checked(lines)
    about = _about(lines)
    info = _header(about, SITE_KEYS, "populations")
    rows = lines.where("kind = 'row'").selectExpr(
        "from_json(trim(trailing ',' from trim(value)), 'array<string>') as t"
    ).selectExpr("t[0] as chrom_id", "try_cast(t[1] as double) as position", "try_cast(t[2] as bigint) as config_id")
    df = rows.join(_configs(about, len(info["populations"])), "config_id").select("chrom_id", "position", "anc", "der")
    return _site_table(spark, df, info)


def load_sites_compact(spark: SparkSession, path: str) -> SiteTable:
    """Site table from a JSON document in any layout; the document is parsed as one record."""
    schema = (
        "populations array<string>, non_ascertained_pops array<string>, use_folded_sfs boolean, length double,"
        " n_read_snps bigint, n_excluded_snps bigint, configs array<array<array<int>>>,"
        " `(chrom_id,position,config_id)` array<array<string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    info = doc.select(*SITE_KEYS).first().asDict()
    df = doc.selectExpr("configs", "explode(`(chrom_id,position,config_id)`) as t").selectExpr(
        "t[0] as chrom_id", "double(t[1]) as position", "configs[int(t[2])] as pairs"
    ).selectExpr("chrom_id", "position", "transform(pairs, p -> p[0]) as anc", "transform(pairs, p -> p[1]) as der")
    return _site_table(spark, df, {k: v for k, v in info.items() if v is not None})


def _site_table(spark: SparkSession, df: DataFrame, info: dict) -> SiteTable:
    if info.get("n_read_snps") is None:
        book = df.agg(
            F.lit(info.get("length")).cast("double").alias("length"), F.count(F.lit(1)).alias("n_read"),
            F.lit(info.get("n_excluded_snps", 0)).cast("bigint").alias("n_excluded"),
        )
    else:
        book = accounting(spark, info.get("length"), info["n_read_snps"], info.get("n_excluded_snps", 0))
    return SiteTable(
        df, tuple(map(str, info["populations"])), book, tuple(map(str, info.get("non_ascertained_pops") or ())),
        bool(info.get("use_folded_sfs", False)),
    )


def load_spectrum(spark: SparkSession, path: str) -> Spectrum:
    """Spectrum from the line layout; a configuration listed twice in a block keeps its last count."""
    return spectrum_from_lines(spark, _lines(spark, path))


def spectrum_from_lines(spark: SparkSession, lines: DataFrame) -> Spectrum:
    """The same from ``lines(value, file, split, row)``; a line that can't be placed is an error."""
    lines = checked(lines)
    about = _about(lines)
    info = _header(about, SPECTRUM_KEYS, "sampled_pops")
    triples = lines.where("kind = 'row'").selectExpr(
        "from_json(trim(trailing ',' from trim(value)), 'array<double>') as t", "struct(file, split, row) as place"
    ).selectExpr("bigint(t[0]) as block", "bigint(t[1]) as config_id", "t[2] as cnt", "place")
    return _spectrum(spark, triples, _configs(about, len(info["sampled_pops"])), info)


def load_spectrum_compact(spark: SparkSession, path: str) -> Spectrum:
    """Spectrum from a JSON document in any layout; the document is parsed as one record."""
    schema = (
        "sampled_pops array<string>, folded boolean, length double, configs array<array<array<int>>>,"
        " `(locus,config_id,count)` array<array<double>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    info = doc.select(*SPECTRUM_KEYS).first().asDict()
    triples = doc.selectExpr("posexplode(`(locus,config_id,count)`) as (place, t)").selectExpr(
        "bigint(t[0]) as block", "bigint(t[1]) as config_id", "t[2] as cnt", "place"
    )
    configs = doc.selectExpr("posexplode(configs) as (config_id, pairs)").selectExpr(
        "bigint(config_id) as config_id", "transform(pairs, p -> p[0]) as anc", "transform(pairs, p -> p[1]) as der"
    )
    return _spectrum(spark, triples, configs, info)


def _spectrum(spark: SparkSession, triples: DataFrame, configs: DataFrame, info: dict) -> Spectrum:
    last = triples.groupBy("block", "config_id").agg(F.max_by("cnt", "place").alias("cnt"))
    df = last.join(configs, "config_id").select("block", "anc", "der", "cnt")
    return Spectrum(
        df, tuple(map(str, info["sampled_pops"])), length_row(spark, info.get("length")), (), bool(info.get("folded"))
    )


CONFIG_LINE = "concat('[', array_join(zip_with(anc, der, (a, d) -> concat('[', a, ', ', d, ']')), ', '), ']')"


def _section(ranked: DataFrame, text: str) -> DataFrame:
    """Lines of one list, every one but the last with a comma; ranked rows lie in order."""
    return ranked.selectExpr(f"concat('\\t\\t', {text}, if(row_index = row_total - 1, '', ',')) as value")


def _fixed(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1)


def _document(head: list[str], configs: DataFrame, middle: str, rows: DataFrame, row_text: str) -> DataFrame:
    """The sections one after the other. A ranking leaves its rows in sorted partitions, and a union its inputs' partitions
    in their order, so no row is ordered a second time; what is global is one offset per partition."""
    spark = configs.sparkSession
    parts = [
        _fixed(spark, ["{", *head, '\t"configs": [']),
        _section(configs, CONFIG_LINE),
        _fixed(spark, ["\t],", f'\t"{middle}": [']),
        _section(rows, row_text),
        _fixed(spark, ["\t]", "}"]),
    ]
    return reduce(DataFrame.unionAll, parts)


def _dictionary(rows: DataFrame, n_pops: int) -> tuple[DataFrame, DataFrame, int]:
    """The configurations of ``rows`` numbered by similarity, ``rows`` with their ``config_id``, and how many rows there are."""
    shown = rows.groupBy("anc", "der").agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = with_global_index(
        shown, [F.expr("zip_with(anc, der, (a, d) -> a + d)"), F.least("anc", "der"), "anc"], ["anc", "der", "n_rows"]
    )
    dictionary = ranked.selectExpr("row_index as config_id", "row_index", "row_total", "anc", "der")
    size = ranked.agg(F.count(F.lit(1)).alias("configs"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    placed = rows.join(_small(dictionary.select("anc", "der", "config_id"), size.configs, n_pops), ["anc", "der"])
    return dictionary, placed, size.rows


def _entry(key: str, value) -> str:
    return f'\t"{key}": {json.dumps(value)},'


def site_lines(table: SiteTable) -> DataFrame:
    """The JSON document of a site table, one line per row, in order."""
    book = table.book.first()
    head = [_entry("populations", list(table.pops))]
    if table.non_ascertained:
        head.append(_entry("non_ascertained_pops", list(table.non_ascertained)))
    head += [
        _entry("use_folded_sfs", table.folded), _entry("length", book.length),
        _entry("n_read_snps", book.n_read), _entry("n_excluded_snps", book.n_excluded),
    ]
    dictionary, placed, n = _dictionary(table.df, len(table.pops))
    rows = with_global_index(placed, ["chrom_id", "position", "config_id"], ["chrom_id", "position", "config_id"], n)
    text = "concat('[\"', chrom_id, '\", ', position, ', ', config_id, ']')"
    return _document(head, dictionary, "(chrom_id,position,config_id)", rows, text)


def spectrum_lines(spectrum: Spectrum) -> DataFrame:
    """The JSON document of a spectrum, one line per row, in order."""
    length = spectrum.meta.first().length
    head = [_entry("sampled_pops", list(spectrum.pops)), _entry("folded", spectrum.folded), _entry("length", length)]
    dictionary, placed, n = _dictionary(spectrum.df, len(spectrum.pops))
    rows = with_global_index(placed, ["block", "config_id"], ["block", "config_id", "cnt"], n)
    return _document(head, dictionary, "(locus,config_id,count)", rows, "concat('[', block, ', ', config_id, ', ', cnt, ']')")


def dump_sites(table: SiteTable, path: str, compression: str = "none") -> None:
    site_lines(table).write.mode("overwrite").option("compression", compression).text(path)


def dump_spectrum(spectrum: Spectrum, path: str, compression: str = "none") -> None:
    spectrum_lines(spectrum).write.mode("overwrite").option("compression", compression).text(path)
