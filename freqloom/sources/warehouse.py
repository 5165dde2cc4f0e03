"""A folder of site tables that grows part by part (a chromosome, a file): adding one rewrites only its own folders.

Each part has its sites, sorted and range-partitioned by place, and what is known of them in small: counts of configurations
by chromosome, a histogram of positions, and one row of accounting. Spectra come from these, over all parts at once.

    path/sites/part=NAME    chrom_id, position, anc, der
    path/counts/part=NAME   chrom_id, anc, der, n
    path/bins/part=NAME     chrom, bin, n
    path/book/part=NAME     accounting and metadata; a part without it is not there
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from freqloom.operators.ordering import coarser, position_histogram, resolution_for, with_blocks
from freqloom.operators.sites import ACCOUNTING, SITE, SiteTable
from freqloom.operators.spectrum import Spectrum
from freqloom.sources.tables import metadata

#: Bins per power of two of the stored histograms; spectra of more blocks than half of it count bins anew.
STORED_RESOLUTION = 4096
SCHEMAS = {
    "sites": "chrom_id STRING, position DOUBLE, anc ARRAY<INT>, der ARRAY<INT>",
    "counts": "chrom_id STRING, anc ARRAY<INT>, der ARRAY<INT>, n BIGINT",
    "bins": "chrom STRING, bin BIGINT, n BIGINT",
    "book": f"{ACCOUNTING}, pops ARRAY<STRING>, non_ascertained ARRAY<STRING>, folded BOOLEAN, sampled_n ARRAY<INT>",
}


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{SCHEMAS[kind]}, part STRING").parquet(f"{path}/{kind}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts, sorted: one row each."""
    book = _read(spark, path, "book")
    return [] if book is None else sorted(r.part for r in book.select("part").collect())


def put_part(table: SiteTable, path: str, part: str) -> None:
    """Add the part or replace it; the files of other parts stay as they are.

    Populations, their order, ascertainment and folding must be those of the parts there. The accounting is taken away
    first and written last, so a part that was broken off is not read. One writer of a part at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
        raise ValueError("a part's name has letters, digits, dots, dashes and underscores")
    spark = table.df.sparkSession
    book = _read(spark, path, "book")
    described = metadata(table)
    if book is not None:
        same = described.select("pops", "non_ascertained", "folded").first()
        for other in book.where(F.col("part") != part).select("pops", "non_ascertained", "folded").distinct().collect():
            if (other.pops, set(other.non_ascertained), other.folded) != (same.pops, set(same.non_ascertained), same.folded):
                raise ValueError("the part differs from those there in its populations, their order, ascertainment or folding")

    def write(df: DataFrame, kind: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{kind}/part={part}")

    write(described.limit(0), "book")
    tied = table.df.select(*SITE).withColumn("_tie", F.monotonically_increasing_id())
    write(tied.repartitionByRange("chrom_id", "position", "_tie").sortWithinPartitions("chrom_id", "position").drop("_tie"), "sites")
    sites = spark.read.schema(SCHEMAS["sites"]).parquet(f"{path}/sites/part={part}")
    write(sites.groupBy("chrom_id", "anc", "der").agg(F.count(F.lit(1)).alias("n")), "counts")
    write(position_histogram(sites, STORED_RESOLUTION), "bins")
    write(described, "book")


def _present(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of the parts that have their accounting."""
    names = parts(spark, path)
    if not names:
        raise ValueError(f"no parts in {path}")
    return _read(spark, path, kind).where(F.col("part").isin(names)).drop("part")


def load_parts(spark: SparkSession, path: str) -> SiteTable:
    """All parts as one site table; filters on chromosome and position skip files and row groups."""
    book = _present(spark, path, "book")
    # One row per part.
    rows = book.collect()
    sizes = {None if r.sampled_n is None else tuple(r.sampled_n) for r in rows}
    summed = book.agg(
        F.when(F.count(F.lit(1)) == F.count("length"), F.sum("length")).alias("length"), F.sum("n_read").alias("n_read"),
        F.sum("n_excluded").alias("n_excluded"),
    )
    return SiteTable(
        _present(spark, path, "sites"), tuple(rows[0].pops), summed, tuple(rows[0].non_ascertained), rows[0].folded,
        sizes.pop() if len(sizes) == 1 else None,
    )


def chromosome_spectrum(spark: SparkSession, path: str) -> Spectrum:
    """One block per chromosome, in name order, from the stored counts alone: no site is read."""
    counts = _present(spark, path, "counts")
    return load_parts(spark, path).spectrum_of_counts(counts.withColumnsRenamed({"chrom_id": "block", "n": "cnt"})).renumbered()


def block_spectrum(spark: SparkSession, path: str, n_blocks: int) -> Spectrum:
    """Blocks of equal numbers of sites over all parts; the histogram of positions is the sum of the stored ones."""
    table, resolution = load_parts(spark, path), resolution_for(n_blocks)
    bins = coarser(_present(spark, path, "bins"), STORED_RESOLUTION, resolution) if resolution <= STORED_RESOLUTION else None
    return table.spectrum_of_rows(with_blocks(table.df, n_blocks, bins))
