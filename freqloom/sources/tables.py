"""Parquet folders for site tables and spectra: rows plus one row of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.operators.sites import SiteTable
from freqloom.operators.spectrum import Spectrum


def _strings(values) -> object:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _ints(values) -> object:
    return F.lit(None).cast("array<int>") if values is None else F.array(*[F.lit(int(v)) for v in values])


def metadata(table: SiteTable) -> DataFrame:
    """The accounting row with populations, ascertainment, folding and sample sizes."""
    return table.book.select(
        "*", _strings(table.pops).alias("pops"), _strings(table.non_ascertained).alias("non_ascertained"),
        F.lit(table.folded).alias("folded"), _ints(table.sampled_n).alias("sampled_n"),
    )


def save_sites(table: SiteTable, path: str) -> None:
    """Rows by chromosome and sorted by position inside each file, so that region filters skip row groups.

    A tie-breaker lets the range shuffle split even a position that repeats without end.
    """
    tied = table.df.withColumn("_tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange("chrom_id", "position", "_tie").sortWithinPartitions("chrom_id", "position").drop("_tie")
    rows.write.mode("overwrite").partitionBy("chrom_id").parquet(f"{path}/sites")
    metadata(table).write.mode("overwrite").parquet(f"{path}/meta")


def load_sites(spark: SparkSession, path: str) -> SiteTable:
    meta = spark.read.parquet(f"{path}/meta")
    info = meta.first()
    # Chromosome names are folder names; as text they keep leading zeros.
    stored = "position DOUBLE, anc ARRAY<INT>, der ARRAY<INT>, chrom_id STRING"
    rows = spark.read.schema(stored).parquet(f"{path}/sites").select("chrom_id", "position", "anc", "der")
    n = None if info.sampled_n is None else tuple(info.sampled_n)
    return SiteTable(
        rows, tuple(info.pops), meta.select("length", "n_read", "n_excluded"), tuple(info.non_ascertained), info.folded, n
    )


def save_spectrum(spectrum: Spectrum, path: str) -> None:
    spectrum.df.write.mode("overwrite").parquet(f"{path}/spectrum")
    meta = spectrum.meta.select(
        "length", _strings(spectrum.pops).alias("pops"), _strings(spectrum.non_ascertained).alias("non_ascertained"),
        F.lit(spectrum.folded).alias("folded"), _ints(spectrum.declared_n).alias("sampled_n"),
    )
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_spectrum(spark: SparkSession, path: str) -> Spectrum:
    meta = spark.read.parquet(f"{path}/meta")
    info = meta.first()
    n = None if info.sampled_n is None else tuple(info.sampled_n)
    return Spectrum(
        spark.read.parquet(f"{path}/spectrum"), tuple(info.pops), meta.select("length"), tuple(info.non_ascertained),
        info.folded, n,
    )
