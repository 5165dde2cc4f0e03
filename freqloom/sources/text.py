"""Small text inputs: sample-to-population lists and BED intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_ind2pop(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, pop)`` from a two-column whitespace file."""
    lines = spark.read.text(path).where("trim(value) <> ''").selectExpr("split(trim(value), '\\\\s+') as w")
    return lines.selectExpr("w[0] as sample", "w[1] as pop")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom_id, start_pos, end_pos)``, 0-based half-open; ``.gz`` is read as well."""
    lines = spark.read.text(path).where("trim(value) <> ''").selectExpr("split(trim(value), '\\\\s+') as w")
    return lines.selectExpr("w[0] as chrom_id", "bigint(w[1]) as start_pos", "bigint(w[2]) as end_pos")
