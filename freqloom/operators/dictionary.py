"""Configuration numbers that stay: new configurations get new numbers, and no other changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from freqloom.functions.configs import ANC, DER, sizes
from freqloom.operators.ordering import with_global_index

DICTIONARY = "config_id BIGINT, content BIGINT, anc ARRAY<INT>, der ARRAY<INT>"


def content() -> F.Column:
    """A 64-bit hash of a configuration; configurations that share one are told apart by their counts."""
    return F.xxhash64(ANC, DER)


def empty_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DICTIONARY)


def new_entries(known: DataFrame, configs: DataFrame) -> DataFrame:
    """``(config_id, content, anc, der)`` of the ``configs(anc, der)`` that ``known`` lacks.

    They are found by an anti-join on the hash and the counts, ranked by similarity among themselves, and numbered on from
    the largest number known. Repeats count once. Calling this runs the ranking of the new ones.
    """
    listed = configs.select(ANC, DER).distinct().withColumn("content", content())
    new = listed.join(known.select("content", ANC, DER), ["content", ANC, DER], "left_anti")
    ranked = with_global_index(new, [sizes(), F.least(ANC, DER), ANC], ["content", ANC, DER])
    start = known.agg((F.coalesce(F.max("config_id"), F.lit(-1)) + 1).alias("start")).first().start
    return ranked.select((F.col("row_index") + start).alias("config_id"), "content", ANC, DER)


def extended(known: DataFrame, configs: DataFrame) -> DataFrame:
    """The dictionary with the configurations it lacks added; known numbers stay as they are."""
    return known.select("config_id", "content", ANC, DER).unionByName(new_entries(known, configs))


def numbered(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` with the ``config_id`` of their configuration; a join on the hash that compares the counts."""
    keyed = rows.withColumn("content", content())
    return keyed.join(dictionary.select("config_id", "content", ANC, DER), ["content", ANC, DER]).select("config_id", *rows.columns)


def collisions(dictionary: DataFrame) -> DataFrame:
    """``(content, n)``: hashes that several configurations share."""
    return dictionary.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary in a folder; an empty one where there is none yet."""
    try:
        return spark.read.schema(DICTIONARY).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty_dictionary(spark)


def store_new(configs: DataFrame, path: str) -> None:
    """Append what the folder's dictionary lacks; files that are there stay untouched. One writer at a time."""
    new_entries(stored(configs.sparkSession, path), configs).write.mode("append").parquet(path)
