"""Exact duplicates: groups by a 128-bit content hash, the smallest id stays, and bytes are compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freqloom.llm.common import fresh_columns, texts_of
from freqloom.session import cut_lineage


def normalised(text: Column) -> Column:
    """Null as empty, and each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    Rows are grouped by hash and bytes together, so texts that only share the 128-bit hash stay apart; the partial
    aggregation leaves one row per text and task, which levels a hot group. SHA-256 tells colliding groups apart when rows
    are led back to their group. Null and empty texts are one group. A row without id is kept only if its whole group has
    no id (keep_id null); of rows that repeat the smallest id each is kept. A very long text is one value, hashed and
    compared whole. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    norm = texts_of(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = norm.select("doc_id", content_hash("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    groups = (
        norm.groupBy(content_hash("norm").alias("h"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # An outer join, so that adaptive execution may split the rows of a hot group.
    return rows.join(groups, ["h", "text_sha256"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = cut_lineage(exact_duplicates(docs, id_col, text_col))
    gone = decided.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(docs[id_col].isNotNull()).join(gone, id_col, "left_anti").select(docs.columns)
    # Rows without id stay where no row of their text has one; the scan skips all others.
    (digest,) = fresh_columns(docs, "digest")
    alone = decided.where("kept AND doc_id IS NULL").select(F.col("text_sha256").alias(digest)).distinct()
    unnamed = docs.where(docs[id_col].isNull()).withColumn(digest, F.sha2(normalised(F.col(text_col)), 256)).join(alone, digest, "left_semi")
    return named.unionByName(unnamed.select(docs.columns))
