"""Order-free checksums of multisets of rows: equality without a comparison of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys that differ are named in a filter up to this many; more are a table to join with.
NAMED_KEYS = 1000


def _hash_text(columns: Sequence[tuple[str, str]], salt: int) -> str:
    """A 64-bit hash of the columns; a null is not a value left out, and zero has one sign."""
    parts = [f"{c} + 0D" if kind == "double" else c for c, kind in columns]
    return f"cast(xxhash64({salt}, {', '.join(f'{p}, {c} is null' for p, (c, _) in zip(parts, columns))}) as decimal(38, 0))"


def checksums(df: DataFrame, key: str, columns: Sequence[str], sign: int = 1) -> DataFrame:
    """``(key, n, h1, h2)``: number of rows and two sums of 64-bit hashes per value of ``key``, times ``sign``.

    The sums do not depend on the order of rows and add up over parts of the data; one aggregation with map-side combine, so
    a row per key and task is shuffled.
    """
    kinds = dict(df.dtypes)
    typed = [(c, kinds[c]) for c in columns]
    return df.groupBy(F.col(key).alias("key")).agg(
        F.expr(f"{sign} * count(*)").alias("n"), *[F.expr(f"{sign} * sum({_hash_text(typed, salt)})").alias(f"h{salt}") for salt in (1, 2)]
    )


def keys_that_differ(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key)`` of the groups whose rows differ as multisets; equal sums of different rows have a chance of about 2^-128."""
    both = checksums(left, key, columns).unionAll(checksums(right, key, columns, -1))
    sums = both.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")])
    return sums.where("n <> 0 or h1 <> 0 or h2 <> 0").select("key")


def rows_that_differ(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(*columns, side)``: rows that only one side has, repeats counted; only groups that differ are compared."""
    kind = left.schema[key].dataType
    keys = [r["key"] for r in keys_that_differ(left, right, key, columns).collect()]

    def part(df: DataFrame) -> DataFrame:
        if len(keys) <= NAMED_KEYS:
            named = F.col(key).isin([k for k in keys if k is not None])
            return df.where(named | F.col(key).isNull() if None in keys else named).select(*columns)
        wanted = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], f"_key {kind.simpleString()}"))
        return df.join(wanted, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(*columns)

    mine, theirs = part(left), part(right)
    return mine.exceptAll(theirs).withColumn("side", F.lit("left")).unionByName(theirs.exceptAll(mine).withColumn("side", F.lit("right")))
