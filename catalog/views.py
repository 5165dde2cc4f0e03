"""Genetic views over the given tables, as Spark tables and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.operators.sites import SiteTable
from freqloom.operators.spectrum import Spectrum

POPS = ("a", "b", "c", "d")
SAMPLED_N = (4, 4, 4, 2)
N_BLOCKS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 9) -> Column:
    """Rounded for comparison across engines; adding 0 turns a negative zero positive."""
    if isinstance(column, str):
        return F.expr(f"round({column}, {digits}) + 0D")
    return F.round(column, digits) + F.lit(0.0)


def sites(spark: SparkSession, sf_dir: str) -> SiteTable:
    """Four populations; c has missing calls, d is the small outgroup."""
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('chr', cast(l_suppkey % 5 + 1 as string)) as chrom_id",
        "l_orderkey * 10 + l_linenumber as position",
        "4 - l_partkey % 5 as a_anc", "l_partkey % 5 as a_der",
        "4 - (l_partkey div 5) % 5 as b_anc", "(l_partkey div 5) % 5 as b_der",
        "(4 - l_linenumber % 2) - least(cast(l_quantity as bigint) % 5, 4 - l_linenumber % 2) as c_anc",
        "least(cast(l_quantity as bigint) % 5, 4 - l_linenumber % 2) as c_der",
        "2 - l_orderkey % 3 as d_anc", "l_orderkey % 3 as d_der",
    )
    return SiteTable.from_counts(
        line, POPS, [f"{p}_anc" for p in POPS], [f"{p}_der" for p in POPS], sampled_n=SAMPLED_N
    )


def blocks(spark: SparkSession, sf_dir: str) -> Spectrum:
    return sites(spark, sf_dir).extract_blocks(N_BLOCKS)


def combined(spark: SparkSession, sf_dir: str) -> Spectrum:
    """One block with all sites: needs no ranking, one aggregation."""
    table_ = sites(spark, sf_dir)
    counted = table_.polymorphic().config_counts()
    rows = counted.select(
        F.lit(0).cast("bigint").alias("block"), "anc", "der", F.col("n_sites").cast("double").alias("cnt")
    )
    return Spectrum(rows, POPS, table_.book.select("length"), (), False, SAMPLED_N)


def spread(df: DataFrame, *extra: str | Column, pops=POPS) -> DataFrame:
    """Counts as one column per population and allele, for comparison."""
    cols = [
        F.expr(f"bigint({side}[{i}]) as {p}_{side}") for i, p in enumerate(pops) for side in ("anc", "der")
    ]
    return df.select(*extra, *cols)


SITES_SQL = """sites as (
 select concat('chr', cast(l_suppkey % 5 + 1 as varchar)) as chrom_id,
        cast(l_orderkey*10 + l_linenumber as double) as position,
        4 - l_partkey % 5 as a_anc, l_partkey % 5 as a_der,
        4 - (l_partkey // 5) % 5 as b_anc, (l_partkey // 5) % 5 as b_der,
        (4 - l_linenumber % 2) - least(cast(l_quantity as bigint) % 5, 4 - l_linenumber % 2) as c_anc,
        least(cast(l_quantity as bigint) % 5, 4 - l_linenumber % 2) as c_der,
        2 - l_orderkey % 3 as d_anc, l_orderkey % 3 as d_der
 from lineitem)"""

CONFIG = "a_anc, a_der, b_anc, b_der, c_anc, c_der, d_anc, d_der"
CONFIG_BIGINT = ", ".join(f"cast({c.strip()} as bigint) as {c.strip()}" for c in CONFIG.split(","))
POLY = "(a_anc + b_anc + c_anc + d_anc > 0 and a_der + b_der + c_der + d_der > 0)"

RANKED_SQL = f"""{SITES_SQL}, ranked as (
 select *, row_number() over (order by chrom_id, position, a_anc, b_anc, c_anc, d_anc, a_der, b_der, c_der, d_der) - 1
        as row_index, count(*) over () as row_total from sites)"""

SFS_SQL = f"""{RANKED_SQL}, sfs as (
 select cast(floor(row_index / (row_total / {float(N_BLOCKS)})) as bigint) as block, {CONFIG},
        cast(count(*) as double) as cnt
 from ranked where {POLY} group by all)"""

TOTAL_SQL = f"""{SITES_SQL}, tot as (
 select {CONFIG}, cast(count(*) as double) as cnt from sites where {POLY} group by all)"""

LONG_SQL = """long as (
 select block, cnt, a_anc, a_der, b_anc, b_der, c_anc, c_der, d_anc, d_der, u.pop, u.anc, u.der, u.n
 from sfs, lateral (values ('a', a_anc, a_der, 4), ('b', b_anc, b_der, 4), ('c', c_anc, c_der, 4), ('d', d_anc, d_der, 2))
      as u(pop, anc, der, n))"""


def key_sql(prefix: str = "", pops=POPS) -> str:
    """Configuration text in DuckDB."""
    return " || chr(9) || ".join(f"({prefix}{p}_anc || ',' || {prefix}{p}_der)" for p in pops)


def comb_sql(n: str, k: str) -> str:
    return (
        f"(case when ({k}) < 0 or ({k}) > ({n}) then 0.0 else cast(factorial(cast({n} as integer)) as double)"
        f" / (cast(factorial(cast({k} as integer)) as double) * cast(factorial(cast(({n}) - ({k}) as integer)) as double)) end)"
    )


def r_sql(x: str, digits: int = 9) -> str:
    return f"(round({x}, {digits}) + 0.0)"
