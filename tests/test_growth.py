"""Steps whose cost must grow with the input and no faster: how rows are dealt over tasks, and exact short forms."""

import random
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

import catalog.config_queries  # noqa: F401
import catalog.ingest_queries  # noqa: F401
from catalog.registry import QUERIES
from freqloom.functions.scalar import hypergeometric_draw_text
from freqloom.operators import ordering
from freqloom.operators.regions import within_regions
from freqloom.operators.sites import ACCOUNTING, SiteTable
from freqloom.operators.spectrum import full_configs
from freqloom.plans import expected
from freqloom.plans.expected import Sweep
from freqloom.plans.models import Template
from freqloom.sources import json_text


def line_items(spark, path, n=400):
    """A line item table of its own rows with the columns that the genetic views read."""
    spark.range(n).selectExpr(
        "id div 4 as l_orderkey", "id * 7 % 200 as l_partkey", "id * 3 % 10 as l_suppkey", "int(id % 4 + 1) as l_linenumber",
        "double(id % 50 + 1) as l_quantity",
    ).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_equal_sites_are_spelled_out_by_many_tasks(spark):
    """One configuration 200,000 times over: its copies are dealt over partitions, not left to one task."""
    df = spark.range(200_000).selectExpr("'1' as chrom_id", "cast(null as double) as position", "array(3, 2) as anc", "array(5, 2) as der")
    t = SiteTable(df, ("A", "B"), spark.createDataFrame([(None, 200_000, 0)], ACCOUNTING))
    parts = t.down_sample({"A": 4}).df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 200_000
    assert len(parts) > 4 and max(r["count"] for r in parts) < 100_000


@pytest.mark.parametrize("population,hits,draws", [(4, 2, 2), (8, 3, 3), (9, 7, 5), (10, 10, 3), (10, 0, 3), (3, 2, 3), (400, 100, 8)])
def test_few_draws_are_compiled_and_invert_the_distribution(spark, population, hits, draws):
    text = hypergeometric_draw_text("u", "population", "hits", str(draws))
    assert "->" not in text
    df = spark.range(500).selectExpr("(id + 0.5D) / 500 as u", f"double({population}) as population", f"double({hits}) as hits")
    chances = {k: Fraction(comb(hits, k) * comb(population - hits, draws - k), comb(population, draws)) for k in range(max(0, draws - population + hits), min(draws, hits) + 1)}
    for r in df.selectExpr("u", f"{text} as k").collect():
        below = float(sum(p for j, p in chances.items() if j < r.k))
        assert below - 1e-9 <= r.u <= below + float(chances[r.k]) + 1e-9


def test_the_other_copy_is_dealt_over_as_many_tasks_as_the_session_has(spark, tmp_path, monkeypatch):
    plans = []
    equals = SiteTable.equals

    def seen(self, other):
        plans.append(other.df._jdf.queryExecution().executedPlan().toString())
        return equals(self, other)

    monkeypatch.setattr(SiteTable, "equals", seen)
    sf = line_items(spark, tmp_path)
    assert all(r.equal_when_reordered for r in QUERIES["a18_equal_sites"](spark, sf).collect())
    assert len(plans) == 1 and "REPARTITION_BY_COL" in plans[0] and "REPARTITION_BY_NUM" not in plans[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_are_counted_without_pairs(spark, seed):
    """The number of intervals of each record, for nested and repeated intervals of any length, as over all pairs."""
    rnd = random.Random(seed)
    places = [0, 1, 99, 16383, 16384, 16385, 1 << 28, (1 << 28) + 5, 1 << 40]
    spot = lambda: rnd.choice([*places, rnd.randint(0, 300)])
    bed = [(rnd.choice(["1", "2", None]), a := spot(), a + rnd.choice([0, 1, 5, 400, 1 << 15, 1 << 42])) for _ in range(150)] * 2
    records = [(rnd.choice(["1", "2", "3", None]), rnd.choice([None, spot() + 1]), rnd.choice([0, 1, 1, 50, 70000]), i) for i in range(200)]
    frame = spark.createDataFrame(records, "chrom_id string, position long, size long, id int")
    got = within_regions(frame, spark.createDataFrame(bed, "chrom_id string, start_pos long, end_pos long"), "size", count="n")
    want = {}
    for chrom, position, size, i in records:
        if chrom is not None and position is not None:
            n = sum(c == chrom and b > a and position - 1 < b and position - 1 + size > a for c, a, b in bed)
            want |= {i: n} if n else {}
    assert {r.id: r.n for r in got.collect()} == want


def test_a_whole_chromosome_of_intervals_meets_no_site_in_pairs(spark):
    """20,000 intervals over each of 20,000 records, 400 million pairs, as sums."""
    records = spark.range(20_000).selectExpr("'1' as chrom_id", "id + 1 as position")
    bed = spark.range(20_000).selectExpr("'1' as chrom_id", "0L as start_pos", "1000000L + id as end_pos")
    got = within_regions(records, bed, count="n").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.sum("n").alias("all")).first()
    assert tuple(got) == (20_000, 20_000, 400_000_000)


@pytest.mark.parametrize("late", [False, True])
def test_weights_of_all_tips_equal_single_evaluations(spark, monkeypatch, late):
    """Each model's array of weights gives what evaluating every pair of model and configuration gives, missing calls too."""
    models = spark.sql("select id as model_id, 0.2D + id / 3D as t, 0.3D as p, double(id) as g from range(3)")
    t = Template(1.0, 0.25).add_leaf("a", n=1.3, g="g").add_leaf("b", t=0.05 if late else 0).add_leaf("d", n=0.4)
    t.set_size("a", "t / 2", g=0).move_lineages("a", "d", "t / 2", p="p")
    t.move_lineages("a", "b", "t", n=2).move_lineages("b", "d", "t + 1")
    sweep = Sweep(t, models, {"a": 2, "b": 2, "d": 1})
    configs = full_configs(spark, sweep.pops, sweep.sizes).select("anc", "der").unionAll(
        spark.sql("select array(1, 0, 0) as anc, array(0, 2, 0) as der")
    )
    values = lambda: {(r.model_id, tuple(r.anc), tuple(r.der)): r.value for r in sweep.expected_sfs(configs, normalized=True).collect()}
    got = values()
    monkeypatch.setattr(expected, "BROADCAST_BYTES", 2000)
    in_pieces = values()
    monkeypatch.setattr(expected, "BROADCAST_BYTES", 32 << 20)
    monkeypatch.setattr(expected, "JOINT_CELLS", 0)
    want = values()
    assert len(want) == 3 * 17
    assert set(got) == set(want) == set(in_pieces)
    assert max(abs(got[k] - want[k]) + abs(in_pieces[k] - want[k]) for k in want) < 1e-12


def test_site_documents_are_dealt_by_their_number_of_rows(spark, tmp_path, monkeypatch):
    """s9_site_json under a session that puts all it shuffles into one task: rows ranked and counted go to more, each of few rows."""
    monkeypatch.setattr(ordering, "PARTITION_ROWS", 200)
    monkeypatch.setattr(ordering, "FEW_ROWS", 200)
    ranked, with_global_index = [], json_text.with_global_index

    def seen(df, *args):
        ranked.append(with_global_index(df, *args))
        return ranked[-1]

    monkeypatch.setattr(json_text, "with_global_index", seen)
    sf = line_items(spark, tmp_path, 4000)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = QUERIES["s9_site_json"](spark, sf)
        counted = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        parts = [df.groupBy(F.spark_partition_id().alias("p")).count().collect() for df in ranked if "chrom_id" in df.columns]
        assert sorted((r.chrom_id, r.position, r.n) for r in got.collect()) == sorted(
            (f"chr{i * 3 % 10 % 5 + 1}", float(i // 4 * 10 + i % 4 + 1), 1) for i in range(4000)
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    for dealt in [counted, *parts]:
        assert sum(r["count"] for r in dealt) == 4000 and max(r["count"] for r in dealt) < 500
    assert len(parts) == 1


@pytest.mark.parametrize("n_read", [None, 0, 20_000])
def test_site_counts_of_equal_sites(spark, n_read, monkeypatch):
    """A site that repeats 10,000 times is not sent to one task row by row; zeros of both signs and NaNs are one position each."""
    monkeypatch.setattr(ordering, "PARTITION_ROWS", 1000)
    few = [("1", -0.0), ("1", 0.0), ("1", float("nan")), ("1", float("nan")), (None, 5.0), (None, 5.0), (None, None), ("2", 5.0)]
    odd = spark.createDataFrame([(c, p, [2, None], [1, 1]) for c, p in few], "chrom_id string, position double, anc array<int>, der array<int>")
    many = spark.range(0, 10_000, 1, 8).selectExpr("'1' as chrom_id", "cast(null as double) as position", "array(3, 2) as anc", "array(5, 2) as der")
    t = SiteTable(odd.union(many), ("A", "B"), spark.createDataFrame([(None, n_read, 0)], ACCOUNTING))
    got = sorted((str(r.chrom_id), str(r.position), tuple(r.anc), r.n) for r in t.site_counts().collect())
    assert got == sorted([
        ("1", "0.0", (2, None), 2), ("1", "nan", (2, None), 2), ("None", "5.0", (2, None), 2), ("None", "None", (2, None), 1),
        ("2", "5.0", (2, None), 1), ("1", "None", (3, 2), 10_000),
    ])
    plan = t.site_counts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "_from" in plan
