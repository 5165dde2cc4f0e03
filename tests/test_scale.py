"""Operators that are built for size: the same results as plain code, and what they read, write and shuffle."""

import json
import math
import random
from fractions import Fraction
from itertools import combinations
from math import comb
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freqloom.functions.scalar import hypergeometric_draw_text
from freqloom.operators import checksums, ordering, sampling, sites as sites_module
from freqloom.operators.dictionary import collisions, content, empty_dictionary, extended, numbered, store_new, stored
from freqloom.operators.regions import within_regions
from freqloom.operators.sites import SITE, SiteTable
from freqloom.operators.spectrum import Spectrum
from freqloom.operators.stats import SpectrumStats
from freqloom.plans.jobs import add_vcf_job, warehouse_spectrum_job
from freqloom.plans.models import Template, edges, lineages, resolve
from freqloom.session import ensure_checkpoint_dir
from freqloom.sources import json_text, tables, vcf, warehouse


def from_rows(spark, rows, pops=("A", "B")):
    df = spark.createDataFrame(rows, "chrom_id string, position double, anc array<int>, der array<int>")
    n = spark.createDataFrame([(None, len(rows), 0)], sites_module.ACCOUNTING)
    return SiteTable(df, pops, n)


def random_rows(rnd, n, positions):
    return [(rnd.choice(["1", "2", "10", None]), rnd.choice(positions), [rnd.randint(0, 3), rnd.randint(0, 2)], [rnd.randint(0, 3), rnd.randint(0, 2)]) for _ in range(n)]


def place(row):
    chrom, position, anc, der = row
    at = (0, 0.0) if position is None else (2, 0.0) if math.isnan(position) else (1, position)
    return ((chrom is not None, chrom or ""), at, anc, der)


def plain_blocks(rows, n_blocks):
    out = {}
    for i, (_, _, anc, der) in enumerate(sorted(rows, key=place)):
        if sum(anc) and sum(der):
            key = (math.floor(i / (len(rows) / n_blocks)), tuple(anc), tuple(der))
            out[key] = out.get(key, 0) + 1
    return out


def as_dict(s):
    return {(r.block, tuple(r.anc), tuple(r.der)): r.cnt for r in s.df.collect()}


WILD = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-13, -1e-13, 5e-324, 0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 1e9, 2.0**31, 1e305, -1.0, -7.5, -(2.0**20)]


@pytest.mark.parametrize("seed,n_blocks", [(1, 2), (2, 7), (3, 40), (4, 500)])
def test_blocks_of_any_positions(spark, seed, n_blocks):
    rnd = random.Random(seed)
    positions = WILD + [rnd.uniform(0, 10.0 ** rnd.randint(0, 9)) for _ in range(60)] + [2.0**k for k in range(0, 40, 3)]
    rows = random_rows(rnd, 400, positions)
    assert as_dict(from_rows(spark, rows).extract_blocks(n_blocks)) == plain_blocks(rows, n_blocks)


def test_blocks_where_one_place_holds_most(spark):
    rnd = random.Random(5)
    rows = random_rows(rnd, 100, [5.0, 6.0]) + [("1", 5.5, [1, 1], [rnd.randint(1, 2), 0]) for _ in range(500)]
    assert as_dict(from_rows(spark, rows).extract_blocks(9)) == plain_blocks(rows, 9)


def test_bins_rise_with_the_position_and_ranges_hold_them(spark):
    rnd = random.Random(6)
    places = sorted({p for p in WILD if p is not None and math.isfinite(p)} | {rnd.uniform(-1, 1) * 2.0 ** rnd.randint(-45, 60) for _ in range(2000)} | {2.0**k for k in range(-42, 62)})
    for resolution in (256, 4096):
        df = spark.createDataFrame([(p,) for p in places], "position double")
        bins = {r.position: r.bin for r in df.selectExpr("position", f"{ordering.bin_text(resolution)} as bin").collect()}
        listed = [bins[p] for p in places]
        assert listed == sorted(listed)
        for p, b in bins.items():
            low, high = ordering.bin_range(b, resolution)
            assert low <= p <= high


def test_blocks_write_little_and_read_cut_bins_by_filter(spark, tmp_path):
    """The rows are fixed nowhere but in the cut bins, and these are read by filters that the source applies."""
    ensure_checkpoint_dir(spark)
    rows = spark.range(200_000).selectExpr(
        "concat('chr', id % 4) as chrom_id", "double(id * 17) as position", "array(int(id % 5), int(id % 3)) as anc", "array(int(4 - id % 5), int(id % 2)) as der"
    )
    tables.save_sites(SiteTable(rows, ("A", "B"), spark.createDataFrame([(None, 200_000, 0)], sites_module.ACCOUNTING)), str(tmp_path / "t"))
    stored_table = tables.load_sites(spark, str(tmp_path / "t"))
    home = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {p for p in home.rglob("part-*")}
    s = stored_table.extract_blocks(20)
    written = sum(p.stat().st_size for p in home.rglob("part-*") if p not in before)
    assert written < 0.2 * sum(p.stat().st_size for p in (tmp_path / "t" / "sites").rglob("*.parquet"))
    assert s.n_snps().first().n_snps == stored_table.polymorphic().df.count()
    counted = {r.block: r.n for r in s.df.groupBy("block").agg(F.sum("cnt").alias("n")).collect()}
    assert len(counted) == 20
    cuts = spark.createDataFrame([("1chr1", 5000)], "chrom string, bin long").collect()
    assert not ordering._has_plain_columns(rows, ["chrom_id", "position"]) and ordering._has_plain_columns(stored_table.df, ["chrom_id", "position"])
    plan = ordering.cut_rows(stored_table.df, cuts, 256)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(position" in plan.split("PushedFilters:")[1].split("\n")[0] and "chr1" in plan.split("PartitionFilters:")[1].split("\n")[0]


def test_sites_that_change_between_reads_are_an_error(spark, monkeypatch):
    rows = random_rows(random.Random(7), 300, [float(k) for k in range(50)])
    t = from_rows(spark, rows)
    other = from_rows(spark, rows + rows[:40])
    wrong = ordering.position_histogram(other.df, ordering.resolution_for(9))
    with pytest.raises(ValueError, match="changed between"):
        ordering.with_blocks(t.df, 9, wrong)


def test_coarser_histograms(spark):
    rows = random_rows(random.Random(8), 500, WILD + [random.Random(9).uniform(-100, 1e6) for _ in range(50)])
    df = from_rows(spark, rows).df
    fine, wide = ({(r.chrom, r.bin): r.n for r in h.collect()} for h in (ordering.coarser(ordering.position_histogram(df, 4096), 4096, 256), ordering.position_histogram(df, 256)))
    assert fine == wide


# ---- warehouse ------------------------------------------------------------------------------------------------------


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_adding_a_part_leaves_the_others(spark, tmp_path):
    rnd = random.Random(10)
    rows = [r for r in random_rows(rnd, 400, [None] + [float(k) for k in range(300)])]
    by = {"one": [r for r in rows if r[0] in ("1", "2")], "two": [r for r in rows if r[0] == "10"], "rest": [r for r in rows if r[0] is None]}
    path = str(tmp_path / "w")
    seen = {}
    for name in by:
        warehouse.put_part(from_rows(spark, by[name]), path, name)
        for part, names in seen.items():
            assert names <= files(tmp_path / "w"), part
        seen[name] = {f for f in files(tmp_path / "w") if f"part={name}/" in f}
    assert warehouse.parts(spark, path) == ["one", "rest", "two"]
    whole = from_rows(spark, rows)
    assert as_dict(warehouse.block_spectrum(spark, path, 11)) == plain_blocks(rows, 11)
    assert warehouse.chromosome_spectrum(spark, path).equals(whole.extract_by_chromosome())
    assert warehouse.load_parts(spark, path).book.first().n_read == 400
    # Replaced by nothing, the part is empty; the others stay as they were.
    warehouse.put_part(from_rows(spark, []), path, "one")
    assert seen["two"] | seen["rest"] <= files(tmp_path / "w")
    assert as_dict(warehouse.block_spectrum(spark, path, 3)) == plain_blocks(by["two"] + by["rest"], 3)
    # More blocks than the stored bins can tell apart.
    assert as_dict(warehouse.block_spectrum(spark, path, 3000)) == plain_blocks(by["two"] + by["rest"], 3000)


def test_a_part_must_fit(spark, tmp_path):
    path = str(tmp_path / "w")
    with pytest.raises(ValueError, match="no parts"):
        warehouse.load_parts(spark, path)
    warehouse.put_part(from_rows(spark, [("1", 1.0, [1, 1], [1, 1])]), path, "a")
    with pytest.raises(ValueError, match="differs"):
        warehouse.put_part(from_rows(spark, [("1", 1.0, [1, 1], [1, 1])], ("B", "A")), path, "b")
    with pytest.raises(ValueError, match="name"):
        warehouse.put_part(from_rows(spark, []), path, "a/b")


def test_parts_from_vcf(spark, tmp_path):
    top = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx1\ty1\n"
    (tmp_path / "ind2pop.txt").write_text("x1 X\ny1 Y\n")
    for chrom in "12":
        lines = [f"{chrom}\t{k}\t.\tA\tT\t.\t.\tAA=A\tGT\t{k % 2}/1\t0/{k % 3 % 2}\n" for k in range(1, 30)]
        (tmp_path / f"{chrom}.vcf").write_text(top + "".join(lines))
        add_vcf_job(spark, str(tmp_path / f"{chrom}.vcf"), str(tmp_path / "ind2pop.txt"), str(tmp_path / "w"), f"chr{chrom}")
    warehouse_spectrum_job(spark, str(tmp_path / "s"), 4, str(tmp_path / "w"))
    both = vcf.read_vcf(spark, [str(tmp_path / f"{c}.vcf") for c in "12"], {"x1": "X", "y1": "Y"})
    assert tables.load_spectrum(spark, str(tmp_path / "s")).equals(both.extract_blocks(4))


def test_leading_zeros_of_chromosome_names_stay(spark, tmp_path):
    rows = [("01", 1.0, [1, 1], [1, 1]), ("1", 2.0, [1, 1], [1, 1]), ("1e3", 2.0, [1, 1], [1, 1])]
    tables.save_sites(from_rows(spark, rows), str(tmp_path / "t"))
    assert {r.chrom_id for r in tables.load_sites(spark, str(tmp_path / "t")).df.collect()} == {"01", "1", "1e3"}


# ---- dictionary -----------------------------------------------------------------------------------------------------


def test_known_numbers_stay(spark, tmp_path):
    configs = lambda pairs: spark.createDataFrame([(list(a), list(d)) for a, d in pairs], "anc array<int>, der array<int>")
    first, more = [((1, 0), (0, 1)), ((2, 1), (1, 1)), ((2, 1), (1, 1))], [((0, 1), (1, 0)), ((1, 0), (0, 1)), ((5, 5), (1, 0)), ((0, 1), (2, 0))]
    path = str(tmp_path / "d")
    assert stored(spark, path).count() == 0
    store_new(configs(first), path)
    before = {(tuple(r.anc), tuple(r.der)): r.config_id for r in stored(spark, path).collect()}
    store_new(configs(more), path)
    store_new(configs(more), path)
    after = {(tuple(r.anc), tuple(r.der)): r.config_id for r in stored(spark, path).collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(5))
    assert {(tuple(r.anc), tuple(r.der)) for r in numbered(configs(first + more), stored(spark, path)).collect()} == set(after)
    assert numbered(configs(more), stored(spark, path)).count() == 4
    assert {k: v for k, v in after.items()} == {(tuple(r.anc), tuple(r.der)): r.config_id for r in extended(extended(empty_dictionary(spark), configs(first)), configs(more)).collect()}


def test_shared_hashes_are_told_apart(spark):
    """Two configurations under one hash keep their own numbers."""
    known = spark.createDataFrame([(0, [1, 2], [3, 4])], "config_id bigint, anc array<int>, der array<int>").withColumn("content", content())
    other = spark.createDataFrame([([9, 9], [9, 9])], "anc array<int>, der array<int>")
    clash = known.unionByName(other.selectExpr("1L as config_id", "anc", "der").crossJoin(known.select("content")))
    assert [r.n for r in collisions(clash).collect()] == [2] and collisions(known).count() == 0
    assert [r.config_id for r in numbered(known.select("anc", "der"), clash).collect()] == [0]


# ---- samples --------------------------------------------------------------------------------------------------------


def hypergeometric(population, hits, draws):
    return {k: Fraction(comb(hits, k) * comb(population - hits, draws - k), comb(population, draws)) for k in range(max(0, draws - population + hits), min(draws, hits) + 1)}


@pytest.mark.parametrize("population,hits,draws", [(4, 2, 2), (10, 0, 3), (10, 10, 3), (10, 4, 0), (10, 4, 10), (9, 7, 5), (60, 30, 30), (400, 100, 350), (3000, 1500, 1500)])
def test_hypergeometric_draws_invert_the_distribution(spark, population, hits, draws):
    n = 500
    df = spark.range(n).selectExpr(f"(id + 0.5D) / {n} as u", f"{population}L as population", f"{hits} as hits", f"{draws} as draws")
    got = {r.u: r.k for r in df.selectExpr("u", f"{hypergeometric_draw_text('u', 'population', 'hits', 'draws')} as k").collect()}
    chances = hypergeometric(population, hits, draws)
    for u, k in got.items():
        below = float(sum(p for j, p in chances.items() if j < k))
        assert below - 1e-9 <= u <= below + float(chances[k]) + 1e-9


def test_hypergeometric_draws_of_huge_populations(spark):
    """Mean and deviation of half a billion draws from a billion, in steps that go with the deviation."""
    df = spark.range(2000).selectExpr("(id + 0.5D) / 2000 as u", "1000000000L as n", "300000000L as k", "500000000L as m")
    draw = hypergeometric_draw_text("u", "n", "k", "m")
    mean, sd = df.selectExpr(f"{draw} as x").selectExpr("avg(x)", "stddev(x)").first()
    want = math.sqrt(5e8 * 0.3 * 0.7 * 0.5)
    assert abs(mean - 1.5e8) < 0.05 * want and abs(sd / want - 1) < 0.02


def test_equal_sites_draw_apart(spark):
    """Rows that agree in all columns: draws spread as the hypergeometric says, for any partitioning, also over pieces."""
    rows = [("1", None, [3, 2], [5, 2])] * 4000
    got = []
    for parts in (1, 6):
        t = from_rows(spark, rows)
        small = SiteTable(t.df.repartition(parts), t.pops, t.book).down_sample({"A": 4}, seed=2).df
        got.append({r.a: r.n for r in small.groupBy(F.col("anc")[0].alias("a")).agg(F.count("*").alias("n")).collect()})
        assert small.selectExpr("anc[0] + der[0] = 4 and anc[1] = 2 and der[1] = 2 as ok").distinct().collect() == [(True,)]
    assert got[0] == got[1] and sum(got[0].values()) == 4000
    chances = hypergeometric(8, 3, 4)
    mean = sum(a * n for a, n in got[0].items()) / 4000
    variance = sum((a - mean) ** 2 * n for a, n in got[0].items()) / 4000
    want = float(sum(k * p for k, p in chances.items())), float(sum(k * k * p for k, p in chances.items()) - sum(k * p for k, p in chances.items()) ** 2)
    assert abs(mean - want[0]) < 0.05 and abs(variance - want[1]) < 0.05
    chi = sum((got[0].get(k, 0) - 4000 * float(p)) ** 2 / (4000 * float(p)) for k, p in chances.items())
    assert chi < 16.3  # the 99.9 % point at three degrees of freedom


def test_many_equal_sites_come_in_pieces(spark, monkeypatch):
    rows = [("1", 2.0, [3, 2], [5, 2])] * 900 + [("2", 1.0, [1, 1], [1, 1])] * 3
    whole = sorted(map(str, from_rows(spark, rows).down_sample({"A": 4}, seed=2).df.collect()))
    monkeypatch.setattr(sites_module, "COPY_RUN", 100)
    assert sorted(map(str, from_rows(spark, rows).down_sample({"A": 4}, seed=2).df.collect())) == whole
    assert from_rows(spark, rows).down_sample({"A": 4}, distinct=True).df.count() == len(rows)


@pytest.mark.parametrize("split", [2, 64])
def test_minibatches_deal_like_a_shuffle(spark, monkeypatch, split):
    """Sizes differ by one at most; over many seeds the share of a configuration in a batch is hypergeometric."""
    monkeypatch.setattr(sampling, "SPLIT", split)
    counts = {((1, 1), (1, 1)): 7, ((2, 0), (0, 2)): 5, ((0, 1), (2, 1)): 1, ((1, 0), (1, 2)): 10, ((2, 2), (1, 0)): 0.5}
    rows = spark.createDataFrame([(0, list(a), list(d), float(n)) for (a, d), n in counts.items()], "block long, anc array<int>, der array<int>, cnt double")
    s = Spectrum.from_rows(rows, ("A", "B")).materialised()
    shares = []
    for seed in range(30):
        got = {(r.batch, tuple(r.anc), tuple(r.der)): r.cnt for r in sampling.minibatches(s, 4, seed).collect()}
        size = [sum(n for (b, *_), n in got.items() if b == batch) for batch in range(4)]
        assert size == [6, 6, 6, 5]
        for config, n in counts.items():
            assert sum(got.get((b, *config), 0) for b in range(4)) == int(n)
        shares += [got.get((b, (1, 0), (1, 2)), 0) for b in range(3)]
    chances = hypergeometric(23, 10, 6)
    want = float(sum(k * p for k, p in chances.items())), float(sum(k * k * p for k, p in chances.items()) - sum(k * p for k, p in chances.items()) ** 2)
    mean = sum(shares) / len(shares)
    assert abs(mean - want[0]) < 0.4 and abs(sum((x - mean) ** 2 for x in shares) / len(shares) - want[1]) < 0.6
    assert sampling.minibatches(Spectrum(s.df.limit(0), s.pops, s.meta), 3).count() == 0


# ---- equality -------------------------------------------------------------------------------------------------------


def test_checksums_tell_rows_apart(spark):
    base = [("1", 1.0, [1], [2]), ("1", 1.0, [1], [2]), (None, None, [1], [2]), ("2", 0.0, [1], [2])]
    changes = [
        base[:1] + base[2:], base + base[2:3], [("1", 1.0, [1], [2])] * 2 + [(None, 1.0, [1], [2]), base[3]], base[:3] + [("2", 0.5, [1], [2])],
        base[:3] + [("2", 0.0, [2], [1])], base[:3] + [("3", 0.0, [1], [2])],
    ]
    t = from_rows(spark, base, ("A",))
    assert t.equals(from_rows(spark, base[::-1][:1] + base[:2] + base[2:3], ("A",)))
    # Zero has one sign.
    assert t.differences(from_rows(spark, base[:3] + [("2", -0.0, [1], [2])], ("A",))).count() == 0
    for changed in changes:
        other = from_rows(spark, changed, ("A",))
        assert checksums.keys_that_differ(t.df, other.df, "chrom_id", SITE).count() > 0
        assert t.differences(other).count() > 0
        many = t.differences(other)
        assert sorted(map(str, many.collect())) == sorted(map(str, other.differences(t).selectExpr("chrom_id", "position", "anc", "der", "if(side = 'left', 'right', 'left') as side").collect()))


def test_differences_with_many_keys(spark, monkeypatch):
    rows = [(str(k) if k else None, float(k), [1], [2]) for k in range(12)]
    t, other = from_rows(spark, rows, ("A",)), from_rows(spark, [(c, p + 0.5, a, d) for c, p, a, d in rows], ("A",))
    named = sorted(map(str, t.differences(other).collect()))
    monkeypatch.setattr(checksums, "NAMED_KEYS", 3)
    assert sorted(map(str, t.differences(other).collect())) == named and len(named) == 24


# ---- intervals, text, headers ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_any_length(spark, seed):
    rnd = random.Random(seed)
    size = lambda: int(10 ** rnd.uniform(0, 9.5))
    bed = [(rnd.choice("12"), s := rnd.randrange(10 ** rnd.randint(1, 9)), s + size()) for _ in range(60)] + [("1", 5, 5), ("2", 9, 3), (None, 0, 10**9), ("1", 0, 2**40), ("1", 0, 2**40)]
    records = [(rnd.choice(["1", "2", None]), rnd.randrange(1, 10 ** rnd.randint(1, 9)), rnd.choice([1, 1, 5, 40_000])) for _ in range(300)] + [("1", None, 1), ("1", 16384, 2), ("1", 16385, 1)]
    got = within_regions(spark.createDataFrame(records, "chrom_id string, position long, size long"), spark.createDataFrame(bed, "chrom_id string, start_pos long, end_pos long"), "size")
    want = sorted((c, p, n) for c, p, n in records for b, s, e in bed if c and p and c == b and e > s and p - 1 < e and p - 1 + n > s)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert within_regions(spark.createDataFrame(records, "chrom_id string, position long, size long"), spark.createDataFrame([], "chrom_id string, start_pos long, end_pos long")).count() == 0


def test_documents_are_written_in_order(spark, tmp_path):
    rows = [r for r in random_rows(random.Random(3), 300, [float(k) for k in range(100)]) if r[0]]
    json_text.dump_sites(SiteTable(from_rows(spark, rows).df.repartition(5), ("A", "B"), from_rows(spark, rows).book), str(tmp_path / "d"))
    parts = sorted((tmp_path / "d").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    listed = [(c, p, *map(list, zip(*doc["configs"][i]))) for c, p, i in doc["(chrom_id,position,config_id)"]]
    assert sorted(listed) == sorted(rows) and [x[:2] for x in listed] == [x[:2] for x in sorted(listed)]
    plan = json_text.site_lines(from_rows(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan


def test_vcf_files_with_other_columns(spark, tmp_path):
    """The same samples in another order and with others between: one call reads both files."""
    top = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    line = "{}\t{}\t.\tA\tT\t.\t.\tAA=A\tGT\t{}\n"
    (tmp_path / "a.vcf").write_text(top + "x\ty\n" + line.format(1, 5, "0/1\t1/1"))
    (tmp_path / "b.vcf").write_text(top + "y\tother\tx\n" + line.format(2, 7, "0/0\t1/1\t0/1"))
    t = vcf.read_vcf(spark, [str(tmp_path / f"{f}.vcf") for f in "ab"], {"x": "X", "y": "Y"})
    assert sorted((r.chrom_id, r.position, r.anc, r.der) for r in t.df.collect()) == [("1", 5.0, [1, 0], [1, 2]), ("2", 7.0, [1, 2], [1, 0])]
    assert t.book.first().n_read == 2
    (tmp_path / "c.vcf").write_text(top + "y\n" + line.format(2, 7, "0/0"))
    with pytest.raises(ValueError, match="without a column"):
        vcf.read_vcf(spark, str(tmp_path / "*.vcf"), {"x": "X", "y": "Y"})
    (tmp_path / "c.vcf").write_text(line.format(3, 8, "1/1\t0/0"))
    with pytest.raises(ValueError, match="no #CHROM"):
        vcf.read_vcf(spark, str(tmp_path / "*.vcf"), {"x": "X", "y": "Y"})
    rest = vcf.read_vcf(spark, [str(tmp_path / f"{f}.vcf") for f in "ac"], {"x": "X", "y": "Y"})
    assert sorted((r.chrom_id, r.anc, r.der) for r in rest.df.collect()) == [("1", [1, 0], [1, 2]), ("3", [0, 2], [2, 0])]
    with pytest.raises(ValueError, match="no #CHROM"):
        vcf.read_vcf(spark, str(tmp_path / "c.vcf"), {"x": "X"})


# ---- pairs of populations, graphs -------------------------------------------------------------------------------------


@pytest.mark.parametrize("outside", [(), ("C",), ("A", "D")])
def test_pair_vectors_equal_single_statistics(spark, outside):
    rnd = random.Random(len(outside))
    data = [(b, [rnd.randint(0, 4) for _ in range(4)], [rnd.randint(0, 4) for _ in range(4)], float(rnd.randint(1, 5))) for b in range(4) for _ in range(15)]
    inside = [i for i, p in enumerate("ABCD") if p not in outside]
    data = [r for r in data if any(r[1][i] for i in inside) and any(r[2][i] for i in inside)]
    s = Spectrum.from_rows(spark.createDataFrame(data, "block long, anc array<int>, der array<int>, cnt double"), tuple("ABCD"), non_ascertained=outside)
    stats = SpectrumStats(s, {"A": 2, "B": 1, "C": 3, "D": 2})
    expected = spark.createDataFrame([("A", "C", 0.1), ("A", "D", 0.2)], "pop1 string, pop2 string, expected double")
    for quick, single in ((stats.all_f2, stats.all_f2_stats()), (stats.all_pairs_ibs, stats.all_ibs_stats())):
        for given in (None, expected):
            got = {(r.pop1, r.pop2): r for r in quick(given).collect()}
            want = {(r.pop1, r.pop2): r for r in stats.pair_table(single, given).collect()}
            assert got.keys() == want.keys()
            for pair, w in want.items():
                assert got[pair].observed == pytest.approx(w.observed, rel=1e-9, abs=1e-12) and got[pair].expected == w.expected
                assert got[pair].z == (None if w.z is None else pytest.approx(w.z, rel=1e-6))


def test_plan_of_pairs_does_not_grow(spark):
    def text(n):
        pops = tuple(f"p{i:02d}" for i in range(n))
        df = spark.createDataFrame([(b, [2] * n, [2] * n, 1.0) for b in range(3)], "block long, anc array<int>, der array<int>, cnt double")
        f2 = SpectrumStats(Spectrum.from_rows(df, pops)).all_f2()
        assert f2.count() == n * (n - 1) // 2
        return len(f2._jdf.queryExecution().optimizedPlan().toString())

    assert text(24) < 8 * text(6)  # 276 pairs against 15; the facts of a population are written out once


def test_lineages_with_pulses(spark):
    """Nodes above each leaf by walking the edges one at a time, with models in two orders of events."""
    t = Template(1e4, 25.0)
    for p in "abcd":
        t.add_leaf(p)
    t.move_lineages("a", "b", "t", p=0.3).move_lineages("c", "d", 3000, p=0.2).move_lineages("a", "c", 5000).move_lineages("b", "d", 7000).move_lineages("c", "d", 9000)
    models = spark.createDataFrame([(1, 1000.0), (2, 4000.0), (3, 1500.0)], "model_id long, t double")
    events = resolve(models, t)
    n = {"a": 1, "b": 2, "c": 4, "d": 8}
    up = {}
    for r in edges(events).collect():
        up.setdefault((r.model_id, r.child), set()).add(r.parent)
    want = {}
    for model in (1, 2, 3):
        for leaf, size in n.items():
            seen, todo = set(), [f"{leaf}:0"]
            while todo:
                node = todo.pop()
                if node not in seen:
                    seen.add(node)
                    todo += up.get((model, node), ())
            for node in seen:
                want[model, node] = want.get((model, node), 0) + size
    assert {(r.model_id, r.node): r.n for r in lineages(events, n).collect()} == want
