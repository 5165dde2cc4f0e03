"""Sites, spectra, text formats: hand-made fixtures and laws."""

import json
from itertools import product
from math import comb

import pytest
from pyspark.sql import functions as F

from freqloom.functions.configs import config_key
from freqloom.operators.sampling import bootstrap, bootstrap_totals, minibatches
from freqloom.operators.sites import SiteTable
from freqloom.operators.spectrum import Spectrum, configs_from_derived, full_configs
from freqloom.operators.stats import SpectrumStats, subsample_probability_text
from freqloom.plans.jobs import concatenate_job, extract_spectrum_job, vcf_job
from freqloom.sources import json_text, tables
from freqloom.sources.dadi import read_dadi
from freqloom.sources.vcf import read_vcf, sites_from_lines

HEADER = "##fileformat=VCFv4.2\n##INFO=<ID=AA>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx1\tx2\ty1\to1\n"
RECORDS = [
    "1\t10\t.\tA\tT\t.\t.\tAA=A\tGT\t0/1\t1|1\t0\t0/0",
    "1\t20\t.\tA\tT\t.\t.\tDP=3;AA=T\tGT:DP\t0/1:3\t./.\t1:4\t1/1:2",
    "1\t30\t.\tA\tT,G\t.\t.\tAA=A\tGT\t0/1\t1|2\t0\t0/0",
    "1\t40\t.\tA\tT\t.\t.\tAA=a\tGT\t0/1\t1|1\t0\t0/1",
    "2\t50\t.\tA\tT\t.\t.\tAAX=A\tGT\t0/0\t0|.\t0\t.",
    "2\t60\t.\tACG\tA\t.\t.\tAA=ACG\tDP\t3\t4\t5\t6",
]
IND2POP = {"x1": "X", "x2": "X", "y1": "Y", "o1": "O"}


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    path = tmp_path_factory.mktemp("vcf")
    (path / "all.vcf").write_text(HEADER + "\n".join(RECORDS) + "\n")
    (path / "ind2pop.txt").write_text("\n".join(f"{s} {p}" for s, p in IND2POP.items()) + "\n")
    (path / "all.bed").write_text("1\t0\t15\n1\t5\t25\n2\t60\t70\n")
    return path


def rows(table):
    return sorted((r.chrom_id, r.position, tuple(r.anc), tuple(r.der)) for r in table.df.collect())


def spectrum(spark, data, pops, **kwargs):
    listed = [(b, list(a), list(d), float(c)) for (b, a, d), c in data.items()]
    df = spark.createDataFrame(listed, "block BIGINT, anc ARRAY<INT>, der ARRAY<INT>, cnt DOUBLE")
    return Spectrum.from_rows(df, pops, **kwargs)


def as_dict(s):
    return {(r.block, tuple(r.anc), tuple(r.der)): r.cnt for r in s.df.collect()}


SAMPLE = {
    (0, (2, 1), (1, 1)): 3, (0, (3, 0), (0, 2)): 1, (0, (1, 1), (2, 0)): 2, (1, (2, 1), (1, 1)): 1, (1, (0, 2), (3, 0)): 4,
    (2, (1, 2), (2, 0)): 2, (2, (3, 1), (0, 1)): 5, (2, (2, 2), (1, 0)): 1,
}


def test_vcf_ancestral_field(spark, vcf):
    t = read_vcf(spark, str(vcf / "all.vcf"), IND2POP)
    assert t.pops == ("O", "X", "Y") and not t.folded
    assert rows(t) == [
        ("1", 10.0, (2, 1, 1), (0, 3, 0)), ("1", 20.0, (2, 1, 1), (0, 1, 0)), ("2", 60.0, (0, 0, 0), (0, 0, 0)),
    ]
    book = t.book.first()
    assert (book.length, book.n_read, book.n_excluded) == (None, 3, 2)


def test_vcf_outgroup_and_reference(spark, vcf):
    t = read_vcf(spark, str(vcf / "all.vcf"), IND2POP, ancestral_alleles="O")
    assert t.pops == ("X", "Y")
    assert rows(t) == [("1", 10.0, (1, 1), (3, 0)), ("1", 20.0, (1, 1), (1, 0))]
    assert t.book.first().n_excluded == 3
    u = read_vcf(spark, str(vcf / "all.vcf"), IND2POP, ancestral_alleles=False)
    assert u.folded and u.df.count() == 5 and u.book.first().n_excluded == 0


def test_vcf_regions_count_overlaps_twice(spark, vcf):
    t = read_vcf(spark, str(vcf / "all.vcf"), IND2POP, bed_path=str(vcf / "all.bed"))
    assert [(r[0], r[1]) for r in rows(t)] == [("1", 10.0), ("1", 10.0), ("1", 20.0), ("2", 60.0)]
    assert t.book.first().length == 15 + 20 + 10


def test_vcf_subset_and_errors(spark, vcf):
    t = read_vcf(spark, str(vcf / "all.vcf"), {"x2": "X", "y1": "Y"})
    assert rows(t)[0] == ("1", 10.0, (0, 1), (2, 0))
    with pytest.raises(ValueError):
        read_vcf(spark, str(vcf / "all.vcf"), {"nobody": "X"})


def test_vcf_lines_under_another_header_are_refused(spark, vcf, tmp_path):
    """Lines of both files under one of their headers; the reader gives each file its own."""
    other = HEADER.replace("x1\tx2", "x2\tx1")
    (tmp_path / "a.vcf").write_text(HEADER + RECORDS[0] + "\n")
    (tmp_path / "b.vcf").write_text(other + RECORDS[0] + "\n")
    lines = spark.read.text(str(tmp_path / "*.vcf"))
    with pytest.raises(Exception, match="different headers"):
        sites_from_lines(lines, HEADER.splitlines()[-1], IND2POP).df.collect()
    assert read_vcf(spark, str(tmp_path / "*.vcf"), IND2POP).df.count() == 2


def test_jobs(spark, vcf, tmp_path):
    out = [str(tmp_path / x) for x in ("one", "two", "both", "sfs")]
    for path in out[:2]:
        vcf_job(spark, str(vcf / "all.vcf"), str(vcf / "ind2pop.txt"), path, no_aa=True)
    concatenate_job(spark, out[:2], out[2])
    both = tables.load_sites(spark, out[2])
    assert both.df.count() == 10 and both.book.first().n_read == 10 and both.folded
    extract_spectrum_job(spark, out[3], 2, [out[2]])
    s = tables.load_spectrum(spark, out[3])
    assert s.folded and s.n_snps().first().n_snps == 6.0


def test_site_json_round_trip(spark, tmp_path):
    doc = {
        "populations": ["A", "B"], "use_folded_sfs": False, "length": 100, "n_read_snps": 3, "n_excluded_snps": 1,
        "configs": [[[2, 0], [1, 1]], [[1, 1], [0, 2]]],
        "(chrom_id,position,config_id)": [["1", 10.0, 0], ["1", 20.0, 1], ["2", 5.0, 0]],
    }
    (tmp_path / "sites.json").write_text(json.dumps(doc))
    t = json_text.load_sites_compact(spark, str(tmp_path / "sites.json"))
    expected = [("1", 10.0, (2, 1), (0, 1)), ("1", 20.0, (1, 0), (1, 2)), ("2", 5.0, (2, 1), (0, 1))]
    assert rows(t) == expected and t.book.first().length == 100.0
    json_text.dump_sites(t, str(tmp_path / "lines"))
    back = json_text.load_sites(spark, str(tmp_path / "lines"))
    assert rows(back) == expected and back.pops == t.pops and back.book.first() == t.book.first()
    parts = sorted((tmp_path / "lines").glob("part-*"))
    written = json.loads("".join(p.read_text() for p in parts))
    assert written["populations"] == ["A", "B"] and len(written["(chrom_id,position,config_id)"]) == 3
    json_text.dump_sites(t, str(tmp_path / "zipped"), compression="gzip")
    assert rows(json_text.load_sites(spark, str(tmp_path / "zipped"))) == expected


def test_spectrum_json_round_trip(spark, tmp_path):
    s = spectrum(spark, SAMPLE, ("A", "B"), length=1000.0)
    json_text.dump_spectrum(s, str(tmp_path / "s"))
    back = json_text.load_spectrum(spark, str(tmp_path / "s"))
    assert back.equals(s) and back.meta.first().length == 1000.0 and not back.folded
    doc = {
        "sampled_pops": ["A", "B"], "folded": True, "length": None, "configs": [[[2, 0], [1, 1]], [[1, 1], [0, 2]]],
        "(locus,config_id,count)": [[0, 0, 1.5], [0, 1, 2.0], [0, 0, 4.0], [1, 1, 1.0]],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    c = json_text.load_spectrum_compact(spark, str(tmp_path / "c.json"))
    assert c.folded and as_dict(c) == {
        (0, (2, 1), (0, 1)): 4.0, (0, (1, 0), (1, 2)): 2.0, (1, (1, 0), (1, 2)): 1.0
    }


def test_dadi(spark, tmp_path):
    bins = list(range(12))
    mask = [1] + [0] * 10 + [1]
    text = "# comment\n3 4 {} \"P\" \"Q\"\n" + " ".join(map(str, bins)) + "\n" + " ".join(map(str, mask)) + "\n"
    (tmp_path / "u.sfs").write_text(text.format("unfolded"))
    s = read_dadi(spark, str(tmp_path / "u.sfs"))
    want = {(0, (2 - i, 3 - j), (i, j)): float(4 * i + j) for i, j in product(range(3), range(4)) if 0 < 4 * i + j < 11}
    assert as_dict(s) == want and s.pops == ("P", "Q") and s.meta.first().length == sum(range(1, 11))
    (tmp_path / "f.sfs").write_text(text.format("folded"))
    assert as_dict(read_dadi(spark, str(tmp_path / "f.sfs"))) == as_dict(s.fold())
    (tmp_path / "n.sfs").write_text("3 4 unfolded\n" + " ".join(map(str, bins)) + "\n" + " ".join(map(str, mask)) + "\n")
    assert read_dadi(spark, str(tmp_path / "n.sfs")).pops == ("pop0", "pop1")


def test_fold_is_idempotent_and_keeps_counts(spark):
    s = spectrum(spark, SAMPLE, ("A", "B"))
    once = s.fold()
    assert once.fold().equals(once)
    assert once.n_snps().first() == s.n_snps().first()
    # (1,2),(2,0): the ancestral vector sorts first, so it is swapped although the global minor allele differs.
    assert (2, (2, 0), (1, 2)) in as_dict(once)


def site_table(spark, n=400, position="double(id div 7)"):
    df = spark.range(n).selectExpr(
        "concat('c', id % 3) as chrom", f"{position} as pos", "int(id % 4) as ad", "int(3 - id % 4) as aa",
        "int((id div 4) % 3) as bd", "int(2 - (id div 4) % 3) as ba", "int(id % 2) as cd", "int(id % 5 % 2) as ca",
    )
    return SiteTable.from_counts(df, ("A", "B", "C"), ["aa", "ba", "ca"], ["ad", "bd", "cd"], "chrom", "pos", length=900.0)


def test_subset_then_extract_is_extract_then_subset(spark):
    # Without repeated positions the order of sites does not depend on their configurations.
    t = site_table(spark, position="double(id)")
    first = t.subset_populations(["C", "A"]).extract_blocks(7)
    second = t.extract_blocks(7).subset_populations(["C", "A"])
    assert first.equals(second)


def test_blocks_match_a_plain_count(spark):
    t = site_table(spark)
    listed = sorted((r.chrom_id, r.position, list(r.anc), list(r.der)) for r in t.df.collect())
    want: dict = {}
    for i, (_, _, anc, der) in enumerate(listed):
        if sum(anc) and sum(der):
            key = (int(i // (len(listed) / 7)), tuple(anc), tuple(der))
            want[key] = want.get(key, 0) + 1
    assert as_dict(t.extract_blocks(7)) == want


def test_hot_key_does_not_break_blocks(spark):
    df = spark.range(3000).selectExpr(
        "'c' as chrom", "if(id % 3 < 2, 5D, double(id)) as pos", "1 as aa", "1 as ad", "2 as ba", "0 as bd"
    )
    s = SiteTable.from_counts(df, ("A", "B"), ["aa", "ba"], ["ad", "bd"], "chrom", "pos").extract_blocks(10)
    assert [r.n_snps for r in s.n_snps(by_block=True).orderBy("block").collect()] == [300.0] * 10


def test_blocks_keep_missing_positions_and_chromosomes(spark):
    df = spark.range(2000).selectExpr(
        "if(id % 7 = 0, null, concat('c', string(id % 3))) as chrom",
        "case when id % 10 = 0 then null when id % 11 = 0 then double('nan') else double(id * 37 % 501) end as pos",
        "int(id % 3) as aa", "int(2 - id % 2) as ad",
    )
    t = SiteTable.from_counts(df, ("A",), ["aa"], ["ad"], "chrom", "pos")
    listed = sorted(
        (r.chrom_id is not None, r.chrom_id or "", r.position is not None, r.position != r.position, 0 if r.position != r.position else r.position or 0, list(r.anc), list(r.der))
        for r in t.df.collect()
    )
    want: dict = {}
    for i, row in enumerate(listed):
        if row[5][0] and row[6][0]:
            key = (int(i // (len(listed) / 9)), tuple(row[5]), tuple(row[6]))
            want[key] = want.get(key, 0) + 1
    assert as_dict(t.extract_blocks(9)) == want


def test_runs_over_bucket_edges(spark, monkeypatch):
    import freqloom.operators.sites as sites_module

    monkeypatch.setattr(sites_module, "RUN_BUCKET", 7)
    df = spark.range(100).selectExpr("if(id between 30 and 50, null, string(id div 14)) as chrom", "double(id) as pos", "1 as aa", "int(1 + id % 2) as ad")
    got = as_dict(SiteTable.from_counts(df, ("A",), ["aa"], ["ad"], "chrom", "pos").extract_by_runs("position"))
    want: dict = {}
    block, last = -1, "none"
    for i in range(100):
        chrom = None if 30 <= i <= 50 else str(i // 14)
        block, last = block + (chrom != last), chrom
        key = (block, (1,), (1 + i % 2,))
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_down_sampling_does_not_depend_on_partitions(spark):
    t = site_table(spark)
    draws = [
        sorted(map(str, SiteTable(t.df.repartition(k), t.pops, t.book).down_sample({"A": 1, "B": 2}, seed=5).df.collect()))
        for k in (1, 7)
    ]
    assert draws[0] == draws[1]


def test_quotes_in_population_names(spark):
    t = site_table(spark)
    named = SiteTable(t.df, ("d'or", "a_b", "c\\d"), t.book)
    s = named.extract_blocks(3)
    assert {r.pop for r in s.p_missing().collect()} == {"d'or", "a_b", "c\\d"}
    stats = SpectrumStats(s, {"d'or": 1, "a_b": 1, "c\\d": 1})
    assert stats.summary({"it's": stats.f2("d'or", "a_b")}).first().stat == "it's"


def test_two_user_weights_keep_apart(spark):
    s = site_table(spark).extract_blocks(3).materialised()
    n = dict(zip(s.pops, s.sampled_n))
    stats = SpectrumStats(s)
    first, second = ({s.pops[0]: [float(k) for k in range(n[s.pops[0]] + 1)]}, {s.pops[0]: [1.0] * (n[s.pops[0]] + 1)})
    both = {r.stat: r.est for r in stats.summary({"x": stats.tensor_prod(first), "y": stats.tensor_prod(second)}).collect()}
    alone = SpectrumStats(s)
    assert both["x"] == pytest.approx(alone.summary({"x": alone.tensor_prod(first)}).first().est)
    assert both["y"] == pytest.approx(1.0) and both["x"] != pytest.approx(both["y"])


def test_errors_are_null_where_a_block_leaves_nothing(spark):
    rows = spark.createDataFrame([(0, [1, 1], [1, 1], 2.0), (1, [1, 1], [1, 1], 1.0), (2, [1, 2], [1, 0], 1.0)], "block long, anc array<int>, der array<int>, cnt double")
    s = Spectrum.from_rows(rows, ("A", "B"))
    stats = SpectrumStats(s)
    ratio = stats.ordered_prob({"A": [1], "B": [1]}) / stats.ordered_prob({"A": [0], "B": [0]}).apply(lambda x: f"nullif({x}, {x})")
    row = stats.summary({"r": ratio}).first()
    assert row.sd is None and row.bias is None


def test_concatenate_checks_and_sums(spark):
    t = site_table(spark)
    both = SiteTable.concatenate([t, t])
    assert both.book.first().asDict() == {"length": 1800.0, "n_read": 800, "n_excluded": 0}
    assert both.equals(SiteTable.concatenate([t, t])) and not both.equals(t)
    with pytest.raises(ValueError):
        SiteTable.concatenate([t, t.subset_populations(["B", "A", "C"])])


def test_down_sample(spark):
    t = site_table(spark, 4000)
    d = t.down_sample({"A": 2}, seed=3)
    assert {tuple(r) for r in d.df.selectExpr("anc[0] + der[0]").distinct().collect()} == {(2,)}
    # The hypergeometric mean of the derived count is 2/3 of the original one.
    mean = d.df.selectExpr("avg(der[0])").first()[0]
    assert abs(mean - 1.0) < 0.05
    assert t.df.selectExpr("sum(der[1])").first() == d.df.selectExpr("sum(der[1])").first()


def test_validation(spark):
    s = spectrum(spark, SAMPLE, ("A", "B"))
    assert s.validated() is s
    with pytest.raises(ValueError, match="config_exceeds_sampled_n"):
        s.with_sampled_n((2, 2)).validated()
    with pytest.raises(ValueError, match="monomorphic"):
        spectrum(spark, {(0, (0, 0), (1, 1)): 1, (0, (1, 1), (1, 1)): 1}, ("A", "B")).validated()


def test_config_builders(spark):
    listed = full_configs(spark, ("A", "B"), (3, 2)).count()
    assert listed == 4 * 3 - 2
    asc = full_configs(spark, ("A", "B"), (3, 2), non_ascertained=["B"]).count()
    assert asc == 2 * 3
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert configs_from_derived(df, ["a", "b"], (3, 2)).select(config_key()).first()[0] == "2,1\t0,2"


def test_subsample_probability_is_hypergeometric(spark):
    s = spectrum(spark, {(0, (5, 2), (3, 4)): 1}, ("A", "B"))
    got = s.df.selectExpr(subsample_probability_text(("A", "B"), (2, 1), (1, 2))).first()[0]
    want = comb(5, 2) * comb(3, 1) / comb(8, 3) * comb(2, 1) * comb(4, 2) / comb(6, 3)
    assert abs(got - want) < 1e-12


def test_large_subsets_use_the_fold(spark):
    s = spectrum(spark, {(0, (20, 10), (10, 20)): 2, (1, (15, 16), (15, 14)): 1}, ("A", "B"))
    unrolled = SpectrumStats(s, {"A": 2, "B": 2})
    folded = SpectrumStats(s, {"A": 30, "B": 30})
    get = lambda st: st.summary({"d": st.ordered_prob({"A": [1], "B": [0]})}).first().est
    exact = (2 * (10 / 30) * (10 / 30) + (15 / 30) * (16 / 30)) / 3
    assert abs(get(folded) - exact) < 1e-9
    assert 0 < get(unrolled) < 1


def test_jackknife_of_formula_is_formula_of_jackknifes(spark):
    st = SpectrumStats(spectrum(spark, SAMPLE, ("A", "B")), {"A": 2, "B": 1})
    x, y = st.ordered_prob({"A": [1], "B": [0]}), st.ordered_prob({"A": [0, 1]})
    wide = st.leave_one_out({"x": x, "y": y, "f": (2 * x + 1) / (1 - y)}).groupBy("block").pivot("stat").agg(F.first("jack"))
    for r in wide.collect():
        assert abs(r.f - (2 * r.x + 1) / (1 - r.y)) < 1e-12


def test_non_ascertained_population(spark):
    s = spectrum(spark, {(0, (1, 0), (1, 2)): 2, (0, (1, 1), (1, 1)): 3}, ("A", "B"), non_ascertained=["B"])
    st = SpectrumStats(s)
    assert st.summary({"n": st.denom}).first().est == 5.0
    with pytest.raises(ValueError):
        SpectrumStats(s, {"A": 1, "B": 2})


def test_bootstrap(spark):
    s = spectrum(spark, SAMPLE, ("A", "B")).materialised()
    b = bootstrap(s, 4, seed=2)
    assert {r.k for r in b.groupBy("replicate").agg(F.count_distinct("slot").alias("k")).collect()} == {3}
    total = lambda df: {r.replicate: r.t for r in df.groupBy("replicate").agg(F.sum("cnt").alias("t")).collect()}
    assert total(b) == total(bootstrap_totals(s, 4, seed=2))


def test_minibatches_partition_the_snps(spark):
    s = spectrum(spark, SAMPLE, ("A", "B"))
    parts = minibatches(s, 4, seed=1)
    again = parts.groupBy("anc", "der").agg(F.sum("cnt").alias("cnt")).selectExpr("bigint(0) as block", "anc", "der", "cnt")
    assert Spectrum.from_rows(again, ("A", "B")).equals(s.combined())


def test_tensor_product_refuses_missing_calls(spark):
    s = spectrum(spark, {(0, (1, 1), (1, 1)): 1, (0, (1, 0), (1, 1)): 1}, ("A", "B"))
    with pytest.raises(Exception, match="without missing calls"):
        s.tensor_product({"x": {}}).collect()
