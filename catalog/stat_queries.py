"""Spectrum statistics: heterozygosity, missingness, entropies, subsets and jackknifed statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    LONG_SQL, POPS, SAMPLED_N, SFS_SQL, TOTAL_SQL, blocks, combined, comb_sql, key_sql, r, r_sql, sites, table,
)
from freqloom.functions.configs import config_key
from freqloom.operators.calls import count_alleles, map_samples
from freqloom.operators.spectrum import Spectrum
from freqloom.operators.stats import SpectrumStats, count_subsets_text, subsample_probability_text, subsample_table

HET = "2.0 * anc * der / greatest((anc + der) * (n - 1), 1)"


@query("a10_hets", f"""with {SFS_SQL}, {LONG_SQL} select block, pop, {r_sql(f"sum(cnt * {HET})", 6)} as hets from long group by all""")
def hets(spark, sf):
    return blocks(spark, sf).pairwise_hets().select("block", "pop", r("hets", 6).alias("hets"))


@query("a11_p_missing", f"""with {SFS_SQL}, {LONG_SQL}, t as (select *, a_anc+b_anc+c_anc+d_anc as ta, a_der+b_der+c_der+d_der as td from long),
 v as (select pop, sum(case when n-anc-der >= 1 and ta > 0 and td > 0 then cnt*(n-anc-der) else 0 end) as m,
   sum(case when anc >= 1 and ta > 1 and td > 0 then cnt*anc else 0 end) as a,
   sum(case when der >= 1 and ta > 0 and td > 1 then cnt*der else 0 end) as d from t group by pop)
 select pop, {r_sql("m / (m + a + d)")} as p_missing from v""")
def p_missing(spark, sf):
    return combined(spark, sf).p_missing().select("pop", r("p_missing").alias("p_missing"))


@query("a12_entropy", f"""with {TOTAL_SQL}, n as (select sum(cnt) as n from tot),
 m as (select sum(cnt) as m from tot group by a_anc+a_der, b_anc+b_der, c_anc+c_der, d_anc+d_der)
 select {r_sql("(select sum(cnt / n * ln(cnt / n)) from tot, n) + (select sum(m / n * ln(n / m)) from m, n)")} as neg_entropy""")
def entropy(spark, sf):
    return combined(spark, sf).negative_entropy().select(r("neg_entropy").alias("neg_entropy"))


@query("a13_poisson_entropy", f"""with {SFS_SQL}, b as (select sum(cnt) as x from sfs group by block)
 select {r_sql("sum(-x + x * ln(x) - lgamma(x + 1))", 5)} as entropy from b where x > 0""")
def poisson_entropy(spark, sf):
    return blocks(spark, sf).poisson_entropy().select(r("entropy", 5).alias("entropy"))


@query("a14_pairwise_entropy", f"""with {SFS_SQL}, {LONG_SQL}, h as (select block, pop, max(n) as n, sum(cnt * {HET}) as x from long group by all)
 select {r_sql("sum((-x + x * ln(x) - lgamma(x + 1)) * n / 14.0)", 5)} as entropy from h where x > 1e-16""")
def pairwise_entropy(spark, sf):
    return blocks(spark, sf).pairwise_poisson_entropy().select(r("entropy", 5).alias("entropy"))


@query("a15_integrate", f"""with {SFS_SQL} select block, {r_sql("sum(cnt / (a_der + b_der + c_der + d_der))", 6)} as value from sfs group by block""")
def integrate(spark, sf):
    """Weight 1 / (derived alleles) per configuration."""
    s = blocks(spark, sf).materialised()
    weights = s.configs().selectExpr("anc", "der", "1D / aggregate(der, 0, (t, d) -> t + d) as w")
    return s.integrate(weights, by_block=True).select("block", r("value", 6).alias("value"))


@query("a16_tensor_prod", f"""with {TOTAL_SQL}, x as (select * from tot where a_anc + b_anc + d_anc > 0 and a_der + b_der + d_der > 0)
 select 'product' as row, {r_sql("sum(cnt * a_der / 4.0 * (1 - b_der / 4.0) * (d_der / 2.0) * (d_der / 2.0))", 6)} as value from x
 union all select 'first_only', {r_sql("sum(cnt * a_der / 4.0)", 6)} from x
 union all select 'total', {r_sql("sum(cnt)", 6)} from x""")
def tensor_prod(spark, sf):
    """Over a, b and d, which have no missing calls."""
    s = combined(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2))
    ramp = [d / 4.0 for d in range(5)]
    rows = {
        "product": {"a": ramp, "b": [1 - x for x in ramp], "d": [0.0, 0.25, 1.0]},
        "first_only": {"a": ramp},
        "total": {},
    }
    return s.tensor_product(rows).select("row", r("value", 6).alias("value"))


@query("a17_effective_length", """with s as (select count(*) filter (p_size % 4 not in (0, 1)) as x, count(*) as n from part)
 select round(x / n, 9) + 0.0 as p_excluded, round(1e6 * (1 - x / n), 6) + 0.0 as effective_length from s""")
def effective_length(spark, sf):
    """Accounting of ancestral-allele exclusions over parts, with a known length of 1e6 bases."""
    from catalog.views import sites, table
    from freqloom.operators.sites import SiteTable

    book = table(spark, sf, "part").agg(
        F.lit(1e6).alias("length"),
        F.count_if(F.expr("p_size % 4 in (0, 1)")).alias("n_read"),
        F.count_if(F.expr("p_size % 4 not in (0, 1)")).alias("n_excluded"),
    )
    t = sites(spark, sf)
    out = SiteTable(t.df, t.pops, book).excluded_fraction()
    return out.select(r("p_excluded").alias("p_excluded"), r("effective_length", 6).alias("effective_length"))


A20_SQL = " * ".join([
    "(" + " + ".join(f"{w} * {comb_sql('a_anc', str(3 - d))} * {comb_sql('a_der', str(d))}" for d, w in enumerate((0.5, 0.0, 2.0, 1.0))) + ")",
    comb_sql("c_anc + c_der", "2"),
])


@query("a20_count_subsets", f"""with {TOTAL_SQL} select {key_sql()} as config, {r_sql(A20_SQL)} as n_subsets from tot""")
def subsets(spark, sf):
    """Three alleles of a, weighted by derived count, and two of c."""
    value = count_subsets_text(POPS, {"a": (0.5, 0.0, 2.0, 1.0)}, {"a": 3, "c": 2})
    return combined(spark, sf).df.select(config_key().alias("config"), r(value).alias("n_subsets"))


A21_SQL = (
    f"{comb_sql('a_anc', '1')} * {comb_sql('a_der', '1')} * {comb_sql('c_anc', '2')} * {comb_sql('c_der', '2')}"
    f" / ({comb_sql('a_anc + a_der', '2')} * {comb_sql('c_anc + c_der', '4')})"
)


@query("a21_subsample_probs", f"""with {TOTAL_SQL} select {key_sql()} as config,
 {r_sql(f"case when c_anc + c_der < 4 then 0.0 else {A21_SQL} end")} as prob from tot""")
def subsample_probs(spark, sf):
    """One of each allele from a and two of each from c; 0 where c has fewer than four calls."""
    prob = subsample_probability_text(POPS, (1, 0, 2, 0), (1, 0, 2, 0))
    return combined(spark, sf).df.select(config_key().alias("config"), r(prob).alias("prob"))


A22_PROB_SQL = " * ".join(
    f"({comb_sql(f'{p}_anc', f's{p}_anc')} * {comb_sql(f'{p}_der', f's{p}_der')} / {comb_sql(f'{p}_anc + {p}_der', f's{p}_anc + s{p}_der')})"
    for p in POPS
)


@query("a22_subsample_enum", f"""with {TOTAL_SQL}, g as (select t1.x as sa_anc, t2.x as sa_der, t3.x as sb_anc, t4.x as sb_der, t5.x as sc_anc,
   t6.x as sc_der, t7.x as sd_anc, t8.x as sd_der
  from range(4) t1(x), range(4) t2(x), range(4) t3(x), range(4) t4(x), range(4) t5(x), range(4) t6(x), range(4) t7(x), range(4) t8(x)
  where t1.x+t2.x+t3.x+t4.x+t5.x+t6.x+t7.x+t8.x = 3 and t1.x+t3.x+t5.x+t7.x > 0 and t2.x+t4.x+t6.x+t8.x > 0 and t7.x + t8.x <= 2),
 p as (select {key_sql()} as config, concat_ws(chr(9), sa_anc || ',' || sa_der, sb_anc || ',' || sb_der, sc_anc || ',' || sc_der,
   sd_anc || ',' || sd_der) as subconfig, {A22_PROB_SQL} as prob from tot, g)
 select config, subconfig, {r_sql("prob")} as prob from p where prob > 0""")
def subsample_enum(spark, sf):
    out = subsample_table(combined(spark, sf), 3)
    sub = config_key("sub_anc", "sub_der")
    return out.select(config_key().alias("config"), sub.alias("subconfig"), r("prob").alias("prob"))


# ---- jackknifed statistics --------------------------------------------------------------------------------------

# With all alleles of every population only complete configurations count, and each is its own single subset.
FULL_SQL = f"""{SFS_SQL}, f as (select block, cnt * (case when c_anc + c_der = 4 then 1 else 0 end) as w,
   a_der / 4.0 as pa, b_der / 4.0 as pb, c_der / 4.0 as pc, d_der / 2.0 as pd,
   a_der * (4 - a_der) / 12.0 as ha, b_der * (4 - b_der) / 12.0 as hb,
   a_der * (a_der - 1) / 12.0 as aa, (4 - a_der) * (3 - a_der) / 12.0 as a0a0,
   b_der * (b_der - 1) / 12.0 as bb, (4 - b_der) * (3 - b_der) / 12.0 as b0b0,
   c_der * (c_der - 1) / 12.0 as cc, (4 - c_der) * (3 - c_der) / 12.0 as c0c0, c_der * (4 - c_der) / 12.0 as hc,
   d_der * (d_der - 1) / 2.0 as dd, (2 - d_der) * (1 - d_der) / 2.0 as d0d0, d_der * (2 - d_der) / 2.0 as hd from sfs)"""


def jack_sql(base: str, terms: dict[str, str], stats: dict[str, str]) -> str:
    """Per block sums of ``terms``, then ``stats`` on totals and on totals without the block."""
    sums = ", ".join(f"sum(w * ({t})) as {n}" for n, t in terms.items())
    loo = ", ".join(f"sum({n}) over () - {n} as {n}" for n in terms)
    tot = ", ".join(f"sum({n}) as {n}" for n in terms)
    picks = lambda src: " union all ".join(
        f"select '{s}' as stat, block, {e} as v from {src}" for s, e in stats.items()
    )
    return f"""with {base}, s as (select block, {sums} from f group by block), l as (select block, {loo} from s),
 t as (select null as block, {tot} from s), e as ({picks("t")}), j as ({picks("l")}),
 jk as (select j.stat, j.block, e.v as est, j.v as jack from j join e using (stat))"""


SUMMARY_SQL = f"""select stat, {r_sql("max(est)")} as est, {r_sql("sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1))")} as sd,
 {r_sql("avg(jack - est) * (count(*) - 1)")} as bias, {r_sql("max(est) / sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1))", 5)} as z
 from jk group by stat"""


def summarise(stats: SpectrumStats, wanted: dict) -> object:
    out = stats.summary(wanted)
    return out.select("stat", r("est").alias("est"), r("sd").alias("sd"), r("bias").alias("bias"), r("z", 5).alias("z"))


def register_stat(name: str, terms: dict[str, str], exprs: dict[str, str], build, doc: str):
    """A summary query for statistics whose SQL terms are given over the full-sample table."""
    sql = jack_sql(FULL_SQL, {**terms, "den": "1"}, exprs) + SUMMARY_SQL

    @query(name, sql)
    def run(spark, sf):
        stats = SpectrumStats(blocks(spark, sf))
        return summarise(stats, build(stats))

    run.__doc__ = doc
    return run


F4_TERMS = {
    "baba": "pa * pc * (1 - pb) * (1 - pd) + (1 - pa) * (1 - pc) * pb * pd",
    "abba": "pb * pc * (1 - pa) * (1 - pd) + (1 - pb) * (1 - pc) * pa * pd",
    "baba0": "pa * pc * (1 - pb)",
    "abba0": "pb * pc * (1 - pa)",
}

register_stat(
    "t1_ordered_prob",
    {"x": "pa * (1 - pb)", "y": "pa * (1 - pb) + (1 - pa) * pb", "z": "hc * hd", "q": "a0a0 * pd"},
    {"a1_b0": "x / den", "a1_b0_folded": "y / den", "c01_d01": "z / den", "a00_d1": "q / den"},
    lambda s: {
        "a1_b0": s.ordered_prob({"a": [1], "b": [0]}),
        "a1_b0_folded": s.ordered_prob({"a": [1], "b": [0]}, fold=True),
        "c01_d01": s.ordered_prob({"c": [0, 1], "d": [0, 1]}),
        "a00_d1": s.ordered_prob({"a": [0, 0], "d": [1]}),
    },
    "Ordered sample probabilities.",
)
register_stat(
    "t6_abba_baba", F4_TERMS,
    {"baba": "baba / den", "abba": "abba / den", "baba0": "baba0 / den", "abba0": "abba0 / den"},
    lambda s: {
        "baba": s.baba("a", "b", "c", "d"), "abba": s.abba("a", "b", "c", "d"),
        "baba0": s.baba("a", "b", "c"), "abba0": s.abba("a", "b", "c"),
    },
    "BABA and ABBA with an outgroup and with the ancestral allele.",
)
register_stat(
    "t7_f4", F4_TERMS, {"f4": "baba / den - abba / den", "f4_root": "baba0 / den - abba0 / den"},
    lambda s: {"f4": s.f4("a", "b", "c", "d"), "f4_root": s.f4("a", "b", "c")}, "f4 with jackknife errors.",
)
register_stat(
    "t8_log_ratio", F4_TERMS, {"log_abba_baba": "ln(baba / den) - ln(abba / den)"},
    lambda s: {"log_abba_baba": s.log_abba_baba("a", "b", "c", "d")}, "ln BABA - ln ABBA.",
)
register_stat(
    "t9_fst",
    {"h1": "2 * ha", "h2": "2 * hb", "bt": "pa * (1 - pb) + (1 - pa) * pb"},
    {"fst": "(bt / den - (h1 / den + h2 / den) / 2) / (bt / den)"},
    lambda s: {"fst": s.f_st("a", "b")}, "F_ST of a and b.",
)
register_stat(
    "t10_f3",
    {"baba": "c0c0 * pa * pb + cc * (1 - pa) * (1 - pb)", "abba": "hc * pa * (1 - pb) + hc * (1 - pa) * pb"},
    {"f3": "(baba - abba) / den"}, lambda s: {"f3": s.f3("a", "b", "c")}, "f3(c; a, b).",
)
register_stat(
    "t11_f2", {"baba": "aa * b0b0 + a0a0 * bb", "abba": "2 * ha * hb"}, {"f2": "(baba - abba) / den"},
    lambda s: {"f2": s.f2("a", "b")}, "f2(a, b).",
)
register_stat(
    "t12_d", F4_TERMS, {"d": "(baba - abba) / (baba + abba)", "d_root": "(baba0 - abba0) / (baba0 + abba0)"},
    lambda s: {"d": s.pattersons_d("a", "b", "c", "d"), "d_root": s.pattersons_d("a", "b", "c")}, "Patterson's D.",
)
register_stat(
    "t13_greens_f",
    {**F4_TERMS, "bc": "pa * (1 - pc) * pc", "baba2": "pa * hc * (1 - pd) + (1 - pa) * hc * pd",
     "abba2": "cc * (1 - pa) * (1 - pd) + c0c0 * pa * pd"},
    {"greens_f": "(baba - abba) / (baba2 - abba2)"}, lambda s: {"greens_f": s.greens_f("a", "b", "c", "d")}, "Green's f.",
)
register_stat(
    "t14_f4_ratio",
    # x = d here: f4(d, c, a) / f4(b, c, a), ancestral allele as outgroup
    {"n1": "pd * pa * (1 - pc)", "n2": "pc * pa * (1 - pd)", "m1": "pb * pa * (1 - pc)", "m2": "pc * pa * (1 - pb)"},
    {"f4_ratio": "(n1 - n2) / (m1 - m2)"}, lambda s: {"f4_ratio": s.f4_ratio("a", "b", "c", "d")}, "f4 ratio.",
)

SINGLE = {
    "sa": "pa*(1-pb)*(1-pc)*(1-pd) + (1-pa)*pb*pc*pd", "sb": "pb*(1-pa)*(1-pc)*(1-pd) + (1-pb)*pa*pc*pd",
    "sc": "pc*(1-pa)*(1-pb)*(1-pd) + (1-pc)*pa*pb*pd", "sd": "pd*(1-pa)*(1-pb)*(1-pc) + (1-pd)*pa*pb*pc",
}
register_stat(
    "t15_singletons", SINGLE,
    {"a": "sa/den", "b": "sb/den", "c": "sc/den", "d": "sd/den", "denom": "1 - (sa + sb + sc + sd)/den"},
    lambda s: s.singleton_probs(POPS), "Chance that one population alone differs.",
)
register_stat(
    "t18_errors", F4_TERMS,
    {"f4": "(baba - abba)/den", "d": "(baba - abba)/(baba + abba)", "log": "ln(baba/den) - ln(abba/den)"},
    lambda s: {"f4": s.f4("a", "b", "c", "d"), "d": s.pattersons_d("a", "b", "c", "d"), "log": s.log_abba_baba("a", "b", "c", "d")},
    "Errors of three statistics from one scan.",
)
register_stat(
    "t19_arithmetic", F4_TERMS,
    {"combo": "(2 * baba / den - abba / den) * 3 + 1", "power": "power(baba / den, 2) / (1 - abba / den)",
     "applied": "sqrt(baba / den)", "neg": "-(baba / den)", "rsub": "1 - baba / den", "rdiv": "1 / (baba / den)"},
    lambda s: {
        "combo": (2 * s.baba("a", "b", "c", "d") - s.abba("a", "b", "c", "d")) * 3 + 1,
        "power": s.baba("a", "b", "c", "d") ** 2 / (1 - s.abba("a", "b", "c", "d")),
        "applied": s.baba("a", "b", "c", "d").apply("sqrt"), "neg": -s.baba("a", "b", "c", "d"),
        "rsub": 1 - s.baba("a", "b", "c", "d"), "rdiv": 1 / s.baba("a", "b", "c", "d"),
    },
    "Arithmetic of statistics keeps their jackknife.",
)
register_stat(
    "t22_user_weights", {"u": "(4 * pa) * (1 - pb * pb)", "v": "case pd when 0 then 0.5 when 0.5 then 2.0 else 1.0 end"},
    {"user_ab": "u / den", "user_d": "(v - (case when 1 = 1 then 0 else 0 end)) / den"},
    lambda s: {
        "user_ab": s.tensor_prod({"a": [0, 1, 2, 3, 4], "b": [1 - (d / 4) ** 2 for d in range(5)]}, "ab"),
        "user_d": s.tensor_prod({"d": [0.5, 2.0, 1.0]}, "d"),
    },
    "User weight vectors, normalised.",
)


register_stat(
    "t22_two_weights", {"u": "4 * pa", "v": "case when pa in (0.25, 0.75) then 2.0 else 1.0 end"}, {"slope": "u / den", "waves": "v / den"},
    lambda s: {"slope": s.tensor_prod({"a": [0, 1, 2, 3, 4]}), "waves": s.tensor_prod({"a": [1, 2, 1, 2, 1]})},
    "Two weight vectors without names in one summary.",
)


@query("t18_null_jack", f"""with {FULL_SQL}, k as (select * from f where block = 0 or pa = 0)
 select 'ratio' as stat, {r_sql("sum(w * pb) / sum(w * pa)")} as est, cast(null as double) as sd, cast(null as double) as bias,
  cast(null as double) as z from k""")
def undefined_without_a_block(spark, sf):
    """Derived alleles of a in block 0 only: without it the ratio is undefined, so it has no errors."""
    whole = blocks(spark, sf).materialised()
    s = SpectrumStats(Spectrum(whole.df.where("block = 0 or der[0] = 0"), POPS, whole.meta, (), False, SAMPLED_N))
    out = s.summary({"ratio": s.ordered_prob({"b": [1]}) / s.ordered_prob({"a": [1]})})
    return out.select("stat", r("est").alias("est"), "sd", "bias", "z")


@query("a11_p_missing_sites", f"""with {TOTAL_SQL}, sfs as (select 0 as block, * from tot), {LONG_SQL},
 t as (select *, a_anc+b_anc+c_anc+d_anc as ta, a_der+b_der+c_der+d_der as td from long),
 v as (select pop, sum(case when n-anc-der >= 1 and ta > 0 and td > 0 then cnt*(n-anc-der) else 0 end) as m,
   sum(case when anc >= 1 and ta > 1 and td > 0 then cnt*anc else 0 end) as a,
   sum(case when der >= 1 and ta > 0 and td > 1 then cnt*der else 0 end) as d from t group by pop)
 select pop, {r_sql("m / (m + a + d)")} as p_missing from v""")
def p_missing_of_sites(spark, sf):
    return sites(spark, sf).p_missing().select("pop", r("p_missing").alias("p_missing"))


@query("t2_tensor_blocks", f"""with {FULL_SQL} select block, {r_sql("sum(w * pa * (1 - pb))", 6)} as a1_b0, {r_sql("sum(w)", 6)} as denom
 from f group by rollup(block)""")
def tensor_blocks(spark, sf):
    """Per block and total sums of a term, before normalisation."""
    s = SpectrumStats(blocks(spark, sf))
    stat = s.ordered_prob({"a": [1], "b": [0]})
    names = {n: ("denom" if n == "denom" else "a1_b0") for n in stat.terms}
    sums = s.term_sums(stat.terms)
    return sums.rollup("block").agg(*[r(F.sum(n), 6).alias(alias) for n, alias in names.items()])


@query("t3_jackknife", jack_sql(FULL_SQL, {**F4_TERMS, "den": "1"}, {"f4": "baba/den - abba/den"})
       + f"select stat, block, {r_sql('est')} as est, {r_sql('jack')} as jack from jk")
def jackknife(spark, sf):
    s = SpectrumStats(blocks(spark, sf))
    return s.leave_one_out({"f4": s.f4("a", "b", "c", "d")}).select("stat", "block", r("est").alias("est"), r("jack").alias("jack"))


@query("t4_denom", f"""with {FULL_SQL} select {r_sql("sum(w)", 6)} as n_subsets, count(distinct block) as n_blocks from f""")
def denom(spark, sf):
    s = SpectrumStats(blocks(spark, sf))
    out = s.summary({"n": s.denom})
    return out.select(r("est", 6).alias("n_subsets"), "n_blocks")


@query("t5_count_1100", jack_sql(FULL_SQL, {"x": "pa*pb*(1-pc)", "y": "pa*pb*(1-pc)*(1-pd) + (1-pa)*(1-pb)*pc*pd", "den": "1"},
                                 {"root": "x/den", "outgroup": "y/den"}) + SUMMARY_SQL)
def count_1100(spark, sf):
    s = SpectrumStats(blocks(spark, sf))
    return summarise(s, {"root": s.count_1100("a", "b", "c"), "outgroup": s.count_1100("a", "b", "c", "d")})


PAIR_COLUMNS = f"""select split_part(stat, '|', 1) as pop1, split_part(stat, '|', 2) as pop2, cast(0.0 as double) as expected, {r_sql("max(est)")} as observed,
 {r_sql("max(est) / sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1))", 5)} as z from jk group by stat"""


def pair_columns(df):
    return df.select("pop1", "pop2", "expected", r("observed").alias("observed"), r("z", 5).alias("z"))


IBS_TERMS = {"a|a": "a0a0 + aa", "b|b": "b0b0 + bb", "c|c": "c0c0 + cc", "d|d": "d0d0 + dd"} | {
    f"{x}|{y}": f"p{x} * p{y} + (1 - p{x}) * (1 - p{y})" for x, y in combinations(POPS, 2)
}
IBS_NAMES = {f"x{i}": pair for i, pair in enumerate(IBS_TERMS)}


@query("t16_all_pairs_ibs", jack_sql(FULL_SQL, {**{n: IBS_TERMS[p] for n, p in IBS_NAMES.items()}, "den": "1"},
                                     {p: f"{n} / den" for n, p in IBS_NAMES.items()}) + PAIR_COLUMNS)
def all_pairs_ibs(spark, sf):
    return pair_columns(SpectrumStats(blocks(spark, sf)).all_pairs_ibs())


def f2_term(x: str, y: str) -> str:
    two = lambda p: f"{p}{p}"
    none = lambda p: f"{p}0{p}0"
    return f"{two(x)} * {none(y)} + {none(x)} * {two(y)} - 2 * h{x} * h{y}"


F2_PAIRS = {f"x{i}": pair for i, pair in enumerate(combinations(POPS, 2))}


@query("t17_all_f2", jack_sql(FULL_SQL, {**{n: f2_term(*p) for n, p in F2_PAIRS.items()}, "den": "1"},
                              {"|".join(p): f"{n} / den" for n, p in F2_PAIRS.items()}) + PAIR_COLUMNS)
def all_f2(spark, sf):
    return pair_columns(SpectrumStats(blocks(spark, sf)).all_f2())


NATIONS_SQL = """calls as (
  select (l_partkey - 1) // 20 as site, n_name as pop, case when l_linenumber = 7 then null else l_linenumber % 2 end as allele
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 f as (select s.site, n_name as pop, coalesce(a, 0)::double as a, coalesce(d, 0)::double as d from (select distinct site from calls) s cross join nation
   left join (select site, pop, count(*) filter (allele = 0) as a, count(*) filter (allele = 1) as d from calls group by all) c on c.site = s.site and c.pop = n_name),
 q as (select *, (a + d) * (a + d - 1) / 2 as s, coalesce(a * (a - 1) / nullif((a + d) * (a + d - 1), 0), 0) as q00, coalesce(d * (d - 1) / nullif((a + d) * (a + d - 1), 0), 0) as q11,
   coalesce(a * d / nullif((a + d) * (a + d - 1), 0), 0) as q01 from f),
 w as (select site, site % 10 as block, product(s) as w, product(s) - product(a * (a - 1) / 2) - product(d * (d - 1) / 2) as den from q group by site having sum(a) > 0 and sum(d) > 0),
 x as (select block, p.pop as pop1, r.pop as pop2, sum(w * (p.q11 * r.q00 + p.q00 * r.q11 - 2 * p.q01 * r.q01)) as x
   from q p join q r on r.site = p.site and p.pop < r.pop join w on w.site = p.site group by all),
 den as (select block, sum(den) as den from w group by block),
 jk as (select pop1 || '|' || pop2 as stat, sum(x) over p / sum(den) over p as est, (sum(x) over p - x) / (sum(den) over p - den) as jack
   from x join den using (block) window p as (partition by pop1, pop2))
"""


@query("t17_all_f2_many", f"with {NATIONS_SQL}" + PAIR_COLUMNS)
def all_f2_of_many(spark, sf):
    """The 25 nations as populations: 300 pairs as one vector per site, in one scan."""
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(
        "(l_partkey - 1) div 20 as site", "concat('s', o_custkey) as sample", "if(l_linenumber = 7, null, l_linenumber % 2) as allele"
    )
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    # 25 names at every scale.
    pops = tuple(row.n_name for row in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect())
    counted = count_alleles(map_samples(line, people.selectExpr("concat('s', c_custkey) as sample", "n_name as pop")), ["site"], pops)
    rows = counted.selectExpr("site % 10 as block", "n0 as anc", "n1 as der").where("exists(anc, x -> x > 0) and exists(der, x -> x > 0)")
    stats = SpectrumStats(Spectrum.from_rows(rows, pops), {p: 2 for p in pops})
    return pair_columns(stats.all_f2())


@query("t20_fit", jack_sql(FULL_SQL, {**F4_TERMS, "bt": "pa * (1 - pb) + (1 - pa) * pb", "den": "1"}, {"f4": "(baba - abba)/den", "diff": "bt/den"})
       + f""", x as (select * from (values ('f4', cast(0.001 as double)), ('diff', cast(0.5 as double))) as v(stat, expected))
 select stat, expected, {r_sql("max(est)")} as observed, {r_sql("sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1))")} as sd,
   {r_sql("(max(est) - expected) / sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1))", 4)} as z
 from jk join x using (stat) group by stat, expected""")
def fit(spark, sf):
    """Observed statistics against given expectations."""
    s = SpectrumStats(blocks(spark, sf))
    expected = spark.createDataFrame([("f4", 0.001), ("diff", 0.5)], "stat STRING, expected DOUBLE")
    out = s.summary({"f4": s.f4("a", "b", "c", "d"), "diff": s.ordered_prob({"a": [1], "b": [0]}, True)}, expected)
    return out.select("stat", "expected", r("est").alias("observed"), r("sd").alias("sd"), r("z", 4).alias("z"))


# Two alleles of a, b and c and one of d: sites with three calls in c count as well.
SMALL_SQL = f"""{SFS_SQL}, f as (select block, cnt as w, {comb_sql('a_anc + a_der', '2')} * {comb_sql('b_anc + b_der', '2')}
   * {comb_sql('c_anc + c_der', '2')} * (d_anc + d_der) as n_all,
   {comb_sql('a_anc', '2')} * {comb_sql('b_anc', '2')} * {comb_sql('c_anc', '2')} * d_anc as n_anc,
   {comb_sql('a_der', '2')} * {comb_sql('b_der', '2')} * {comb_sql('c_der', '2')} * d_der as n_der,
   a_der / 4.0 as pa, b_der / 4.0 as pb, c_der / cast(c_anc + c_der as double) as pc, d_der / 2.0 as pd from sfs)"""
SMALL_TERMS = {
    "baba": "n_all * (pa * pc * (1 - pb) * (1 - pd) + (1 - pa) * (1 - pc) * pb * pd)",
    "abba": "n_all * (pb * pc * (1 - pa) * (1 - pd) + (1 - pb) * (1 - pc) * pa * pd)",
    "one": "n_all * pc - n_der",
    "den": "n_all - n_anc - n_der",
}


@query("t21_small_n", jack_sql(SMALL_SQL, SMALL_TERMS, {"f4": "(baba - abba) / den", "d": "(baba - abba) / (baba + abba)", "c1": "one / den"})
       + SUMMARY_SQL)
def small_n(spark, sf):
    """Smaller subsamples use sites with missing calls too."""
    s = SpectrumStats(blocks(spark, sf), {"a": 2, "b": 2, "c": 2, "d": 1})
    return summarise(
        s, {"f4": s.f4("a", "b", "c", "d"), "d": s.pattersons_d("a", "b", "c", "d"), "c1": s.ordered_prob({"c": [1]})}
    )
