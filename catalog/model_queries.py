"""Demographic models as tables, expected spectra and scoring. Suppliers stand in for candidate models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    CONFIG, LONG_SQL, N_BLOCKS, POPS, SAMPLED_N, SFS_SQL, TOTAL_SQL, blocks, combined, comb_sql,
    key_sql, r, r_sql, sites, table,
)
from freqloom.functions.configs import config_key
from freqloom.functions.scalar import md5_uniform_text
from freqloom.functions.vectors import observation
from freqloom.operators.spectrum import Spectrum
from freqloom.operators.stats import SpectrumStats
from freqloom.plans.expected import Sweep, one_population_spectrum
from freqloom.plans.models import (
    Parameter, Template, bound_violations, draw_candidates, edges, epochs, lineages, resolve, scaled_parameters, unscaled_parameters, violations,
)
from freqloom.plans.scoring import (
    MutationData, attach, best_model, best_of, bootstrap_best, bootstrap_parameters, branch_length_report, composite_log_likelihood,
    expected_counts, full_log_likelihood, kl_divergence, model_fit, parameter_intervals, poisson_pairwise,
    poisson_total, sweep_log_likelihood, within_population_diversity,
)

N_E, GEN_TIME, MU = 10000.0, 25.0, 1e-8


def candidates(spark, sf):
    """One candidate per supplier: split and root times in years, sizes, pulse and growth."""
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey as model_id",
        "1000D * (1 + s_suppkey % 9) as t_ab", "20000D + 1000D * (s_suppkey % 5) as t_root",
        "5000D + 1000D * s_nationkey as n_a", "(1 + s_suppkey % 9) / 20D as p", "0.0001D * (s_suppkey % 3) as g",
        "s_acctbal as balance",
    )


CAND_SQL = """cand as (select s_suppkey as model_id, 1000.0::double * (1 + s_suppkey % 9) as t_ab,
   20000.0::double + 1000.0::double * (s_suppkey % 5) as t_root, 5000.0::double + 1000.0::double * s_nationkey as n_a,
   (1 + s_suppkey % 9) / 20.0::double as p, 0.0001::double * (s_suppkey % 3) as g, s_acctbal as balance from supplier),
 sc as (select model_id, t_ab / 1e6 as ta, t_root / 1e6 as tr, n_a / 1e4 as na, p, g * 1e6 as g from cand)"""


def with_pulse() -> Template:
    """a grows until half the split time, then sends a pulse into d; a joins b, b joins d."""
    t = Template(N_E, GEN_TIME, MU).add_leaf("a", n="n_a", g="g").add_leaf("b").add_leaf("d")
    t.set_size("a", "t_ab / 2", g=0)
    t.move_lineages("a", "d", "t_ab / 2", p="p")
    t.move_lineages("a", "b", "t_ab", n=20000)
    return t.move_lineages("b", "d", "t_root")


def tree() -> Template:
    t = Template(N_E, GEN_TIME, MU).add_leaf("a", n="n_a").add_leaf("b").add_leaf("d", n=3000)
    t.move_lineages("a", "b", "t_ab", n=20000)
    return t.move_lineages("b", "d", "t_root", n=N_E)


@query("m1_resolve", f"""with {CAND_SQL}, e as (
  select model_id, unnest([{{'seq': 0, 'kind': 'leaf', 'pop1': 'a', 't': 0.0::double, 'p': null::double, 'n': null::double, 'g': null::double}},
   {{'seq': 1, 'kind': 'leaf', 'pop1': 'b', 't': 0.0, 'p': null, 'n': null, 'g': null}},
   {{'seq': 2, 'kind': 'leaf', 'pop1': 'd', 't': 0.0, 'p': null, 'n': null, 'g': null}},
   {{'seq': 3, 'kind': 'size', 'pop1': 'a', 't': 0.0, 'p': null, 'n': na, 'g': null}},
   {{'seq': 4, 'kind': 'growth', 'pop1': 'a', 't': 0.0, 'p': null, 'n': null, 'g': 0.0}},
   {{'seq': 5, 'kind': 'growth', 'pop1': 'a', 't': 0.0, 'p': null, 'n': null, 'g': g}},
   {{'seq': 6, 'kind': 'growth', 'pop1': 'a', 't': ta / 2, 'p': null, 'n': null, 'g': 0.0}},
   {{'seq': 7, 'kind': 'size', 'pop1': 'b', 't': ta, 'p': null, 'n': 2.0, 'g': null}},
   {{'seq': 8, 'kind': 'growth', 'pop1': 'b', 't': ta, 'p': null, 'n': null, 'g': 0.0}},
   {{'seq': 9, 'kind': 'pulse', 'pop1': 'a', 't': ta / 2, 'p': p, 'n': null, 'g': null}},
   {{'seq': 10, 'kind': 'join', 'pop1': 'a', 't': ta, 'p': null, 'n': null, 'g': null}},
   {{'seq': 11, 'kind': 'join', 'pop1': 'b', 't': tr, 'p': null, 'n': null, 'g': null}}]) as e from sc)
 select model_id, cast(e.seq as bigint) as seq, e.kind as kind, e.pop1 as pop1, {r_sql("e.t")} as t, {r_sql("e.p")} as p,
  {r_sql("e.n")} as n, {r_sql("e.g")} as g from e""")
def resolved(spark, sf):
    """Parameters and expressions turned into scaled numbers."""
    e = resolve(candidates(spark, sf), with_pulse())
    return e.select("model_id", F.col("seq").cast("bigint").alias("seq"), "kind", "pop1", *[r(c).alias(c) for c in "tpng"])


def exponential_sql(u: str, low: str, high: str | None, scale: float) -> str:
    mass = "1.0" if high is None else f"(1 - exp(-(({high}) - ({low})) / {scale!r}::double))"
    return f"(({low}) - {scale!r}::double * ln(1 - {u} * {mass}))"


@query("m2_candidates", f"""with m as (select s_suppkey as model_id from supplier),
 u as (select model_id, {", ".join(f"('0x' || substr(md5(concat_ws('/', model_id, {i}, 5)), 1, 13))::BIGINT / 4503599627370496.0::double as u{i}" for i in range(6))} from m),
 a as (select *, {exponential_sql("u0", "1.0::double", "1e10::double", N_E)} as n0, {exponential_sql("u1", "0.0::double", "5e5::double", N_E * GEN_TIME)} as t0 from u),
 b as (select *, {exponential_sql("u2", "t0", None, N_E * GEN_TIME)} as t1, {exponential_sql("u3", "10.0::double", "t0", N_E * GEN_TIME)} as t2,
   0.1 + u4 * 0.8 as p0, -1e-3 + u5 * 2e-3 as g0 from a)
 select model_id, {r_sql("n0", 4)} as n0, {r_sql("t0", 4)} as t0, {r_sql("t1", 4)} as t1, {r_sql("t2", 4)} as t2, {r_sql("cast(p0 as double)")} as p0,
  {r_sql("cast(g0 as double)")} as g0, n0 >= 1 and t0 between 0 and 5e5 and t1 >= t0 and p0 between 0.1 and 0.9 and abs(g0) <= 1e-3 as in_bounds, true as restored from b""")
def random_candidates(spark, sf):
    """Random parameters from numbers that both engines make; they survive the transform to the unbounded scale and back."""
    t = Template(N_E, GEN_TIME).add_size_param("n0").add_time_param("t0", upper=5e5).add_time_param(
        "t1", lower_constraints=["t0"]
    ).add_time_param("t2", lower=10, upper_constraints=["t0"]).add_pulse_param("p0", lower=0.1, upper=0.9).add_growth_param("g0")
    models = table(spark, sf, "supplier").selectExpr("s_suppkey as model_id")
    drawn = draw_candidates(models, t, uniform=lambda i: md5_uniform_text("model_id", str(i), "5"))
    back = unscaled_parameters(scaled_parameters(drawn, t), t)
    names = [p.name for p in t.parameters]
    pairs = drawn.join(back.withColumnsRenamed({n: f"{n}_back" for n in names}), "model_id")
    close = " and ".join(f"abs({n} - {n}_back) <= 1e-6 * greatest(1D, abs({n}))" for n in names)
    bounds = "n0 >= 1 and n0 <= 1e10 and t0 >= 0 and t0 <= 5e5 and t1 >= t0 and p0 >= 0.1 and p0 <= 0.9 and abs(g0) <= 0.001"
    return pairs.selectExpr(
        "model_id", *[f"round({n}, {9 if n in ('p0', 'g0') else 4}) + 0D as {n}" for n in names], f"{bounds} as in_bounds", f"{close} as restored"
    )


EPOCH_SQL = f"""{CAND_SQL}, ep as (
  select model_id, 'a' as pop, 0 as node, 0.0::double as t, ta / 2 as tau, na as n, g from sc
  union all select model_id, 'a', 1, ta / 2, ta / 2, na * exp(-g * ta / 2), 0.0 from sc
  union all select model_id, 'b', 0, 0.0, ta, 1.0, 0.0 from sc
  union all select model_id, 'b', 1, ta, tr - ta, 2.0, 0.0 from sc
  union all select model_id, 'd', 0, 0.0, ta / 2, 1.0, 0.0 from sc
  union all select model_id, 'd', 1, ta / 2, tr - ta / 2, 1.0, 0.0 from sc
  union all select model_id, 'd', 2, tr, 'infinity'::double, 1.0, 0.0 from sc),
 st as (select *, case when tau = 'infinity' then tau when g = 0 then 2 * tau / n else 2 * (exp(g * tau) - 1) / g / n end as scaled_time from ep)"""


@query("m3_epochs", f"""with {EPOCH_SQL} select model_id, pop, cast(node as bigint) as node, {r_sql("t")} as t,
  case when tau = 'infinity' then -1.0 else {r_sql("tau")} end as tau, {r_sql("n", 7)} as n, {r_sql("g")} as g from st""")
def model_epochs(spark, sf):
    """Epochs of positive duration; -1 stands for no end."""
    e = epochs(resolve(candidates(spark, sf), with_pulse())).where("tau > 1e-12")
    return e.select(
        "model_id", "pop", F.col("node").cast("bigint").alias("node"), r("t").alias("t"),
        F.expr("if(tau = double('infinity'), -1D, round(tau, 9) + 0D)").alias("tau"), r("n", 7).alias("n"), r("g").alias("g"),
    )


@query("m4_violations", """with b as (select s_suppkey as model_id, s_acctbal as balance from supplier)
 select model_id, 'pulse_probability' as rule from b where balance / 5000 < 0 or balance / 5000 > 1
 union all select model_id, 'negative_time' from b where balance <> 0
 union all select model_id, 'negative_size' from b where balance - 500 < 0
 union all select model_id, 'zero_size' from b where balance - 500 = 0
 union all select model_id, 'final_growth' from b where balance > 9000
 union all select model_id, 'more_than_one_root' from b
 union all select model_id, 'lineages_after_removal' from b
 union all select model_id, 'size_after_removal' from b where balance > 1000""")
def model_violations(spark, sf):
    """Balances push values out of bounds and events out of order."""
    t = Template(N_E, GEN_TIME).add_leaf("a").add_leaf("b").add_leaf("d")
    t.move_lineages("a", "b", "greatest(abs(balance), 2000)", p="balance / 5000")
    t.move_lineages("a", "b", 1000)
    t.set_size("a", "balance", n="balance - 500")
    t.set_size("b", 200000, g="if(balance > 9000, 0.001, 0)")
    t.move_lineages("b", "a", "-1 * abs(balance)", p=0.5)
    return violations(resolve(candidates(spark, sf), t)).select("model_id", "rule")


@query("m4_bounds", """with b as (select s_suppkey as model_id, cast(s_acctbal as double) as x from supplier)
 select model_id, 'bounds:n' as rule from b where x < 100 or x > 9000
 union all select model_id, 'bounds:t' from b where x <= 500 or x >= 5000
 union all select model_id, 'bounds:u' from b where x - 6000 < 1e-12
 union all select model_id, 'bounds:p' from b where x / 8000 <= 0 or x / 8000 >= 1""")
def parameter_bounds(spark, sf):
    """Balances as a size, a bounded time, a time with a lower bound only, and a part."""
    t = Template(N_E, GEN_TIME).add_size_param("n", 100, 9000).add_time_param("t", 500, 5000).add_time_param("u", 6000)
    t.add_pulse_param("p")
    x = table(spark, sf, "supplier").selectExpr("s_suppkey as model_id", "double(s_acctbal) as n", "double(s_acctbal) as t",
                                                "double(s_acctbal) as u", "double(s_acctbal) / 8000 as p")
    return bound_violations(x, t)


@query("m5_scaled_time", f"""with {EPOCH_SQL} select model_id, pop || ':' || node as node, {r_sql("sum(scaled_time)", 7)} as scaled_time
  from st where tau <> 'infinity' group by all""")
def scaled_time(spark, sf):
    """Coalescent time spent in every finite node."""
    e = epochs(resolve(candidates(spark, sf), with_pulse())).where("tau <> double('infinity')")
    out = e.groupBy("model_id", F.expr("concat(pop, ':', node) as node")).agg(F.sum("scaled_time").alias("scaled_time"))
    return out.select("model_id", "node", r("scaled_time", 7).alias("scaled_time"))


@query("m6_graph", f"""with {CAND_SQL} select model_id, u.parent, u.child, {r_sql("cast(u.prob as double)")} as prob from sc, lateral (values
  ('a:1', 'a:0', 1 - p), ('d:1', 'a:0', p), ('d:1', 'd:0', 1.0::double), ('b:1', 'a:1', 1.0::double), ('b:1', 'b:0', 1.0::double),
  ('d:2', 'b:1', 1.0::double), ('d:2', 'd:1', 1.0::double)) as u(parent, child, prob)""")
def graph(spark, sf):
    e = edges(resolve(candidates(spark, sf), with_pulse()))
    return e.select("model_id", "parent", "child", r("prob").alias("prob"))


@query("m6_lineages", f"""with {CAND_SQL} select model_id, u.node, cast(u.n as bigint) as n from sc, lateral (values
  ('a:0', 4), ('b:0', 4), ('d:0', 2), ('a:1', 4), ('d:1', 6), ('b:1', 8), ('d:2', 10)) as u(node, n)""")
def lineage_counts(spark, sf):
    return lineages(resolve(candidates(spark, sf), with_pulse()), {"a": 4, "b": 4, "d": 2})


CHAIN = 40


@query("m6_deep_graph", f"""with m as (select s_suppkey as model_id from supplier where s_nationkey % 2 = 0), pop as (select i from range({CHAIN + 1}) t(i))
 select model_id, 'p' || i || ':0' as node, cast(1 + i % 3 as bigint) as n from m, pop
 union all select model_id, 'p' || j.i || ':1', cast(sum(1 + l.i % 3) as bigint) from m, pop j, pop l where j.i > 0 and l.i <= j.i group by all""")
def deep_graph(spark, sf):
    """A chain of 40 joins: each population moves into the next, so every node but the tips holds all before it."""
    t = Template(N_E, GEN_TIME)
    for i in range(CHAIN + 1):
        t.add_leaf(f"p{i}")
    for i in range(CHAIN):
        t.move_lineages(f"p{i}", f"p{i + 1}", f"{1000 * (i + 1)} + extra")
    models = table(spark, sf, "supplier").where("s_nationkey % 2 = 0").selectExpr("s_suppkey as model_id", "double(s_suppkey) as extra")
    return lineages(resolve(models, t), {f"p{i}": 1 + i % 3 for i in range(CHAIN + 1)})


@query("m7_e_het", f"""with {CAND_SQL}, t as (select model_id, ta, tr,
   1.0::double + 0 * ta as after_root, (2.0 * (1 - exp(-2 * (tr - ta) / 2.0)) + exp(-2 * (tr - ta) / 2.0) * 1.0) as from_ab, na from sc)
 select model_id, 'a' as pop, {r_sql("na * (1 - exp(-2 * ta / na)) + exp(-2 * ta / na) * from_ab", 8)} as e_het from t
 union all select model_id, 'b', {r_sql("(1 - exp(-2 * ta)) + exp(-2 * ta) * from_ab", 8)} from t
 union all select model_id, 'd', {r_sql("0.3 * (1 - exp(-2 * tr / 0.3)) + exp(-2 * tr / 0.3)", 8)} from t""")
def e_het(spark, sf):
    """Expected pairwise differences on a tree, against the closed form along each population's path."""
    s = Sweep(tree(), candidates(spark, sf), {"a": 2, "b": 2, "d": 2})
    return s.heterozygosity().select("model_id", "pop", r("e_het", 8).alias("e_het"))


ONE_POP_SQL = f"""{CAND_SQL}, ep as (select model_id, 0 as k, ta as tau, na as n from sc union all
   select model_id, 1, tr - ta, 2.0 from sc union all select model_id, 2, 'infinity'::double, 1.0 from sc),
 cu as (select *, coalesce(sum(2 * tau / n) over (partition by model_id order by k rows between unbounded preceding and 1 preceding), 0) as x from ep),
 ej as (select model_id, j, sum(exp(-x * j * (j - 1) / 2) * n / (j * (j - 1)) * (case when tau = 'infinity' then 1 else 1 - exp(-j * (j - 1) * tau / n) end)) as e
   from cu, (values (2), (3)) as v(j) group by all),
 w as (select model_id, sum(e) filter (j = 2) as e2, sum(e) filter (j = 3) as e3 from ej group by all)"""


@query("m8_one_pop_sfs", f"""with {ONE_POP_SQL} select model_id, cast(u.derived as bigint) as derived, {r_sql("u.v")} as value
  from w, lateral (values (0, 0.0::double), (1, 1.5 * e2 + 1.5 * e3), (2, 1.5 * e2 - 1.5 * e3), (3, 0.0::double)) as u(derived, v)""")
def one_pop_sfs(spark, sf):
    """Three lineages through three sizes."""
    t = Template(N_E, GEN_TIME).add_leaf("a", n="n_a").set_size("a", "t_ab", n=20000).set_size("a", "t_root", n=N_E)
    out = one_population_spectrum(resolve(candidates(spark, sf), t), 3)
    return out.select("model_id", F.col("derived").cast("bigint").alias("derived"), r("value").alias("value"))


def data_abd(spark, sf):
    """Spectrum of a, b, d: no missing calls."""
    return combined(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2))


def pulse_sweep(spark, sf):
    return Sweep(with_pulse(), candidates(spark, sf), {"a": 4, "b": 4, "d": 2})


@query("m9_expected_sfs")
def expected_sfs(spark, sf):
    """Probability of each observed configuration under every candidate."""
    s = pulse_sweep(spark, sf).expected_sfs(data_abd(spark, sf).configs(), normalized=True)
    return s.select("model_id", config_key().alias("config"), r("value", 8).alias("prob"))


@query("m9_sums_to_one", """select s_suppkey as model_id, true as sums_to_one from supplier""")
def sums_to_one(spark, sf):
    """Every configuration that occurs in the data at these sample sizes is listed, so probabilities add up to 1."""
    s = pulse_sweep(spark, sf).expected_sfs(data_abd(spark, sf).configs(), normalized=True)
    return s.groupBy("model_id").agg(F.expr("abs(sum(value) - 1) < 1e-9").alias("sums_to_one"))


@query("m10_tensor_product")
def model_tensor_product(spark, sf):
    ramp = [i / 4 for i in range(5)]
    rows = {"all": {}, "a": {"a": ramp}, "a_not_b": {"a": ramp, "b": [1 - x for x in ramp]}}
    out = pulse_sweep(spark, sf).tensor_product(rows)
    return out.select("model_id", "row", r("value", 8).alias("value"))


@query("m11_branch_length", f"""with {CAND_SQL} select model_id,
   {r_sql("2 * (ta + 2.0 / 2 * (1 - exp(-2 * (tr - ta) / 2.0)) + exp(-2 * (tr - ta) / 2.0) * 1.0 / 2)", 8)} as branch_length from sc""")
def branch_length(spark, sf):
    """One allele of a and one of b: twice the expected time to their ancestor."""
    s = Sweep(tree(), candidates(spark, sf), {"a": 1, "b": 1})
    return s.branch_length().select("model_id", r("branch_length", 8).alias("branch_length"))


@query("m11_tmrca", f"""with {CAND_SQL} select model_id, {r_sql("(tr - ta) * 0 + ta + (1 - exp(-(tr - ta))) + exp(-(tr - ta)) / 2", 8)} as tmrca from sc""")
def tmrca(spark, sf):
    s = Sweep(tree(), candidates(spark, sf), {"a": 1, "b": 1})
    return s.tmrca().select("model_id", r("tmrca", 8).alias("tmrca"))


# ---- scoring of given probabilities -------------------------------------------------------------------------------

# Chromosomes as models: the empirical spectrum of each is the expectation that blocks are scored against.
GIVEN_SQL = f"""{SFS_SQL}, per as (select cast(substr(chrom_id, 4) as bigint) as model_id, {CONFIG}, count(*) as c from sites
   where (a_anc + b_anc + c_anc + d_anc > 0 and a_der + b_der + c_der + d_der > 0) group by all),
 expected as (select model_id, {CONFIG}, c / cast(sum(c) over (partition by model_id) as double) as prob from per),
 models as (select distinct model_id from expected)"""


def given(spark, sf):
    per = sites(spark, sf).polymorphic().df.groupBy(F.expr("bigint(substr(chrom_id, 4)) as model_id"), "anc", "der").agg(
        F.count(F.lit(1)).alias("c")
    )
    return per.selectExpr("model_id", "anc", "der", "c / sum(c) over (partition by model_id) as prob")


LOGLIK_SQL = f"""{GIVEN_SQL}, ll as (select m.model_id, s.block, sum(cnt * ln(greatest(coalesce(prob, 0), 1e-100))) as log_lik
  from sfs s cross join models m left join expected e on e.model_id = m.model_id and (e.a_anc, e.a_der, e.b_anc, e.b_der, e.c_anc, e.c_der, e.d_anc, e.d_der)
   = (s.a_anc, s.a_der, s.b_anc, s.b_der, s.c_anc, s.c_der, s.d_anc, s.d_der) group by all)"""


@query("m12_loglik", f"with {LOGLIK_SQL} select model_id, {r_sql('sum(log_lik)', 4)} as log_lik from ll group by model_id")
def loglik(spark, sf):
    out = composite_log_likelihood(combined(spark, sf), given(spark, sf))
    return out.select("model_id", r("log_lik", 4).alias("log_lik"))


@query("m12_loglik_blocks", f"with {LOGLIK_SQL} select model_id, block, {r_sql(f'log_lik - model_id / {float(N_BLOCKS)}', 5)} as log_lik from ll")
def loglik_blocks(spark, sf):
    """Per block, with a prior of -model_id shared out over the blocks."""
    expected = given(spark, sf)
    prior = expected.select("model_id").distinct().selectExpr("model_id", "-double(model_id) as log_prior")
    out = composite_log_likelihood(blocks(spark, sf), expected, by_block=True, log_prior=prior)
    return out.select("model_id", "block", r("log_lik", 5).alias("log_lik"))


ABD_SQL = "where a_anc + b_anc + d_anc > 0 and a_der + b_der + d_der > 0"
LENGTH_SQL = "b as (select s_suppkey as model_id, 5 + s_nationkey / 10.0::double as bl from supplier)"


def given_lengths(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey as model_id", "5 + s_nationkey / 10D as branch_length")


@query("m13_poisson_total", f"""with {SFS_SQL}, c as (select block, sum(cnt) as x from sfs {ABD_SQL} group by block),
  f as (select count(*) as k, sum(x) as c, sum(lgamma(x + 1)) as lg from c), {LENGTH_SQL}
 select model_id, {r_sql("-k * 250 * bl + c * ln(250 * bl) - lg", 4)} as log_factor from b, f""")
def total_factor(spark, sf):
    """Given branch lengths, over a, b and d, which have no missing calls."""
    s = blocks(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2))
    return poisson_total(s, given_lengths(spark, sf), 250.0).select("model_id", r("log_factor", 4).alias("log_factor"))


@query("m18_branch_report", f"""with {LENGTH_SQL} select model_id, {r_sql("4 * 1e4 * bl", 6)} as branch_length from b""")
def branch_report(spark, sf):
    out = branch_length_report(given_lengths(spark, sf), N_E)
    return out.select("model_id", r("branch_length", 6).alias("branch_length"))


P_MISS_SQL = """t as (select *, a_anc+b_anc+c_anc+d_anc as ta, a_der+b_der+c_der+d_der as td from long),
 v as (select pop, sum(case when n-anc-der >= 1 and ta > 0 and td > 0 then cnt*(n-anc-der) else 0 end) as m,
   sum(case when anc >= 1 and ta > 1 and td > 0 then cnt*anc else 0 end) as a,
   sum(case when der >= 1 and ta > 0 and td > 1 then cnt*der else 0 end) as d from t group by pop),
 pm as (select pop, m / (m + a + d) as pm from v),
 h as (select block, pop, max(n) as n, sum(cnt * 2.0 * anc * der / greatest((anc + der) * (n - 1), 1)) as x from long group by all),
 eh as (select s_suppkey as model_id, pop, (1 + s_nationkey / 25.0::double) * n / 4.0 as e_het from supplier, (select distinct pop, n from h))"""


def given_het(spark, sf):
    """Given expected heterozygosity per supplier and population."""
    entries = ", ".join(f"struct('{p}' as pop, (1 + s_nationkey / 25D) * {n} / 4D as e_het)" for p, n in zip(POPS, SAMPLED_N))
    return table(spark, sf, "supplier").selectExpr("s_suppkey as model_id", f"inline(array({entries}))")


@query("m14_poisson_pairwise", f"""with {SFS_SQL}, {LONG_SQL}, {P_MISS_SQL}
 select model_id, {r_sql("sum(n / 14.0::double * (-1000 * e_het * (1 - pm) + x * ln(1000 * e_het * (1 - pm)) - lgamma(x + 1)))", 4)} as log_factor
 from h join pm using (pop) join eh using (pop) group by model_id""")
def pairwise_factor(spark, sf):
    out = poisson_pairwise(blocks(spark, sf), given_het(spark, sf), 1000.0)
    return out.select("model_id", r("log_factor", 4).alias("log_factor"))


PAIR_TERM = "n / 14.0::double * (-{rate} * e_het * (1 - pm) + x * ln({rate} * e_het * (1 - pm)) - lgamma(x + 1))"


@query("m14_pairwise_blocks", f"""with {SFS_SQL}, {LONG_SQL}, {P_MISS_SQL}
 select model_id, block, {r_sql(f"sum({PAIR_TERM.format(rate=1000)})", 4)} as log_factor
 from h join pm using (pop) join eh using (pop) group by model_id, block""")
def pairwise_factor_blocks(spark, sf):
    out = poisson_pairwise(blocks(spark, sf), given_het(spark, sf), 1000.0, by_block=True)
    return out.select("model_id", "block", r("log_factor", 4).alias("log_factor"))


FULL_LL_SQL = f"""{LOGLIK_SQL}, {LONG_SQL}, {P_MISS_SQL}, factor as (select model_id, block, sum({PAIR_TERM.format(rate=1000)}) as lf
   from h join pm using (pop) join eh using (pop) group by model_id, block),
 whole as (select model_id, block, log_lik + lf - model_id / {float(N_BLOCKS)} as full_lik from ll join factor using (model_id, block))"""


def full_parts(spark, sf):
    """Given probabilities, the data with a rate that makes 1000 per block, and a prior of -model_id."""
    expected = given(spark, sf)
    prior = expected.select("model_id").distinct().selectExpr("model_id", "-double(model_id) as log_prior")
    data = MutationData(blocks(spark, sf).materialised(), N_E, 1e6).with_rate(1000.0 * N_BLOCKS / (4 * N_E * 1e6))
    return expected, prior, data


@query("m12_full_loglik", f"with {FULL_LL_SQL} select model_id, {r_sql('sum(full_lik)', 3)} as log_lik from whole group by model_id")
def full_loglik(spark, sf):
    """Configurations, pairwise mutation factor and prior."""
    expected, prior, data = full_parts(spark, sf)
    out = full_log_likelihood(data.spectrum, expected, data.factor(given_het(spark, sf)), prior)
    return out.select("model_id", r("log_lik", 3).alias("log_lik"))


@query("m12_full_loglik_blocks", f"with {FULL_LL_SQL} select model_id, block, {r_sql('full_lik', 4)} as log_lik from whole")
def full_loglik_blocks(spark, sf):
    expected, prior, data = full_parts(spark, sf)
    out = full_log_likelihood(data.spectrum, expected, data.factor(given_het(spark, sf), by_block=True), prior, by_block=True)
    return out.select("model_id", "block", r("log_lik", 4).alias("log_lik"))


@query("m16_best_full", f"""with {FULL_LL_SQL}, l as (select model_id, sum(full_lik) as log_lik from whole group by model_id)
 select model_id, model_id * 100.0::double as t, {r_sql("log_lik", 3)} as log_lik from l order by l.log_lik desc, model_id limit 1""")
def best_full(spark, sf):
    """The best model with its parameter under the full likelihood."""
    expected, prior, data = full_parts(spark, sf)
    scores = full_log_likelihood(data.spectrum, expected, data.factor(given_het(spark, sf)), prior)
    models = expected.select("model_id").distinct().selectExpr("model_id", "model_id * 100D as t")
    return best_of(models, scores).select("model_id", "t", r("log_lik", 3).alias("log_lik"))


@query("m15_kl", f"""with {LOGLIK_SQL}, tot as (select {CONFIG}, sum(cnt) as cnt from sfs group by all), n as (select sum(cnt) as n from tot),
 m as (select sum(cnt) as m from tot group by a_anc+a_der, b_anc+b_der, c_anc+c_der, d_anc+d_der),
 en as (select (select sum(cnt / n * ln(cnt / n)) from tot, n) + (select sum(m / n * ln(n / m)) from m, n) as e),
 l as (select model_id, sum(log_lik) as log_lik from ll group by model_id)
 select model_id, {r_sql("(-log_lik + n * e) / n", 7)} as kl from l, n, en""")
def kl(spark, sf):
    s = combined(spark, sf).materialised()
    out = kl_divergence(s, composite_log_likelihood(s, given(spark, sf)))
    return out.select("model_id", r("kl", 7).alias("kl"))


@query("m16_best_given", f"with {LOGLIK_SQL}, l as (select model_id, sum(log_lik) as log_lik from ll group by model_id) select model_id, {r_sql('log_lik', 4)} as log_lik from l order by l.log_lik desc, model_id limit 1")
def best_given(spark, sf):
    expected = given(spark, sf)
    lik = composite_log_likelihood(combined(spark, sf), expected)
    models = Sweep(tree(), expected.select("model_id").distinct(), {"a": 1, "b": 1})
    return best_model(models, lik).select("model_id", r("log_lik", 4).alias("log_lik"))


@query("m16_best_model")
def best_of_sweep(spark, sf):
    """Candidates scored through their expected spectra; the best one with its parameters."""
    data = data_abd(spark, sf).materialised()
    s = pulse_sweep(spark, sf)
    lik = sweep_log_likelihood(s, data)
    return best_model(s, lik).select("model_id", "t_ab", "t_root", "n_a", "p", "g", r("log_lik", 3).alias("log_lik"))


@query("m17_diversity", f"""with {SFS_SQL}, {LONG_SQL}, {P_MISS_SQL}, w as (select pop, x, sum(x) over (partition by pop) as t, count(*) over (partition by pop) as k from h),
 f as (select pop, max(t) as t, sqrt(avg(power((t - x) * k / (k - 1.0) - t, 2)) * (count(*) - 1)) as sp from w group by pop)
 select model_id, pop, {r_sql("1e9 * t / (4 * 1e4 * 700001.0::double * e_het * (1 - pm))", 4)} as est, {r_sql("1e9 * sp / (4 * 1e4 * 700001.0::double * e_het * (1 - pm))", 4)} as sd,
  {r_sql("(t / (4 * 1e4 * 700001.0::double * e_het * (1 - pm)) - 1e-8) / (sp / (4 * 1e4 * 700001.0::double * e_het * (1 - pm)))", 3)} as z
 from f join pm using (pop) join eh using (pop)""")
def diversity(spark, sf):
    """Mutation rates per 1e9 bases and generations from within-population diversity, for given expectations."""
    out = within_population_diversity(blocks(spark, sf), given_het(spark, sf), N_E, 700001.0, MU)
    return out.select(
        "model_id", "pop", r("1e9 * est_mut_rate", 4).alias("est"), r("1e9 * jackknife_sd", 4).alias("sd"), r("z", 3).alias("z")
    )


@query("m17_one_block", f"""with {TOTAL_SQL}, sfs as (select 0 as block, * from tot), {LONG_SQL}, {P_MISS_SQL}
 select model_id, pop, {r_sql("1e9 * x / (4 * 1e4 * 700001.0::double * e_het * (1 - pm))", 4)} as est, cast(null as double) as sd,
  cast(null as double) as z from h join pm using (pop) join eh using (pop)""")
def diversity_of_one_block(spark, sf):
    """A single block has an estimate but no spread."""
    out = within_population_diversity(combined(spark, sf), given_het(spark, sf), N_E, 700001.0, MU)
    return out.select("model_id", "pop", r("1e9 * est_mut_rate", 4).alias("est"), "jackknife_sd", "z").withColumnRenamed("jackknife_sd", "sd")


@query("m18_expected_counts", f"""with {GIVEN_SQL} select model_id, {key_sql()} as config,
   {r_sql("prob * (4 * 1e4 * 1e-8 * 5e5)", 8)} as expected_count from expected""")
def counts_report(spark, sf):
    """Expected SNP counts from given (unnormalised) expectations."""
    out = expected_counts(given(spark, sf).withColumnRenamed("prob", "value"), N_E, MU, 5e5)
    return out.select("model_id", config_key().alias("config"), r("value", 8).alias("expected_count"))


@query("m19_bootstrap_ci", f"""with {GIVEN_SQL}, draw as (select o_orderkey % 20 as replicate, o_custkey % 20 as block, count(*) as times from orders group by all),
  ll as (select d.replicate, m.model_id, sum(times * cnt * ln(greatest(coalesce(prob, 0), 1e-100))) as log_lik
   from draw d join sfs s using (block) cross join models m left join expected e on e.model_id = m.model_id
    and (e.a_anc, e.a_der, e.b_anc, e.b_der, e.c_anc, e.c_der, e.d_anc, e.d_der) = (s.a_anc, s.a_der, s.b_anc, s.b_der, s.c_anc, s.c_der, s.d_anc, s.d_der)
   group by all),
  best as (select replicate, model_id * 100.0::double as t from ll qualify row_number() over (partition by replicate order by log_lik desc, model_id) = 1)
 select 't' as parameter, {r_sql('quantile_cont(t, 0.025)', 6)} as low, {r_sql('quantile_cont(t, 0.975)', 6)} as high from best""")
def bootstrap_ci(spark, sf):
    """Interval of a parameter over 20 datasets whose blocks are drawn by a table, under given probabilities."""
    draws = table(spark, sf, "orders").selectExpr("o_orderkey % 20 as replicate", "o_custkey % 20 as block")
    fits = bootstrap_best(blocks(spark, sf).materialised(), given(spark, sf), draws).selectExpr("replicate", "model_id * 100D as t")
    return parameter_intervals(fits, ["t"]).select("parameter", r("low", 6).alias("low"), r("high", 6).alias("high"))


@query("m19_bootstrap_sweep")
def bootstrap_sweep(spark, sf):
    """95 % intervals of the parameters over 20 bootstrap datasets."""
    data = blocks(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2)).materialised()
    fits = bootstrap_parameters(pulse_sweep(spark, sf), data, 20, seed=1)
    return parameter_intervals(fits, ["t_ab", "t_root", "n_a", "p", "g"])


@query("m20_factor_switch", f"""with {SFS_SQL}, c as (select block, sum(cnt) as x from sfs {ABD_SQL} group by block), {LENGTH_SQL}
 select model_id, {r_sql("sum(-20 * bl + x * ln(20 * bl) - lgamma(x + 1))", 4)} as log_factor from b, c group by model_id""")
def factor_switch(spark, sf):
    """The factor on total branch length instead of pairwise differences, after a change of the rate."""
    s = blocks(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2)).materialised()
    data = MutationData(s, N_E, 1e6, 1e-3, use_pairwise_diffs=False).with_rate(20.0 * N_BLOCKS / (4 * N_E * 1e6))
    return data.factor(given_lengths(spark, sf)).select("model_id", r("log_factor", 4).alias("log_factor"))


@query("e4_user_draw", """select s_suppkey as model_id, cast(100 + s_nationkey * 10 as double) as n, (100 + s_nationkey * 10) * 2.0::double + 1 as t from supplier""")
def user_draw(spark, sf):
    """Draws given as expressions over the models' columns and earlier parameters."""
    t = Template(N_E, GEN_TIME).add_size_param("n", draw="double(100 + nation * 10)").add_time_param("t", lower_constraints=["n"], draw="n * 2 + 1")
    models = table(spark, sf, "supplier").selectExpr("s_suppkey as model_id", "s_nationkey as nation")
    return draw_candidates(models, t).select("model_id", "n", "t")


@query("e6_add_parameter", f"""select s_suppkey as model_id, {r_sql("sqrt(s_nationkey + 1)", 9)} as scaled, {r_sql("s_nationkey + 1.0::double", 9)} as x from supplier""")
def low_level_parameter(spark, sf):
    """A parameter with its own transform, to the unbounded scale and back."""
    t = Template(N_E, GEN_TIME).add_parameter(Parameter("x", "double(nation + 1)", "sqrt({x})", "({x}) * ({x})", "0D"))
    models = table(spark, sf, "supplier").selectExpr("s_suppkey as model_id", "s_nationkey as nation")
    scaled = scaled_parameters(draw_candidates(models, t), t).select("model_id", "x")
    back = unscaled_parameters(scaled, t).select("model_id", r("x", 9).alias("x"))
    return scaled.select("model_id", r("x", 9).alias("scaled")).join(back, "model_id")


@query("m20_attach", f"""with {TOTAL_SQL} select 4 as n_a, 2 as n_d, sum(cnt) as n_snps, 123456.0::double as length from tot
 where a_anc > 0 and a_der > 0""")
def attached(spark, sf):
    """Data restricted to the leaves of a model, d not ascertained, with another length."""
    t = Template(N_E, GEN_TIME).add_leaf("a").add_leaf("d").move_lineages("a", "d", 1000)
    s, data = attach(Sweep(t, candidates(spark, sf), {}), combined(spark, sf), 123456, ["d"])
    length = data.meta.first().length
    return data.n_snps().selectExpr(f"{s.sampled_n['a']} as n_a", f"{s.sampled_n['d']} as n_d", "n_snps", f"{length!r}D as length")


@query("t20_model_fit")
def fit_of_models(spark, sf):
    """Observed f2, D and difference statistics against the expectation of every candidate."""
    data = blocks(spark, sf).subset_populations(["a", "b", "d"]).with_sampled_n((4, 4, 2)).materialised()
    st = SpectrumStats(data)
    wanted = {"f2": st.f2("a", "b"), "d": st.pattersons_d("a", "b", "d"), "diff": st.ordered_prob({"a": [1], "b": [0]}, True)}
    out = model_fit(pulse_sweep(spark, sf), st, wanted)
    return out.select("model_id", "stat", *[r(c, 7).alias(c) for c in ("expected", "observed", "sd")], r("z", 4).alias("z"))


@query("a23_projection_vectors", f"""with {TOTAL_SQL}, l as (select distinct {key_sql()} as config, u.pop, u.anc, u.der, u.n from tot,
   lateral (values ('a', a_anc, a_der, 4), ('b', b_anc, b_der, 4), ('c', c_anc, c_der, 4), ('d', d_anc, d_der, 2)) as u(pop, anc, der, n)),
 g as (select *, unnest(range(n + 1)) as x from l)
 select config, pop, cast(x as bigint) as derived, {r_sql(f"{comb_sql('x', 'der')} * {comb_sql('n - x', 'anc')} / {comb_sql('n', 'anc + der')}")} as value from g""")
def projection_vectors(spark, sf):
    """Chance of each observation given every derived count of the full sample."""
    entries = ", ".join(
        f"struct('{p}' as pop, {observation(f'anc[{i}]', f'der[{i}]', n)} as v)" for i, (p, n) in enumerate(zip(POPS, SAMPLED_N))
    )
    rows = combined(spark, sf).configs().select(config_key().alias("config"), F.expr(f"inline(array({entries}))"))
    return rows.selectExpr("config", "pop", "posexplode(v) as (derived, value)").select(
        "config", "pop", F.col("derived").cast("bigint").alias("derived"), r("value").alias("value")
    )
