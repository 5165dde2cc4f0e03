"""Expected spectra: closed forms, equivalences and sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freqloom.functions.constants import moran_system, spectrum_weights
from freqloom.operators.spectrum import Spectrum, full_configs
from freqloom.plans.expected import Sweep
from freqloom.plans.models import Template, resolve, violations
from freqloom.operators.stats import SpectrumStats
from freqloom.plans.scoring import kl_divergence, model_fit, sweep_log_likelihood


def unit():
    """Times, sizes and rates in coalescent units."""
    return Template(1.0, 0.25)


@pytest.fixture(scope="module")
def one(spark):
    return spark.sql("select 1 as model_id, 0.7D as t, 1.3D as n, 0.3D as p")


def values(sweep, **kwargs):
    spark = sweep.candidates.sparkSession
    out = sweep.expected_sfs(full_configs(spark, sweep.pops, sweep.sizes), **kwargs)
    return {(tuple(r.anc), tuple(r.der)): r.value for r in out.collect()}


def close(a, b, tol=1e-9):
    assert set(a) == set(b)
    assert max(abs(a[k] - b[k]) for k in a) < tol


def test_constant_size_is_one_over_b(one):
    got = values(Sweep(unit().add_leaf("a", n="n"), one, {"a": 10}))
    assert all(abs(v * der[0] - 1.3) < 1e-12 for (_, der), v in got.items())


def test_weights_and_moran_system():
    e = np.array([1 / (j * (j - 1)) for j in range(2, 13)])
    assert np.allclose(np.array(spectrum_weights(12)) @ e * np.arange(1, 12), 1.0)
    right, rates, left = moran_system(9)
    assert np.allclose(right @ left, np.eye(10))
    assert np.allclose(sorted(rates), [j * (j - 1) / 2 for j in range(10)])


def test_split_model(one):
    t = unit().add_leaf("a", n="n").add_leaf("b", n="n").move_lineages("a", "b", "t", n="n")
    s = Sweep(t, one, {"a": 3, "b": 4})
    branch = s.branch_length().first().branch_length
    assert abs(sum(values(s).values()) - branch) < 1e-9
    assert abs(branch - 5.12375115) < 1e-7
    assert all(abs(r.e_het - 1.3) < 1e-9 for r in s.heterozygosity().collect())
    assert abs(sum(values(s, normalized=True).values()) - 1) < 1e-12


def test_pulse_equals_split_through_a_ghost(one):
    pulse = unit().add_leaf("a", n="n").add_leaf("b", n=0.6)
    pulse.move_lineages("a", "b", "t / 2", p="p").move_lineages("a", "b", "t", n="2 * n")
    ghost = unit().add_leaf("a", n="n").add_leaf("b", n=0.6)
    ghost.move_lineages("a", "g", "t / 2", p="p", n=0.6).move_lineages("g", "b", "t / 2").move_lineages("a", "b", "t", n="2 * n")
    close(values(Sweep(pulse, one, {"a": 3, "b": 2})), values(Sweep(ghost, one, {"a": 3, "b": 2})))


def test_growth_equals_many_small_steps(one):
    grown = unit().add_leaf("a", n=1.0, g=1.5).set_size("a", 0.7, g=0)
    steps = unit().add_leaf("a")
    for k in range(200):
        steps.set_size("a", 0.7 * k / 200, float(np.exp(-1.5 * 0.7 * (k + 0.5) / 200)))
    steps.set_size("a", 0.7, float(np.exp(-1.05)))
    close(values(Sweep(grown, one, {"a": 5})), values(Sweep(steps, one, {"a": 5})), 1e-4)


def test_late_sample_keeps_the_sum(one):
    t = unit().add_leaf("a").add_leaf("b", t=0.2).move_lineages("a", "b", 0.1).set_size("b", 0.3, n="n")
    s = Sweep(t, one, {"a": 2, "b": 2})
    assert abs(sum(values(s).values()) - s.branch_length().first().branch_length) < 1e-9


def test_folded_and_ascertained_probabilities_sum_to_one(one):
    t = unit().add_leaf("a").add_leaf("b").move_lineages("a", "b", "t")
    s = Sweep(t, one, {"a": 3, "b": 2})
    folded = values(s, normalized=True, folded=True)
    # 12 - 2 configurations pair up into 5; each value appears for both members of a pair.
    assert abs(sum(folded.values()) / 2 - 1) < 1e-12
    spark = one.sparkSession
    asc = s.expected_sfs(full_configs(spark, s.pops, s.sizes, ["b"]), normalized=True, non_ascertained=["b"])
    assert abs(asc.agg(F.sum("value")).first()[0] - 1) < 1e-12


def test_larger_sample_size_does_not_change_normalised_values(spark, one):
    t = unit().add_leaf("a").add_leaf("b").move_lineages("a", "b", "t", n="n")
    configs = full_configs(spark, ("a", "b"), (2, 2))
    get = lambda n: {
        tuple(r.der): r.value for r in Sweep(t, one, n).expected_sfs(configs, normalized=True).collect()
    }
    close(get({"a": 2, "b": 2}), get({"a": 4, "b": 3}))


def test_observed_product_of_expected_spectrum(spark, one):
    """The tensor product of the expected spectrum taken as data is the expected tensor product."""
    t = unit().add_leaf("a").add_leaf("b", n="n").move_lineages("a", "b", "t")
    s = Sweep(t, one, {"a": 3, "b": 2})
    weights = {"w": {"a": [0.0, 0.5, 1.0, 0.0], "b": [1.0, 0.25, 0.0]}}
    counts = s.expected_sfs(full_configs(spark, s.pops, s.sizes)).selectExpr("0 as block", "anc", "der", "value as cnt")
    observed = Spectrum.from_rows(counts, s.pops, sampled_n=(3, 2)).tensor_product(weights).first().value
    assert abs(observed - s.tensor_product(weights).first().value) < 1e-9


def test_error_matrices(one):
    t = unit().add_leaf("a").add_leaf("b").move_lineages("a", "b", "t")
    s = Sweep(t, one, {"a": 2, "b": 1})
    same = {"a": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}
    close(values(s), values(s, error_matrices=same))
    noisy = {"a": [[0.9, 0.1, 0.0], [0.1, 0.8, 0.1], [0.0, 0.1, 0.9]]}
    assert abs(sum(values(s, normalized=True, error_matrices=noisy).values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        values(s, error_matrices={"a": [[1, 0, 0], [1, 1, 0], [0, 0, 1]]})


def test_tmrca(one):
    t = unit().add_leaf("a").add_leaf("b").move_lineages("a", "b", "t", n="n")
    assert abs(Sweep(t, one, {"a": 1, "b": 1}).tmrca().first().tmrca - (0.7 + 1.3 / 2)) < 1e-9
    # For a whole sample in one population, expected TMRCA is N (1 - 1/n) in these units.
    assert abs(Sweep(unit().add_leaf("a"), one, {"a": 5}).tmrca().first().tmrca - 0.8) < 1e-9
    assert abs(Sweep(unit().add_leaf("a"), one, {"a": 5}).deme_tmrca("a").first().tmrca - 0.8) < 1e-9


def test_models_of_one_sweep_may_order_events_differently(spark):
    c = spark.sql("select id as model_id, double(id + 1) / 2 as t from range(3)")
    t = unit().add_leaf("a").add_leaf("b").add_leaf("d").set_size("b", 1.2, n=0.5)
    t.move_lineages("a", "b", "t + 0.5").move_lineages("b", "d", 3)
    s = Sweep(t, c, {"a": 2, "b": 2, "d": 1})
    assert violations(s.events()).isEmpty()
    sums = s.expected_sfs(full_configs(spark, s.pops, s.sizes)).groupBy("model_id").agg(F.sum("value").alias("v"))
    assert len(s.events().select("model_id").distinct().collect()) == 3
    close({r.model_id: r.v for r in sums.collect()}, {r.model_id: r.branch_length for r in s.branch_length().collect()})


def test_the_true_model_fits_best(spark):
    """Expected counts of one candidate as data: that candidate has the highest likelihood and divergence 0."""
    c = spark.sql("select id as model_id, 0.2D + 0.3D * id as t from range(5)")
    t = unit().add_leaf("a").add_leaf("b").move_lineages("a", "b", "t")
    s = Sweep(t, c, {"a": 3, "b": 3})
    truth = Sweep(t, c.where("model_id = 2"), {"a": 3, "b": 3})
    counts = truth.expected_sfs(full_configs(spark, s.pops, s.sizes)).selectExpr("0 as block", "anc", "der", "value * 100 as cnt")
    data = Spectrum.from_rows(counts, s.pops, sampled_n=(3, 3)).materialised()
    kl = {r.model_id: r.kl for r in kl_divergence(data, sweep_log_likelihood(s, data)).collect()}
    assert abs(kl[2]) < 1e-9 and all(v > 1e-4 for k, v in kl.items() if k != 2)


def test_single_root_is_required(spark, one):
    t = unit().add_leaf("a").add_leaf("b")
    assert [r.rule for r in violations(resolve(one, t)).collect()] == ["more_than_one_root"]
    with pytest.raises(ValueError, match="single root"):
        Sweep(t, one, {"a": 1, "b": 1}).branch_length()


def test_model_fit(spark, one):
    """A difference between populations is expected as the tensor product of two ramps over the branch length."""
    t = unit().add_leaf("a").add_leaf("b", n="n").move_lineages("a", "b", "t")
    s = Sweep(t, one, {"a": 3, "b": 2})
    listed = [(b, [2, 1], [1, 1], 3.0 + b) for b in range(3)] + [(b, [3, 1], [0, 1], 2.0) for b in range(3)]
    df = spark.createDataFrame(listed, "block BIGINT, anc ARRAY<INT>, der ARRAY<INT>, cnt DOUBLE")
    stats = SpectrumStats(Spectrum.from_rows(df, ("a", "b"), sampled_n=(3, 2)))
    row = model_fit(s, stats, {"x": stats.ordered_prob({"a": [1], "b": [0]})}).first()
    product = s.tensor_product({"w": {"a": [0, 1 / 3, 2 / 3, 1], "b": [1, 0.5, 0]}}).first().value
    assert abs(row.expected - product / s.branch_length().first().branch_length) < 1e-9
    assert abs(row.z - (row.observed - row.expected) / row.sd) < 1e-9
