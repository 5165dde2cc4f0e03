"""Scoring tables of models against observed spectra."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.configs import quoted
from freqloom.functions.scalar import floored_log_text, log_gamma_plus_one_text
from freqloom.operators.sampling import bootstrap_totals
from freqloom.operators.spectrum import Spectrum, full_configs
from freqloom.operators.stats import SpectrumStats, Stat
from freqloom.plans.expected import Sweep

# Probabilities below this are raised to it before the logarithm.
FLOOR = 1e-100


def _with_each(rows: DataFrame, blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` once for every row of ``blocks``, a table of one row per block: its rows are one array, computed once.

    Every row is spelled out where it lies, so no join and no shuffle is needed to form the pairs.
    """
    every = blocks.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("blocks")).scalar()
    return rows.withColumn("_blocks", every).selectExpr(*rows.columns, "inline(_blocks)")


def composite_log_likelihood(
    spectrum: Spectrum, expected: DataFrame, by_block: bool = False, log_prior: DataFrame | None = None
) -> DataFrame:
    """``(model_id[, block], log_lik)`` from given ``expected(model_id, anc, der, prob)``.

    Configurations a model does not list have probability 0, which the floor turns into a constant: the join carries the
    excess over that constant only, so unseen pairs of models and configurations are never formed. ``log_prior``
    ``(model_id, log_prior)`` is added once, or in equal parts per block.
    """
    keys = ["block"] if by_block else []
    excess = f"cnt * ({floored_log_text('prob', FLOOR)} - {floored_log_text('0D', FLOOR)})"
    source = spectrum if by_block else spectrum.combined()
    listed = source.df.join(expected, ["anc", "der"]).groupBy("model_id", *keys).agg(F.expr(f"sum({excess})").alias("excess"))
    base = source.df.groupBy(*keys).agg(F.expr(f"sum(cnt) * {floored_log_text('0D', FLOOR)}").alias("base"))
    if by_block:
        # The result has a row for each model and block, also where a model lists none of a block's configurations.
        pairs = _with_each(expected.select("model_id").distinct(), base, ["block", "base"])
        out = pairs.join(listed, ["model_id", "block"], "left").selectExpr(
            "model_id", "block", "base + coalesce(excess, 0D) as log_lik"
        )
    else:
        whole = base.first().base
        out = expected.select("model_id").distinct().join(listed, "model_id", "left").selectExpr(
            "model_id", f"{whole!r}D + coalesce(excess, 0D) as log_lik"
        )
    if log_prior is None:
        return out
    share = "count(*) over (partition by model_id)" if by_block else "1"
    return out.join(log_prior, "model_id").selectExpr("model_id", *keys, f"log_lik + log_prior / {share} as log_lik")


def _poisson_facts(counts: DataFrame, count: str, keys: Sequence[str]) -> DataFrame:
    """Sufficient statistics of Poisson counts with one common rate: how many, their sum, their summed log factorials."""
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(count).alias("c"), F.expr(f"sum({log_gamma_plus_one_text(count)})").alias("lg")
    )


def poisson_total(spectrum: Spectrum, branch_length: DataFrame, rate: float, by_block: bool = False) -> DataFrame:
    """``(model_id[, block], log_factor)``: block totals as Poisson with mean rate times expected branch length.

    ``rate`` is the mutation rate of one block. Data with missing calls is refused; use :func:`poisson_pairwise`.
    """
    if spectrum.has_missing_data().first().has_missing_data:
        raise ValueError("total branch length is not defined for missing data; use the pairwise factor")
    lam = f"({float(rate)!r}D * branch_length)"
    if by_block:
        counts = spectrum.n_snps(by_block=True)
        text = f"-{lam} + n_snps * ln({lam}) - {log_gamma_plus_one_text('n_snps')}"
        return _with_each(branch_length, counts, ["block", "n_snps"]).selectExpr("model_id", "block", f"{text} as log_factor")
    facts = _poisson_facts(spectrum.n_snps(by_block=True), "n_snps", []).first()
    return branch_length.selectExpr(
        "model_id", f"-{facts.k}D * {lam} + {facts.c!r}D * ln({lam}) - {facts.lg!r}D as log_factor"
    )


def poisson_pairwise(
    spectrum: Spectrum, heterozygosity: DataFrame, rate: float, p_missing: DataFrame | None = None, by_block: bool = False
) -> DataFrame:
    """``(model_id[, block], log_factor)``: heterozygotes per ascertained population as Poisson, weighted by sample size."""
    keys = ["block"] if by_block else []
    asc = spectrum.ascertained_indices
    weight_total = sum(spectrum.sampled_n[i] for i in asc)
    weights = ", ".join(f"{quoted(spectrum.pops[i])}, {spectrum.sampled_n[i] / weight_total!r}D" for i in asc)
    facts = _poisson_facts(spectrum.pairwise_hets(), "hets", ["pop", *keys]).join(spectrum.p_missing() if p_missing is None else p_missing, "pop")
    lam = f"({float(rate)!r}D * e_het * (1D - p_missing))"
    term = f"element_at(map({weights}), pop) * (-k * {lam} + c * ln({lam}) - lg)"
    kept = heterozygosity.where(F.col("pop").isin([spectrum.pops[i] for i in asc]))
    return kept.join(facts, "pop").groupBy("model_id", *keys).agg(F.expr(f"sum({term})").alias("log_factor"))


def full_log_likelihood(
    spectrum: Spectrum, expected: DataFrame, factor: DataFrame | None = None, log_prior: DataFrame | None = None,
    by_block: bool = False,
) -> DataFrame:
    """``(model_id[, block], log_lik)``: configurations, mutation factor and prior together, from given tables.

    ``factor(model_id[, block], log_factor)`` comes from :func:`poisson_total` or :func:`poisson_pairwise`, by block if the
    result is. The prior is added once, or in equal parts per block. Models without a factor or prior have no result.
    """
    keys = ["model_id", "block"] if by_block else ["model_id"]
    out = composite_log_likelihood(spectrum, expected, by_block, log_prior)
    if factor is None:
        return out
    return out.join(factor, keys).selectExpr(*keys, "log_lik + log_factor as log_lik")


def best_of(candidates: DataFrame, log_lik: DataFrame) -> DataFrame:
    """The row of ``candidates(model_id, ...)`` with the highest score, with it; ties go to the lowest model id."""
    scored = candidates.join(log_lik, "model_id")
    order = F.struct(F.col("log_lik"), (-F.col("model_id")).alias("tie"))
    return scored.agg(F.max_by(F.struct(*scored.columns), order).alias("best")).where("best is not null").select("best.*")


def bootstrap_best(spectrum: Spectrum, expected: DataFrame, draws: DataFrame) -> DataFrame:
    """``(replicate, model_id, log_lik)``: the best model of each bootstrap dataset, from given probabilities.

    ``draws(replicate, block)`` has a row for each block drawn. The log-likelihood is linear in the counts, so each block is
    scored once by each model that lists one of its configurations, and a replicate adds up the scores of its blocks, times
    how often each was drawn: configurations are joined once, whatever the number of replicates. Configurations that a model
    does not list have the floor, so only the excess over it is joined.
    """
    low = floored_log_text("0D", FLOOR)
    gain = expected.selectExpr("model_id", "anc", "der", f"{floored_log_text('prob', FLOOR)} - {low} as gain")
    by_block = spectrum.df.join(gain, ["anc", "der"]).groupBy("block", "model_id").agg(F.expr("sum(cnt * gain)").alias("excess"))
    floor = spectrum.df.groupBy("block").agg(F.expr(f"sum(cnt) * {low}").alias("base"))
    times = draws.groupBy("replicate", "block").agg(F.count(F.lit(1)).alias("times"))
    scored = times.join(by_block, "block").groupBy("replicate", "model_id").agg(F.expr("sum(times * excess)").alias("excess"))
    base = times.join(floor, "block").groupBy("replicate").agg(F.expr("sum(times * base)").alias("base"))
    # Where no model lists anything drawn, all are equal and the lowest id is the best.
    lowest = expected.agg(F.min("model_id").alias("lowest"))
    best = scored.groupBy("replicate").agg(F.max_by("model_id", F.struct(F.col("excess"), (-F.col("model_id")).alias("tie"))).alias("model_id"), F.max("excess").alias("excess"))
    return base.join(best, "replicate", "left").crossJoin(F.broadcast(lowest)).selectExpr(
        "replicate", "coalesce(model_id, lowest) as model_id", "base + coalesce(excess, 0D) as log_lik"
    )


def kl_divergence(spectrum: Spectrum, log_lik: DataFrame, poisson_entropy: float = 0.0) -> DataFrame:
    """``(model_id, kl)``: divergence of the empirical from each model's distribution; at least 0 without a prior."""
    n = spectrum.n_snps().first().n_snps
    entropy = spectrum.negative_entropy().first().neg_entropy
    return log_lik.selectExpr(
        "model_id", f"(-log_lik + {n!r}D * {entropy!r}D + {float(poisson_entropy)!r}D) / {n!r}D as kl"
    )


def sweep_log_likelihood(sweep: Sweep, spectrum: Spectrum) -> DataFrame:
    """``(model_id, log_lik)`` of every candidate; blocks are combined before any model is evaluated."""
    combined = spectrum.combined().df.select("anc", "der", "cnt")
    probs = sweep.expected_sfs(
        combined, keep=["cnt"], normalized=True, folded=spectrum.folded, non_ascertained=spectrum.non_ascertained
    )
    return probs.groupBy("model_id").agg(F.expr(f"sum(cnt * {floored_log_text('value', FLOOR)})").alias("log_lik"))


def best_model(sweep: Sweep, log_lik: DataFrame) -> DataFrame:
    """The candidate with the highest score and its parameters; ties go to the lowest model id."""
    scored = sweep.candidates.join(log_lik, "model_id")
    order = F.struct(F.col("log_lik"), (-F.col("model_id")).alias("tie"))
    return scored.agg(F.max_by(F.struct(*scored.columns), order).alias("best")).select("best.*")


def bootstrap_parameters(sweep: Sweep, spectrum: Spectrum, n_replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, model_id, parameters..., log_lik)``: the best candidate for each bootstrap dataset.

    Each candidate's log-probabilities are computed once; replicates only re-weight them.
    """
    configs = spectrum.configs()
    probs = sweep.expected_sfs(
        configs, normalized=True, folded=spectrum.folded, non_ascertained=spectrum.non_ascertained
    ).selectExpr("model_id", "anc", "der", f"{floored_log_text('value', FLOOR)} as log_p")
    totals = bootstrap_totals(spectrum, n_replicates, seed)
    scored = totals.join(probs, ["anc", "der"]).groupBy("replicate", "model_id").agg(F.expr("sum(cnt * log_p)").alias("log_lik"))
    order = F.struct(F.col("log_lik"), (-F.col("model_id")).alias("tie"))
    best = scored.groupBy("replicate").agg(F.max_by("model_id", order).alias("model_id"), F.max("log_lik").alias("log_lik"))
    return best.join(sweep.candidates, "model_id")


def parameter_intervals(fits: DataFrame, parameters: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``(parameter, low, high)``: quantiles over bootstrap replicates."""
    parts = ", ".join(
        f"struct('{p}' as parameter, percentile({p}, {low}) as low, percentile({p}, {high}) as high)" for p in parameters
    )
    return fits.selectExpr(f"array({parts}) as q").selectExpr("inline(q)")


def within_population_diversity(
    spectrum: Spectrum,
    heterozygosity: DataFrame,
    n_e: float,
    length: float,
    muts_per_gen: float | None = None,
    p_missing: DataFrame | None = None,
) -> DataFrame:
    """``(model_id, pop, est_mut_rate, jackknife_sd, z)``: mutation rate from heterozygosity of each population.

    ``heterozygosity(model_id, pop, e_het)`` is expected per unit mutation rate. Total and jackknife spread are taken per
    population first; a model only divides them by its expectation.
    """
    usable = [spectrum.pops[i] for i in spectrum.ascertained_indices if spectrum.sampled_n[i] > 1]
    blocks = spectrum.pairwise_hets().where(F.col("pop").isin(usable)).selectExpr(
        "pop", "hets", "sum(hets) over (partition by pop) as whole", "count(*) over (partition by pop) as k"
    )
    facts = blocks.groupBy("pop").agg(
        F.first("whole").alias("whole"),
        F.expr("sqrt(avg(power((whole - hets) * try_divide(k, k - 1) - whole, 2)) * (count(*) - 1))").alias("spread"),
    ).join(spectrum.p_missing() if p_missing is None else p_missing, "pop")
    e = f"({4.0 * n_e * length!r}D * e_het * (1D - p_missing))"
    mu = "cast(null as double)" if not muts_per_gen else f"{float(muts_per_gen)!r}D"
    return heterozygosity.join(facts, "pop").selectExpr(
        "model_id", "pop", f"try_divide(whole, {e}) as est_mut_rate", f"try_divide(spread, {e}) as jackknife_sd",
        f"try_divide(try_divide(whole, {e}) - {mu}, try_divide(spread, {e})) as z",
    )


def expected_stats(sweep: Sweep, stats: SpectrumStats, wanted: Mapping[str, Stat]) -> DataFrame:
    """``(model_id, stat, expected)``: statistics of every candidate's expected spectrum on the sample sizes of ``stats``.

    A statistic's terms are weights per configuration, so the expectation is the same sum with expected values in place
    of counts, over all configurations of these sample sizes.
    """
    if list(stats.spectrum.pops) != sweep.pops or {p: sweep.sampled_n[p] for p in sweep.pops} != stats.sampled_n:
        raise ValueError("the sweep must have the populations and sample sizes of the statistics")
    spark = sweep.candidates.sparkSession
    configs = full_configs(spark, sweep.pops, sweep.sizes, stats.spectrum.non_ascertained)
    terms = {name: text for stat in wanted.values() for name, text in stat.terms.items()}
    alias = {name: f"t{i}" for i, name in enumerate(terms)}
    sums = stats.weigh(sweep.expected_sfs(configs).withColumnRenamed("value", "cnt"), ["model_id"], {
        alias[n]: text for n, text in terms.items()
    })
    entries = ", ".join(
        f"struct('{name}' as stat, {stat.value(lambda n: alias[n])} as expected)" for name, stat in wanted.items()
    )
    return sums.selectExpr("model_id", f"inline(array({entries}))")


def model_fit(sweep: Sweep, stats: SpectrumStats, wanted: Mapping[str, Stat]) -> DataFrame:
    """``(model_id, stat, expected, observed, sd, bias, z)``: observed statistics against every candidate."""
    observed = stats.summary(wanted).select("stat", F.col("est").alias("observed"), "sd", "bias")
    joined = expected_stats(sweep, stats, wanted).join(observed, "stat")
    return joined.selectExpr(
        "model_id", "stat", "expected", "observed", "sd", "bias", "try_divide(observed - expected, sd) as z"
    )


def branch_length_report(branch_length: DataFrame, n_e: float) -> DataFrame:
    """``(model_id, branch_length)`` in generations, from given total branch lengths in units of 4 N_e generations."""
    return branch_length.withColumn("branch_length", F.col("branch_length") * (4.0 * n_e))


@dataclass(frozen=True)
class MutationData:
    """Data with the settings of their mutation factor: rate per base and generation, and which counts it is taken on."""

    spectrum: Spectrum
    n_e: float
    length: float
    muts_per_gen: float | None = None
    use_pairwise_diffs: bool = True

    def with_rate(self, muts_per_gen: float | None) -> MutationData:
        return replace(self, muts_per_gen=muts_per_gen)

    def factor(self, given: DataFrame, by_block: bool = False) -> DataFrame | None:
        """The factor for given ``(model_id, pop, e_het)`` or, with the switch off, ``(model_id, branch_length)``; without a
        rate there is none. A block has an equal part of the length."""
        if self.muts_per_gen is None:
            return None
        blocks = self.spectrum.df.select("block").distinct().count()
        rate = 4.0 * self.n_e * self.muts_per_gen * self.length / max(1, blocks)
        if self.use_pairwise_diffs:
            return poisson_pairwise(self.spectrum, given, rate, by_block=by_block)
        return poisson_total(self.spectrum, given, rate, by_block=by_block)


def expected_counts(expected: DataFrame, n_e: float, muts_per_gen: float, length: float) -> DataFrame:
    """Expected number of SNPs per configuration from unnormalised expected spectra."""
    return expected.withColumn("value", F.col("value") * (4.0 * n_e * muts_per_gen * length))


def attach(
    sweep: Sweep, spectrum: Spectrum, length: float | None = None, non_ascertained: Sequence[str] | None = None
) -> tuple[Sweep, Spectrum]:
    """The sweep with the data's sample sizes and the data on the sweep's leaf populations, in leaf order."""
    leaves = [p for p in sweep.template.leaves if p in spectrum.pops]
    missing = [p for p in sweep.template.leaves if p not in spectrum.pops]
    if missing:
        raise ValueError(f"leaf populations without data: {missing}")
    data = spectrum.subset_populations(leaves, non_ascertained)
    if length is not None:
        data = Spectrum(
            data.df, data.pops, data.meta.selectExpr(f"{float(length)!r}D as length"), data.non_ascertained, data.folded
        )
    sizes: Mapping[str, int] = dict(zip(data.pops, data.sampled_n))
    return Sweep(sweep.template, sweep.candidates, sizes), data
