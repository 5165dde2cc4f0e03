"""Joint site frequency spectra: configuration counts per genome block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.functions.configs import (
    ANC, DER, at_text, config_key, folded_pair, int_array_text, is_complete, is_polymorphic, parse_key, pick,
    polymorphic_text, quoted, sizes, sum_text,
)
from freqloom.functions.scalar import log_gamma_plus_one_text, product_text
from freqloom.operators.checksums import keys_that_differ, rows_that_differ
from freqloom.operators.ordering import with_global_index
from freqloom.session import cut_lineage


def length_row(spark: SparkSession, length: float | None) -> DataFrame:
    """One-row table holding the number of bases, null when unknown."""
    return spark.createDataFrame([(None if length is None else float(length),)], schema="length DOUBLE")


@dataclass(frozen=True)
class Spectrum:
    """``df(block BIGINT, anc ARRAY<INT>, der ARRAY<INT>, cnt DOUBLE)``, one row per block and configuration.

    Everything per configuration is arithmetic inside a row, so each statistic is one scan and one small aggregation.
    """

    df: DataFrame
    pops: tuple[str, ...]
    meta: DataFrame
    non_ascertained: tuple[str, ...] = ()
    folded: bool = False
    declared_n: tuple[int, ...] | None = field(default=None)

    # ---- construction -------------------------------------------------------------------------------------------

    @classmethod
    def from_rows(
        cls,
        rows: DataFrame,
        pops: Sequence[str],
        length: float | None = None,
        non_ascertained: Sequence[str] = (),
        sampled_n: Sequence[int] | None = None,
    ) -> Spectrum:
        """From ``(block, anc, der[, cnt])`` rows; repeats add up and a missing ``cnt`` counts one."""
        cnt = F.col("cnt").cast("double") if "cnt" in rows.columns else F.lit(1.0)
        merged = rows.select(
            F.col("block").cast("bigint").alias("block"),
            F.col("anc").cast("array<int>").alias("anc"),
            F.col("der").cast("array<int>").alias("der"),
            cnt.alias("cnt"),
        )
        merged = merged.groupBy("block", "anc", "der").agg(F.sum("cnt").alias("cnt"))
        n = None if sampled_n is None else tuple(sampled_n)
        return cls(merged, tuple(pops), length_row(rows.sparkSession, length), tuple(non_ascertained), False, n)

    def materialised(self) -> Spectrum:
        """The same spectrum cut from its lineage; use before computing many statistics on it."""
        return replace(self, df=cut_lineage(self.df))

    def renumbered_labels(self) -> DataFrame:
        """``(block, ordinal, n_blocks)``: present blocks numbered from 0; one row per block."""
        labels = self.df.select("block").distinct()
        return labels.selectExpr(
            "block", "bigint(row_number() over (order by block) - 1) as ordinal", "count(*) over () as n_blocks"
        )

    def renumbered(self) -> Spectrum:
        """Blocks numbered 0, 1, ... in the order of their present labels."""
        df = self.df.join(self.renumbered_labels(), "block").selectExpr("ordinal as block", "anc", "der", "cnt")
        return replace(self, df=df)

    # ---- metadata -----------------------------------------------------------------------------------------------

    @property
    def ascertained_indices(self) -> list[int]:
        return [i for i, p in enumerate(self.pops) if p not in self.non_ascertained]

    @cached_property
    def sampled_n(self) -> tuple[int, ...]:
        """Sample size per population: declared, or the largest number of calls in any configuration (one row)."""
        if self.declared_n is not None:
            return self.declared_n
        tops = [f"max(anc[{i}] + der[{i}])" for i in range(len(self.pops))]
        return tuple(int(v or 0) for v in self.df.selectExpr(*tops).first())

    def observed_sizes(self) -> DataFrame:
        """``(pop, n)``: the largest number of calls per population."""
        tops = [f"max(anc[{i}] + der[{i}]) as n{i}" for i in range(len(self.pops))]
        return self.df.selectExpr(*tops).select(self._per_pop([f"n{i}" for i in range(len(self.pops))], "n"))

    def _per_pop(self, values: Sequence[str], name: str) -> Column:
        """Generator of one ``(pop, name)`` row per population."""
        entries = ", ".join(f"struct({quoted(p)} as pop, {v} as {name})" for p, v in zip(self.pops, values))
        return F.expr(f"inline(array({entries}))")

    def with_sampled_n(self, sampled_n: Sequence[int]) -> Spectrum:
        """Override the sample sizes; the counts stay as they are."""
        return replace(self, declared_n=tuple(sampled_n))

    def violations(self) -> DataFrame:
        """One row per rule with the number of offending configurations.

        Rules: some population is ascertained; no configuration exceeds the sample size; at least two ascertained
        alleles; every configuration is polymorphic among the ascertained populations.
        """
        n, asc = self.sampled_n, self.ascertained_indices
        too_big = " or ".join(f"anc[{i}] + der[{i}] > {n[i]}" for i in range(len(n)))
        counts = self.configs().selectExpr(
            f"count_if({too_big}) as too_big", f"count_if(not {polymorphic_text(asc)}) as monomorphic"
        )
        rules = {
            "no_ascertained_population": str(int(not asc)),
            "config_exceeds_sampled_n": "too_big",
            "fewer_than_two_ascertained_alleles": str(int(sum(n[i] for i in asc) < 2)),
            "monomorphic_when_ascertained": "monomorphic",
        }
        entries = ", ".join(f"struct('{rule}' as rule, bigint({bad}) as n_bad)" for rule, bad in rules.items())
        return counts.select(F.expr(f"inline(array({entries}))"))

    def validated(self) -> Spectrum:
        """Raise ValueError when any rule of :meth:`violations` is broken."""
        bad = self.violations().where("n_bad > 0").collect()
        if bad:
            raise ValueError("invalid configurations: " + ", ".join(f"{r.rule} ({r.n_bad})" for r in bad))
        return self

    def has_missing_data(self) -> DataFrame:
        """One row: is any configuration below the sample size in some population?"""
        full = is_complete(self.sampled_n)
        return self.df.agg(F.coalesce(F.bool_or(~full), F.lit(False)).alias("has_missing_data"))

    # ---- reshaping ----------------------------------------------------------------------------------------------

    def _merged(self, df: DataFrame) -> DataFrame:
        return df.groupBy("block", "anc", "der").agg(F.sum("cnt").alias("cnt"))

    def fold(self) -> Spectrum:
        """Merge each configuration with its allele-swapped copy."""
        anc, der = folded_pair()
        swapped = self.df.select("block", anc.alias("anc"), der.alias("der"), "cnt")
        return replace(self, df=self._merged(swapped), folded=True)

    def combined(self) -> Spectrum:
        """All blocks summed into block 0."""
        df = self.df.groupBy("anc", "der").agg(F.sum("cnt").alias("cnt"))
        return replace(self, df=df.select(F.lit(0).cast("bigint").alias("block"), "anc", "der", "cnt"))

    def configs(self) -> DataFrame:
        """Distinct configurations."""
        return self.df.select("anc", "der").distinct()

    def subset_configs(self, wanted: DataFrame) -> Spectrum:
        """Keep the configurations listed in ``wanted(anc, der)``."""
        return replace(self, df=self.df.join(wanted, ["anc", "der"], "left_semi"))

    def subset_populations(
        self, populations: Sequence[str], non_ascertained: Sequence[str] | None = None
    ) -> Spectrum:
        """Project to ``populations``, keeping only configurations polymorphic in the ascertained ones."""
        before = set(self.non_ascertained)
        outside = before if non_ascertained is None else set(non_ascertained)
        if any(p in before and p not in outside for p in populations):
            raise ValueError("a population that was not ascertained must stay so")
        keep = [self.pops.index(p) for p in populations]
        asc = [self.pops.index(p) for p in populations if p not in outside]
        projected = self.df.where(is_polymorphic(asc)).select(
            "block", pick(ANC, keep).alias("anc"), pick(DER, keep).alias("der"), "cnt"
        )
        still_out = tuple(p for p in populations if p in outside)
        return replace(
            self, df=self._merged(projected), pops=tuple(populations), non_ascertained=still_out, declared_n=None
        )

    def dictionary(self) -> DataFrame:
        """``(config_id, anc, der)`` with ids by similarity order, from a range-partitioned ranking."""
        order = [sizes(), F.least(ANC, DER), ANC]
        ranked = with_global_index(self.configs(), order, ["anc", "der"])
        return ranked.select(F.col("row_index").alias("config_id"), "anc", "der")

    def matrix(self, blocks: Sequence[int]) -> DataFrame:
        """Configurations by blocks: one column per listed block, absent entries 0."""
        wide = self.df.withColumn("config", config_key()).groupBy("config").pivot("block", list(blocks)).agg(F.sum("cnt"))
        return wide.na.fill(0.0)

    @classmethod
    def from_matrix(cls, wide: DataFrame, pops: Sequence[str], blocks: Sequence[int], **kwargs) -> Spectrum:
        """Inverse of :meth:`matrix`."""
        anc, der = parse_key("config")
        long = wide.unpivot("config", [str(b) for b in blocks], "block", "cnt").where("cnt <> 0")
        rows = long.select(F.col("block").cast("bigint").alias("block"), anc.alias("anc"), der.alias("der"), "cnt")
        return cls.from_rows(rows, pops, **kwargs)

    def batches(self, batch_size: int) -> DataFrame:
        """Configurations with the number of their batch of ``batch_size`` similar ones."""
        return self.dictionary().withColumn("batch", F.floor(F.col("config_id") / batch_size))

    # ---- aggregates ---------------------------------------------------------------------------------------------

    def n_snps(self, by_block: bool = False) -> DataFrame:
        """Total count, over everything or per block."""
        grouped = self.df.groupBy("block") if by_block else self.df.groupBy()
        return grouped.agg(F.coalesce(F.sum("cnt"), F.lit(0.0)).alias("n_snps"))

    def shape(self) -> DataFrame:
        """Number of blocks and of distinct configurations."""
        return self.df.agg(
            F.count_distinct("block").alias("n_blocks"), F.count_distinct("anc", "der").alias("n_configs")
        )

    def pairwise_hets(self) -> DataFrame:
        """``(block, pop, hets)``: average heterozygotes per individual of each population."""
        terms = [
            f"sum(cnt * 2D * anc[{i}] * der[{i}] / greatest((anc[{i}] + der[{i}]) * {float(n - 1)}D, 1D)) as h{i}"
            for i, n in enumerate(self.sampled_n)
        ]
        wide = self.df.groupBy("block").agg(*[F.expr(t) for t in terms])
        return wide.select("block", self._per_pop([f"h{i}" for i in range(len(self.pops))], "hets"))

    def p_missing(self) -> DataFrame:
        """``(pop, p_missing)``: chance that a random allele is missing.

        One random allele is taken away from each site; cases whose rest is polymorphic over all populations count.
        """
        every = range(len(self.pops))
        rows = self.df.selectExpr("anc", "der", "cnt", f"{sum_text(ANC, every)} as ta", f"{sum_text(DER, every)} as td")
        rows = rows.where("ta > 0 and td > 0")
        sums = []
        for i, n in enumerate(self.sampled_n):
            a, d = at_text(ANC, i), at_text(DER, i)
            sums += [
                f"sum(greatest({n} - {a} - {d}, 0) * cnt) as gone{i}",
                f"sum(case when ta > 1 then {a} * cnt else 0D end + case when td > 1 then {d} * cnt else 0D end) as kept{i}",
            ]
        wide = rows.selectExpr(*sums)
        return wide.select(self._per_pop([f"try_divide(gone{i}, gone{i} + kept{i})" for i in every], "p_missing"))

    def negative_entropy(self) -> DataFrame:
        """Sum of p ln p over configurations, given the pattern of sample sizes."""
        by_config = self.df.groupBy("anc", "der").agg(F.sum("cnt").alias("c"))
        by_size = by_config.groupBy(sizes().alias("sizes")).agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.ln("c")).alias("clogc")
        )
        # sum p ln p = sum c ln c / N - ln N, and the size pattern adds ln N - sum m ln m / N.
        return by_size.agg(
            ((F.sum("clogc") - F.sum(F.col("m") * F.ln("m"))) / F.sum("m")).alias("neg_entropy")
        )

    def poisson_entropy(self) -> DataFrame:
        """Poisson log-probability of the per-block totals at their own rates."""
        term = f"case when n_snps > 0 then -n_snps + n_snps * ln(n_snps) - {log_gamma_plus_one_text('n_snps')} else 0D end"
        return self.n_snps(by_block=True).agg(F.expr(f"sum({term})").alias("entropy"))

    def pairwise_poisson_entropy(self) -> DataFrame:
        """The same on pairwise heterozygosity, weighted by ascertained sample size."""
        asc = self.ascertained_indices
        weight_total = float(sum(self.sampled_n[i] for i in asc))
        weights = ", ".join(f"{quoted(self.pops[i])}, {self.sampled_n[i] / weight_total!r}D" for i in asc)
        term = f"case when hets > 1e-16 then -hets + hets * ln(hets) - {log_gamma_plus_one_text('hets')} else 0D end"
        kept = self.pairwise_hets().where(F.col("pop").isin([self.pops[i] for i in asc]))
        return kept.agg(F.expr(f"sum({term} * element_at(map({weights}), pop))").alias("entropy"))

    def integrate(self, weights: DataFrame, by_block: bool = False) -> DataFrame:
        """Sum of ``weights(anc, der, w)`` times count."""
        joined = self.df.join(weights, ["anc", "der"])
        grouped = joined.groupBy("block") if by_block else joined.groupBy()
        return grouped.agg(F.sum(F.col("w") * F.col("cnt")).alias("value"))

    def tensor_product(self, rows: Mapping[str, Mapping[str, Sequence[float]]]) -> DataFrame:
        """``(row, value)``: for each named row the sum of count times the product of its per-population weights.

        ``rows[name][pop][d]`` weighs d derived alleles; a population left out weighs 1. All rows share one scan.
        Configurations with missing calls have no place in the product and raise.
        """
        full = is_complete(self.sampled_n)
        problem = F.raise_error(F.lit("tensor product needs data without missing calls"))
        checked = self.df.select("der", F.when(full, F.col("cnt")).otherwise(problem).alias("cnt"))
        sums = []
        for name, vectors in rows.items():
            factors = [
                f"array({', '.join(f'{float(w)!r}D' for w in vectors[p])})[der[{i}]]"
                for i, p in enumerate(self.pops) if p in vectors
            ]
            sums.append(f"sum(cnt * {product_text(factors)}) as `{name}`")
        return checked.selectExpr(*sums).unpivot([], list(rows), "row", "value")

    def differences(self, other: Spectrum) -> DataFrame:
        """Rows that only one of two spectra has, with the side; empty when they are equal.

        Checksums per block tell where the spectra differ; only those blocks' rows are compared. Calling this runs the job of
        the checksums.
        """
        return rows_that_differ(self.df, other.df, "block", ("block", "anc", "der", "cnt"))

    def equals(self, other: Spectrum) -> bool:
        """Same populations and rows, by checksums per block, without a shuffle of rows."""
        return self.pops == other.pops and not keys_that_differ(self.df, other.df, "block", ("block", "anc", "der", "cnt")).take(1)


def full_configs(
    spark: SparkSession, pops: Sequence[str], sampled_n: Sequence[int], non_ascertained: Sequence[str] = ()
) -> DataFrame:
    """Every configuration of the given sample sizes that is polymorphic among the ascertained populations.

    Configuration number k is written out in mixed radix, so the list is one distributed ``range``.
    """
    count = reduce(lambda a, n: a * (n + 1), sampled_n, 1)
    digits, radix = [], 1
    for n in reversed(sampled_n):
        digits.insert(0, f"int(id div {radix} % {n + 1})")
        radix *= n + 1
    der = f"array({', '.join(digits)}) as der"
    anc = f"zip_with({int_array_text(sampled_n)}, der, (n, d) -> n - d) as anc"
    asc = [i for i, p in enumerate(pops) if p not in non_ascertained]
    return spark.range(count).selectExpr(der).selectExpr(anc, "der").where(is_polymorphic(asc))


def configs_from_derived(df: DataFrame, derived: Sequence[str], sampled_n: Sequence[int]) -> DataFrame:
    """Configurations from derived counts alone and full sample sizes."""
    der = ", ".join(f"int({c})" for c in derived)
    return df.selectExpr(f"array({der}) as der").selectExpr(
        f"zip_with({int_array_text(sampled_n)}, der, (n, d) -> n - d) as anc", "der"
    )
