"""Statistics of a spectrum with block-jackknife errors.

A statistic is a formula over *terms*. A term is a per-configuration weight; its count-weighted sum is taken per block in
one aggregation. The formula is then evaluated on the totals and on the totals without each block, so any combination of
statistics has its own jackknife.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.configs import at_text, is_polymorphic, quoted
from freqloom.functions.scalar import UNROLL_LIMIT, comb_fold_text, comb_text, falling_text, product_text
from freqloom.operators.spectrum import Spectrum

# Terms summed in one aggregation; larger families of statistics run as several scans of the (small) spectrum.
TERMS_PER_SCAN = 120

Lookup = Callable[[str], str]
#: Ancestral and derived alleles drawn from a population.
Draw = tuple[int, int]
#: Pairs of draws whose weighted chances make a pairwise statistic.
F2_PATTERNS = ((1.0, (0, 2), (2, 0)), (1.0, (2, 0), (0, 2)), (-2.0, (1, 1), (1, 1)))
IBS_PATTERNS = ((1.0, (1, 0), (1, 0)), (1.0, (0, 1), (0, 1)))


@dataclass(frozen=True)
class Stat:
    """Formula ``value`` (SQL text) over named ``terms`` (SQL texts); supports + - * / ** with statistics and numbers."""

    terms: Mapping[str, str]
    value: Callable[[Lookup], str]

    @staticmethod
    def _lift(other) -> Stat:
        return other if isinstance(other, Stat) else Stat({}, lambda get: f"{float(other)!r}D")

    def _with(self, other, template: str) -> Stat:
        other = Stat._lift(other)
        return Stat({**self.terms, **other.terms}, lambda get: template.format(self.value(get), other.value(get)))

    def apply(self, fun: str | Callable[[str], str]) -> Stat:
        """``fun`` of the statistic: the name of a SQL function, or a map from SQL text to SQL text."""
        call = (lambda x: f"{fun}({x})") if isinstance(fun, str) else fun
        return Stat(self.terms, lambda get: call(self.value(get)))

    def __add__(self, other):
        return self._with(other, "({} + {})")

    def __sub__(self, other):
        return self._with(other, "({} - {})")

    def __mul__(self, other):
        return self._with(other, "({} * {})")

    def __truediv__(self, other):
        return self._with(other, "try_divide({}, {})")

    def __pow__(self, other):
        return self._with(other, "power({}, {})")

    def __neg__(self):
        return self.apply(lambda x: f"(-{x})")

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return Stat._lift(other) - self

    def __rtruediv__(self, other):
        return Stat._lift(other) / self

    def __rpow__(self, other):
        return Stat._lift(other) ** self


def _ratio_text(anc: str, der: str, k0: int, k1: int) -> str:
    """Chance of drawing ``k0`` ancestral, then ``k1`` derived alleles; 0 where there are too few."""
    drawn = f"({falling_text(anc, k0)}) * ({falling_text(der, k1)})"
    return f"coalesce(try_divide({drawn}, {falling_text(f'{anc} + {der}', k0 + k1)}), 0D)"


def content_name(value) -> str:
    """A short name that follows from the value."""
    return hashlib.md5(repr(list(value)).encode()).hexdigest()[:16]


def weighted_subsets_text(anc: str, der: str, n: int, weights: Sequence[float]) -> str:
    """Sum over d of weights[d] C(anc, n - d) C(der, d)."""
    used = [(d, float(w)) for d, w in enumerate(weights) if w != 0]
    if not used:
        return "0D"
    if n <= UNROLL_LIMIT:
        return " + ".join(f"{w!r}D * ({comb_text(anc, n - d)}) * ({comb_text(der, d)})" for d, w in used)
    pairs = ", ".join(f"struct({d} as d, {w!r}D as w)" for d, w in used)
    step = f"p.w * ({comb_fold_text(anc, f'{n} - p.d')}) * ({comb_fold_text(der, 'p.d')})"
    return f"aggregate(array({pairs}), 0D, (total, p) -> total + {step})"


def count_subsets_text(
    pops: Sequence[str], derived_weights: Mapping[str, Sequence[float]], totals: Mapping[str, int]
) -> str:
    """Number of subsets with ``totals[pop]`` alleles per population, weighted by their derived counts."""
    if not set(derived_weights) <= set(totals):
        raise ValueError("weights given for a population without a subset size")
    factors = []
    for pop, n in totals.items():
        i = pops.index(pop)
        anc, der = at_text("anc", i), at_text("der", i)
        if pop in derived_weights:
            if len(derived_weights[pop]) != n + 1:
                raise ValueError(f"{pop} needs {n + 1} weights")
            factors.append(weighted_subsets_text(anc, der, n, derived_weights[pop]))
        else:
            factors.append(comb_text(f"{anc} + {der}", n))
    return product_text(factors)


def subsample_probability_text(pops: Sequence[str], sub_anc: Sequence[int], sub_der: Sequence[int]) -> str:
    """P(a random subset of a configuration is the given one); 0 where no subset of that size exists."""
    totals = {p: a + d for p, a, d in zip(pops, sub_anc, sub_der) if a + d > 0}
    weights = {p: [float(k == d) for k in range(totals[p] + 1)] for p, d in zip(pops, sub_der) if p in totals}
    wanted, every = count_subsets_text(pops, weights, totals), count_subsets_text(pops, {}, totals)
    return f"coalesce(try_divide({wanted}, {every}), 0D)"


def subsample_table(spectrum: Spectrum, size: int) -> DataFrame:
    """``(anc, der, sub_anc, sub_der, prob)``: every polymorphic draw of ``size`` alleles a configuration can yield.

    The draw is spelled out population by population inside the row; impossible branches end at once.
    """
    rows = spectrum.configs().selectExpr(
        "anc", "der", f"{size} as left", "1D as prob", "cast(array() as array<int>) as sub_anc",
        "cast(array() as array<int>) as sub_der",
    )
    for i, n in enumerate(spectrum.sampled_n):
        options = (
            f"explode(flatten(transform(sequence(0, least(left, {n})), k -> transform(sequence(0, k),"
            " d -> struct(k - d as a, d as d))))) as draw"
        )
        ways = f"({comb_fold_text(f'anc[{i}]', 'draw.a')}) * ({comb_fold_text(f'der[{i}]', 'draw.d')})"
        every = comb_fold_text(f"anc[{i}] + der[{i}]", "draw.a + draw.d")
        rows = rows.selectExpr("*", options).selectExpr(
            "anc", "der", "left - draw.a - draw.d as left", f"prob * try_divide({ways}, {every}) as prob",
            "array_append(sub_anc, draw.a) as sub_anc", "array_append(sub_der, draw.d) as sub_der",
        ).where("prob > 0")
    everyone = range(len(spectrum.pops))
    done = rows.where(F.expr("left = 0") & is_polymorphic(everyone, "sub_anc", "sub_der"))
    return done.select("anc", "der", "sub_anc", "sub_der", "prob")


class SpectrumStats:
    """Statistics of ``spectrum`` on ``sampled_n[pop]`` alleles per population (default: all of them).

    Sites with fewer calls than that contribute nothing, so smaller numbers use more of a dataset with missing calls.
    """

    def __init__(self, spectrum: Spectrum, sampled_n: Mapping[str, int] | None = None):
        n = dict(zip(spectrum.pops, spectrum.sampled_n)) if sampled_n is None else dict(sampled_n)
        self.spectrum = spectrum
        self.sampled_n = {p: k for p, k in n.items() if k > 0}
        asc = {spectrum.pops[i] for i in spectrum.ascertained_indices}
        if sum(k for p, k in self.sampled_n.items() if p in asc) < 2:
            raise ValueError("statistics need two or more alleles of ascertained populations")
        self._ascertained = asc
        self._parts: dict[str, str] = {}

    # ---- terms --------------------------------------------------------------------------------------------------

    def _calls(self, pop: str) -> tuple[str, str]:
        i = self.spectrum.pops.index(pop)
        return at_text("anc", i), at_text("der", i)

    def _part(self, pop: str, label: str, value: str) -> str:
        """Name a per-population quantity once; terms multiply the named columns."""
        name = f"part{self.spectrum.pops.index(pop)}_{label}"
        self._parts[name] = value
        return name

    def _only(self, pop: str, side: str) -> str:
        """Subsets of ``pop`` that show one allele only."""
        calls = self._calls(pop)[0 if side == "anc" else 1]
        return self._part(pop, side, comb_text(calls, self.sampled_n[pop]))

    def _without_monomorphic(self, parts: Mapping[str, tuple[str, str | None, str | None]]) -> str:
        """Product of the first entries, minus the all-ancestral and the all-derived parts (None stands for 0)."""
        out = product_text([v[0] for v in parts.values()])
        for side in (1, 2):
            factors = [v[side] if p in self._ascertained else v[0] for p, v in parts.items()]
            if all(f is not None for f in factors):
                out = f"{out} - {product_text(factors)}"
        return out

    def _ordered_term(self, pattern: Mapping[str, tuple[int, int]]) -> str:
        """Weight of drawing ``pattern[pop] = (k0, k1)`` alleles in a given order.

        Drawing k of n alleles that were themselves drawn from m is drawing k of m: C(m, n) times a ratio of falling
        factorials replaces the sum over sub-configurations.
        """
        if any(sum(k) > self.sampled_n[p] for p, k in pattern.items()):
            return "0D"
        parts = {}
        for pop, n in self.sampled_n.items():
            a, d = self._calls(pop)
            k0, k1 = pattern.get(pop, (0, 0))
            subsets = comb_text(f"{a} + {d}", n)
            if k0 + k1:
                ratio = f"{falling_text(a, k0)} * {falling_text(d, k1)} / ({falling_text(f'{a} + {d}', k0 + k1)})"
                subsets = f"case when {a} + {d} >= {n} then ({subsets}) * {ratio} else 0D end"
            parts[pop] = (
                self._part(pop, f"draw_{k0}_{k1}", subsets),
                self._only(pop, "anc") if k1 == 0 else None,
                self._only(pop, "der") if k0 == 0 else None,
            )
        return self._without_monomorphic(parts)

    def _weights_term(self, weights: Mapping[str, Sequence[float]]) -> str:
        parts = {}
        for pop, n in self.sampled_n.items():
            a, d = self._calls(pop)
            w = weights.get(pop)
            if w is None:
                w, every = (1.0,) * (n + 1), self._part(pop, "draw_0_0", comb_text(f"{a} + {d}", n))
            elif len(w) != n + 1:
                raise ValueError(f"{pop} needs {n + 1} weights")
            else:
                every = self._part(pop, f"user_{content_name(w)}", weighted_subsets_text(a, d, n, w))
            only = [f"{self._only(pop, side)} * {float(x)!r}D" for side, x in (("anc", w[0]), ("der", w[-1]))]
            parts[pop] = (every, *only)
        return self._without_monomorphic(parts)

    def _raw(self, name: str, term: str) -> Stat:
        return Stat({name: term}, lambda get: get(name))

    @property
    def denom(self) -> Stat:
        """Number of polymorphic subsets: the normaliser of every probability."""
        return self._raw("denom", self._ordered_term({}))

    # ---- statistics ---------------------------------------------------------------------------------------------

    def ordered_prob(self, pattern: Mapping[str, Sequence[int]], fold: bool = False) -> Stat:
        """Probability of an ordered sample: ``pattern[pop]`` lists 0 (ancestral) and 1 (derived) alleles."""
        counts = {p: (list(s).count(0), list(s).count(1)) for p, s in pattern.items()}
        prob = self._counted_prob(counts)
        return prob + self._counted_prob({p: (k1, k0) for p, (k0, k1) in counts.items()}) if fold else prob

    def _counted_prob(self, counts: Mapping[str, tuple[int, int]]) -> Stat:
        # Numbers of populations, as names joined by a separator could be read in two ways.
        index = self.spectrum.pops.index
        name = "draw_" + "_".join(f"{index(p)}_{a}_{d}" for p, (a, d) in sorted(counts.items()))
        return self._raw(name, self._ordered_term(counts)) / self.denom

    def tensor_prod(self, weights: Mapping[str, Sequence[float]], name: str = "weights") -> Stat:
        """User weights per population and derived count, divided by the normaliser.

        Terms and parts are named by the weights themselves, so different weights never share a column; ``name`` only
        helps to read a plan.
        """
        key = content_name([(self.spectrum.pops.index(p), list(map(float, w))) for p, w in sorted(weights.items())])
        return self._raw(f"user_{re.sub('[^A-Za-z0-9]', '_', name)}_{key}", self._weights_term(weights)) / self.denom

    def count_1100(self, a: str, b: str, c: str, o: str | None = None) -> Stat:
        pattern: dict[str, list[int]] = {}
        for pop, allele in ((a, 1), (b, 1), (c, 0), (o, 0)):
            if pop is not None:
                pattern.setdefault(pop, []).append(allele)
        return self.ordered_prob(pattern, fold=o is not None)

    def baba(self, a: str, b: str, c: str, o: str | None = None) -> Stat:
        return self.count_1100(a, c, b, o)

    def abba(self, a: str, b: str, c: str, o: str | None = None) -> Stat:
        return self.count_1100(b, c, a, o)

    def f4(self, a: str, b: str, c: str, d: str | None = None) -> Stat:
        """BABA minus ABBA; without ``d`` the ancestral allele is the outgroup."""
        return self.baba(a, b, c, d) - self.abba(a, b, c, d)

    abba_baba = f4

    def log_abba_baba(self, a: str, b: str, c: str, d: str | None = None) -> Stat:
        return self.baba(a, b, c, d).apply("ln") - self.abba(a, b, c, d).apply("ln")

    def f3(self, a: str, b: str, o: str) -> Stat:
        return self.f4(o, a, o, b)

    def f2(self, a: str, b: str) -> Stat:
        return self.f4(a, b, a, b)

    def f_st(self, a: str, b: str) -> Stat:
        within = (self.ordered_prob({a: [1, 0]}, True) + self.ordered_prob({b: [1, 0]}, True)) / 2
        between = self.ordered_prob({a: [1], b: [0]}, True)
        return (between - within) / between

    def pattersons_d(self, a: str, b: str, c: str, d: str | None = None) -> Stat:
        baba, abba = self.baba(a, b, c, d), self.abba(a, b, c, d)
        return (baba - abba) / (baba + abba)

    def greens_f(self, a: str, b: str, c: str, o: str | None = None) -> Stat:
        return self.f4(a, b, c, o) / self.f4(a, c, c, o)

    def f4_ratio(self, a: str, b: str, c: str, x: str, o: str | None = None) -> Stat:
        return self.f4(x, c, a, o) / self.f4(b, c, a, o)

    def singleton_probs(self, pops: Sequence[str]) -> dict[str, Stat]:
        """Per population: chance that it alone differs; ``denom`` is what remains."""
        probs = {p: self.ordered_prob({q: [int(q == p)] for q in pops}, True) for p in pops}
        return {**probs, "denom": 1 - reduce(lambda a, b: a + b, probs.values())}

    def all_f2_stats(self) -> dict[tuple[str, str], Stat]:
        pops = sorted(p for p, n in self.sampled_n.items() if n > 1)
        return {(a, b): self.f2(a, b) for a, b in combinations(pops, 2)}

    def all_ibs_stats(self) -> dict[tuple[str, str], Stat]:
        out = {}
        for a, b in combinations_with_replacement(sorted(self.sampled_n), 2):
            if a != b:
                out[a, b] = self.ordered_prob({a: [0], b: [0]}, True)
            elif self.sampled_n[a] > 1:
                out[a, a] = self.ordered_prob({a: [0, 0]}, True)
        return out

    # ---- evaluation ---------------------------------------------------------------------------------------------

    def _chunks(self, stats: Mapping[str, Stat]) -> list[dict[str, Stat]]:
        chunks: list[dict[str, Stat]] = [{}]
        seen: set[str] = set()
        for name, stat in stats.items():
            if seen and len(seen | set(stat.terms)) > TERMS_PER_SCAN:
                chunks.append({})
                seen = set()
            chunks[-1][name] = stat
            seen |= set(stat.terms)
        return chunks

    def weigh(self, rows: DataFrame, keys: Sequence[str], terms: Mapping[str, str]) -> DataFrame:
        """Sums of ``cnt`` times each term over ``rows(*keys, anc, der, cnt)``, per key."""
        parts = rows.selectExpr(*keys, "cnt", *[f"{t} as {n}" for n, t in self._parts.items()])
        return parts.groupBy(*keys).agg(*[F.expr(f"sum(cnt * ({t}))").alias(n) for n, t in terms.items()])

    def term_sums(self, terms: Mapping[str, str]) -> DataFrame:
        """Per block, the count-weighted sum of every term."""
        return self.weigh(self.spectrum.df, ["block"], terms)

    def leave_one_out(self, stats: Mapping[str, Stat]) -> DataFrame:
        """``(stat, block, est, jack)``: the full estimate and the estimate without each block."""
        parts = []
        for chunk in self._chunks(stats):
            terms: dict[str, str] = {}
            for stat in chunk.values():
                terms.update(stat.terms)
            alias = {name: f"t{i}" for i, name in enumerate(terms)}
            sums = self.term_sums({alias[n]: t for n, t in terms.items()})
            # The window holds one row per block.
            totals = sums.selectExpr("block", *alias.values(), *[f"sum({t}) over () as all_{t}" for t in alias.values()])
            full = lambda n, alias=alias: f"all_{alias[n]}"
            rest = lambda n, alias=alias: f"(all_{alias[n]} - {alias[n]})"
            entries = ", ".join(
                f"struct({quoted(name)} as stat, {stat.value(full)} as est, {stat.value(rest)} as jack)"
                for name, stat in chunk.items()
            )
            parts.append(totals.selectExpr("block", f"inline(array({entries}))"))
        return reduce(DataFrame.unionByName, parts).select("stat", "block", "est", "jack")

    def summary(self, stats: Mapping[str, Stat], expected: DataFrame | None = None) -> DataFrame:
        """``(stat, est, sd, bias, z)``; with ``expected(stat, expected)`` z is (observed - expected) / sd.

        Residuals are taken against the full estimate, not against the jackknife mean. If the statistic is undefined
        without some block, its errors are null.
        """
        whole = "count(jack - est) = count(*)"
        out = self.leave_one_out(stats).groupBy("stat").agg(
            F.first("est").alias("est"),
            F.expr(f"case when {whole} then sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1)) end").alias("sd"),
            F.expr(f"case when {whole} then avg(jack - est) * (count(*) - 1) end").alias("bias"),
            F.count(F.lit(1)).alias("n_blocks"),
        )
        if expected is None:
            return out.selectExpr("*", "try_divide(est, sd) as z")
        joined = out.join(expected.select("stat", "expected"), "stat", "left")
        return joined.selectExpr("*", "try_divide(est - expected, sd) as z")

    def pair_table(self, stats: Mapping[tuple[str, str], Stat], expected: DataFrame | None = None) -> DataFrame:
        """Pairwise statistics sorted by the size of z; ``expected(pop1, pop2, expected)`` is optional."""
        key = "|".join
        named = None
        if expected is not None:
            named = expected.select(F.concat_ws("|", "pop1", "pop2").alias("stat"), "expected")
        table = self.summary({key(pair): stat for pair, stat in stats.items()}, named)
        if expected is None:
            table = table.withColumn("expected", F.lit(0.0))
        return table.selectExpr(
            "split_part(stat, '|', 1) as pop1", "split_part(stat, '|', 2) as pop2", "expected", "est as observed", "z"
        ).orderBy(F.expr("abs(z)").desc_nulls_last())

    def all_f2(self, expected: DataFrame | None = None) -> DataFrame:
        """f2 of all pairs of populations with two alleles or more, as :meth:`pair_table` gives it."""
        return self._pair_summary(sorted(p for p, n in self.sampled_n.items() if n > 1), F2_PATTERNS, False, expected)

    def all_pairs_ibs(self, expected: DataFrame | None = None) -> DataFrame:
        """Chance that two alleles are the same, for all pairs of populations and, with two alleles or more, within them."""
        return self._pair_summary(sorted(self.sampled_n), IBS_PATTERNS, True, expected)

    def _pair_sums(self, pops: Sequence[str], patterns: Sequence[tuple[float, Draw, Draw]], within: bool) -> tuple[DataFrame, str]:
        """``(block, sums)`` and the text of the array of pairs: a vector per block, one entry per pair and the normaliser.

        A configuration has one array of population facts and one of values, and vectors are added up as such, so neither the
        number of columns nor the text of the plan grows with the number of pairs.
        """
        index = self.spectrum.pops.index
        every = list(self.sampled_n)
        place = f"array({', '.join(str(every.index(p)) for p in pops)})"
        own = ", ".join(
            f"named_struct('a', anc[{index(p)}], 'd', der[{index(p)}], 'k', {n}, 'asc', {str(p in self._ascertained).lower()})"
            for p, n in self.sampled_n.items()
        )
        draws = {d for _, *both in patterns for d in both}
        if within:
            draws |= {(x[0] + y[0], x[1] + y[1]) for _, x, y in patterns}
        draws = sorted(draws)
        ratios = ", ".join(f"'q{x}{y}', {_ratio_text('x.a', 'x.d', x, y)}" for x, y in draws)
        facts = (
            f"transform(array({own}), x -> named_struct('asc', x.asc, 'all', {comb_fold_text('x.a + x.d', 'x.k')},"
            f" 'anc', {comb_fold_text('x.a', 'x.k')}, 'der', {comb_fold_text('x.d', 'x.k')}, 'k', x.k, {ratios}))"
        )
        whole = "aggregate(w, 1D, (t, x) -> t * x.all)"
        one_sided = lambda side: f"aggregate(w, 1D, (t, x) -> t * if(x.asc, x.{side}, x.all))"
        rows = self.spectrum.df.selectExpr("block", "cnt", f"{facts} as w").selectExpr(
            "block", "cnt", "w", f"{whole} as s", f"{one_sided('anc')} as sa", f"{one_sided('der')} as sd"
        )

        def product(*drawn: tuple[str, Draw]) -> str:
            """The weight of drawing from each of the populations, less what is not polymorphic."""
            sides = [" * ".join(["s", *[f"{w}.q{x}{y}" for w, (x, y) in drawn]])]
            for total, zero in (("sa", 1), ("sd", 0)):
                sides.append(" * ".join([total, *[f"if({w}.asc, {float(d[zero] == 0)!r}D, {w}.q{d[0]}{d[1]})" for w, d in drawn]]))
            return f"({' - '.join(sides)})"

        value = " + ".join(f"{weight!r}D * {product(('z.u', x), ('z.v', y))}" for weight, x, y in patterns)
        first = "i" if within else "i + 1"
        last = len(pops) - 1
        pairs = f"flatten(transform(sequence(0, {last if within else last - 1}), i -> transform(sequence({first}, {last}), j -> named_struct('i', i, 'j', j))))"
        if within:
            same = " + ".join(product(("z.u", (x[0] + y[0], x[1] + y[1]))) for _, x, y in patterns)
            value = f"if(x.i = x.j, {same}, {value})"
            many = f"array({', '.join(str(self.sampled_n[p] > 1).lower() for p in pops)})"
            pairs = f"filter({pairs}, x -> x.i <> x.j or {many}[x.i])"
        bound = f"transform(array(named_struct('u', w[{place}[x.i]], 'v', w[{place}[x.j]])), z -> {value})[0]"
        vector = rows.selectExpr("block", f"transform(concat(transform({pairs}, x -> {bound}), array(s - sa - sd)), y -> cnt * y) as y")
        sums = vector.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("y")))).alias("sums"))
        return sums, pairs

    def _pair_summary(self, pops: Sequence[str], patterns: Sequence[tuple[float, Draw, Draw]], within: bool, expected: DataFrame | None) -> DataFrame:
        """Pairs with jackknife errors, from the blocks' vectors; sorted by the size of z."""
        names = f"array({', '.join(quoted(p) for p in pops)})"
        none = "pop1 string, pop2 string, expected double, observed double, z double"
        if len(pops) < (1 if within else 2):
            return self.spectrum.df.sparkSession.createDataFrame([], none)
        sums, pairs = self._pair_sums(pops, patterns, within)
        total = sums.agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("t")).scalar()
        # One row per block and pair.
        rest = "try_divide(t[k] - sums[k], element_at(t, -1) - element_at(sums, -1))"
        rows = sums.withColumn("t", total).withColumn("pairs", F.expr(pairs)).selectExpr(
            "posexplode(pairs) as (k, p)", "t", "sums"
        ).selectExpr("p", "try_divide(t[k], element_at(t, -1)) as est", f"{rest} as jack")
        whole = "count(jack - est) = count(*)"
        out = rows.groupBy("p").agg(
            F.first("est").alias("observed"), F.expr(f"case when {whole} then sqrt(avg((jack - est) * (jack - est)) * (count(*) - 1)) end").alias("sd")
        ).selectExpr(f"{names}[p.i] as pop1", f"{names}[p.j] as pop2", "observed", "sd")
        if expected is None:
            out = out.withColumn("expected", F.lit(0.0))
        else:
            out = out.join(expected.select("pop1", "pop2", "expected"), ["pop1", "pop2"], "left")
        return out.selectExpr("pop1", "pop2", "expected", "observed", "try_divide(observed - expected, sd) as z").orderBy(
            F.expr("abs(z)").desc_nulls_last()
        )
