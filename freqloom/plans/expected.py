"""Expected spectra and coalescent statistics of every candidate of a sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.constants import (
    moran_system, panel_quadrature, spectrum_weights, two_parent_weights,
)
from freqloom.functions.configs import int_array_text, polymorphic_text, sizes_text
from freqloom.functions.scalar import comb_fold_text, expm1_ratio_text
from freqloom.functions.vectors import apply_rows, dot, doubles, let, matrix, observation
from freqloom.plans.assembly import Assembly, Joint, Layout
from freqloom.plans.models import Template, epochs, resolve, signed
from freqloom.session import cut_lineage

# Size of the model arrays that one broadcast carries; a larger sweep runs as several such joins, one per bucket of models.
BROADCAST_BYTES = 32 << 20
# Up to this many cells the weights of all tip observations are one array for each model; beyond it each pair of model and row is evaluated by itself.
JOINT_CELLS = 4096


def first_coalescence_text(pair_rate: str) -> str:
    """Expected time within an epoch (tau, n, g) before j lineages first coalesce; ``pair_rate`` is j (j - 1) / 2.

    Constant size has a closed form. With growth, the time is an integral over coalescent time x of
    exp(-pair_rate x) (n / 2) / (1 + g n x / 2), taken by Gauss-Legendre panels up to where the exponential vanishes.
    """
    decay = f"(2D * {pair_rate} / n)"
    nodes = "array(" + ", ".join(f"struct({y!r}D as y, {w!r}D as w)" for y, w in panel_quadrature()) + ")"
    span = f"least({pair_rate} * scaled_time, 40D)"
    step = f"q.w * exp(-{span} * q.y) / (1D + g * n * {span} * q.y / (2D * {pair_rate}))"
    grown = f"{span} / {pair_rate} * n / 2D * aggregate({nodes}, 0D, (s, q) -> s + {step})"
    constant = f"if(tau = double('infinity'), 1D / {decay}, {expm1_ratio_text(f'-{decay} * tau')} * tau)"
    return f"if(g = 0, {constant}, {grown})"


def truncated_spectrum_text(n: int, waits: str, tau: str) -> str:
    """Expected spectrum 0..n of the branches inside a node, from first coalescence times of 2..n lineages.

    The entry for all-derived holds the time after the sample has found its ancestor, 0 in the endless root.
    """
    if n == 1:
        return f"array(0D, if({tau} = double('infinity'), 0D, {tau}))"
    weighted = dot(doubles([b / n for b in range(1, n)]), "b")
    rest = f"if({tau} = double('infinity'), 0D, {tau} - {weighted})"
    return let("b", apply_rows(matrix(spectrum_weights(n)), waits), f"concat(array(0D), b, array({rest}))")


def node_spectra(pieces: DataFrame, lineages_text: str) -> DataFrame:
    """``(model_id, node, lineages, tau, scaled_time, waits)`` from epochs; ``lineages_text`` gives n of a node."""
    before = (
        "coalesce(sum(scaled_time) over (partition by model_id, node order by epoch"
        " rows between unbounded preceding and 1 preceding), 0D) as before"
    )
    pair = "(j * (j - 1) / 2D)"
    waits = (
        "if(lineages >= 2, transform(sequence(2, greatest(lineages, 2)),"
        f" j -> exp(-{pair} * before) * {first_coalescence_text(pair)}), cast(array() as array<double>)) as wait"
    )
    each = (
        pieces.withColumn("node", F.expr("concat(pop, ':', node)"))
        .withColumn("lineages", F.expr(lineages_text)).where("lineages > 0")
        .selectExpr("*", before).selectExpr("model_id", "node", "lineages", "tau", "scaled_time", waits)
    )
    summed = "aggregate(ws, transform(ws[0], x -> 0D), (s, w) -> zip_with(s, w, (x, y) -> x + y))"
    return each.groupBy("model_id", "node", "lineages").agg(
        F.sum("tau").alias("tau"), F.sum("scaled_time").alias("scaled_time"), F.collect_list("wait").alias("ws")
    ).selectExpr("model_id", "node", "lineages", "tau", "scaled_time", f"{summed} as waits")


def spectrum_by_size_text(ns: Sequence[int]) -> str:
    """Truncated spectrum of a node row, whatever its number of lineages."""
    branches = " ".join(f"when {n} then {truncated_spectrum_text(n, 'e', 'tau')}" for n in sorted(set(ns)) if n > 0)
    return let("e", "waits", f"case lineages {branches} end")


def moves_by_size_text(ns: Sequence[int], transposed: bool = False) -> str:
    """Moran transition matrix over a node (rows: derived count at the upper end; at the lower end if ``transposed``)."""
    branches = []
    for n in sorted(set(ns)):
        right, rates, left = moran_system(n)
        right, left = (left.T, right.T) if transposed else (right, left)
        row = let("y", "zip_with(x, d, (a, b) -> a * b)", apply_rows(matrix(left.T), "y"))
        survive = f"transform({doubles(rates)}, r -> exp(-r * scaled_time))"
        branches.append(f"when {n} then {let('d', survive, f'transform({matrix(right)}, x -> {row})')}")
    return f"case lineages {' '.join(branches)} end"


def one_population_spectrum(events: DataFrame, n: int) -> DataFrame:
    """``(model_id, node, derived, value)``: truncated spectrum of ``n`` lineages in every node of every model."""
    rows = node_spectra(epochs(events), str(int(n)))
    return rows.selectExpr(
        "model_id", "node", f"posexplode({spectrum_by_size_text([n])}) as (derived, value)"
    )


@dataclass(frozen=True)
class Sweep:
    """A template, its candidates ``(model_id, parameters...)`` and the sample size of each leaf population."""

    template: Template
    candidates: DataFrame
    sampled_n: Mapping[str, int]

    def __post_init__(self):
        unknown = set(self.sampled_n) - set(self.template.leaves)
        if unknown:
            raise ValueError(f"{sorted(unknown)} not in the leaf populations")

    @property
    def pops(self) -> list[str]:
        return [p for p in self.template.leaves if p in self.sampled_n]

    @property
    def sizes(self) -> list[int]:
        return [int(self.sampled_n[p]) for p in self.pops]

    def events(self) -> DataFrame:
        return resolve(self.candidates, self.template)

    # ---- evaluation ---------------------------------------------------------------------------------------------

    def _layouts(self, tagged: DataFrame) -> list[tuple[str, int, Layout]]:
        """Per order of events that occurs among the candidates (a template has few): number of models and layout."""
        found = tagged.where("pos = 1").groupBy("signature").count().collect()
        listed = self.template.events
        sizes = dict(zip(self.pops, self.sizes))
        return [
            (row.signature, row["count"], Layout([(int(k), listed[int(k)]) for k in row.signature.split(",")], sizes))
            for row in sorted(found)
        ]

    def _model_rows(self, events: DataFrame, layout: Layout, transposed: bool = False) -> tuple[DataFrame, dict[str, int]]:
        """One row per model: spectrum and transition matrix of every node, parent weights of every pulse."""
        used = {name: node for name, node in layout.nodes.items() if node.n > 0}
        ids = {name: k for k, name in enumerate(used)}
        known = ", ".join(f"'{name}', {node.n}" for name, node in used.items())
        lineages = f"coalesce(try_element_at(map({known}), node), 0)"
        ns = [node.n for node in used.values()]
        nodes = node_spectra(epochs(events), lineages).selectExpr(
            "model_id", "node", f"{spectrum_by_size_text(ns)} as arising", f"{moves_by_size_text(ns, transposed)} as moves"
        )
        picks = [
            F.expr(f"first(if(node = '{name}', {what}, null), true) as {what}_{k}")
            for name, k in ids.items() for what in ("arising", "moves")
        ]
        models = nodes.groupBy("model_id").agg(*picks)
        if layout.pulses:
            moved = events.where("kind = 'pulse'").groupBy("model_id").agg(
                *[F.expr(f"first(if(seq = {seq}, p, null), true) as p_{seq}") for seq in layout.pulses]
            )
            models = models.join(moved, "model_id")
            for seq, n in layout.pulses.items():
                models = models.withColumn(f"parents_{seq}", F.expr(_parents_text(n, f"p_{seq}", transposed))).drop(f"p_{seq}")
        return models, ids

    def evaluate(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``(model_id, *keep, value)``: expected spectrum times the ``tip_<pop>`` vectors of each row, per model.

        The result has one row per model and input row, so this is a join without a key. Where the weights of all tip
        observations fit in an array, each model computes them once, and a pair only adds up those that its row names: the
        rows, fixed and of known size, are what is broadcast. Else models are broadcast in buckets of known size, and the
        rows are spread over all cores, since each costs the same.
        """
        tagged = signed(self.events())
        layouts = self._layouts(tagged)
        small = [layout.joint_cells() <= JOINT_CELLS for _, _, layout in layouts]
        pieces = self._cells(rows, keep) if any(small) else []
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        parts = []
        for (signature, n_models, layout), joint in zip(layouts, small):
            mine = tagged.where(F.col("signature") == signature)
            if joint:
                models, ids = self._model_rows(mine, layout, transposed=True)
                weights = Joint(models, layout, ids, self.pops).df
                if layout.sample_meets_below_root():
                    # Branches above the ancestor of the whole sample, which a node below the root has counted.
                    weights = weights.selectExpr("model_id", "concat(slice(joint, 1, size(joint) - 1), array(0D)) as joint")
                for piece in pieces:
                    value = "aggregate(cells, 0D, (s, c) -> s + c.w * joint[c.i]) as value"
                    parts.append(weights.join(F.broadcast(piece)).selectExpr("model_id", *keep, value))
                continue
            buckets = -(-n_models * layout.bytes_per_model() // BROADCAST_BYTES)
            models, ids = self._model_rows(mine, layout)
            for k in range(buckets):
                some = models if buckets == 1 else models.where(f"pmod(xxhash64(model_id), {buckets}) = {k}")
                values = Assembly(rows.join(F.broadcast(some)), layout, ids).df
                if layout.sample_meets_below_root():
                    values = self._without_fixed(values, some, layout, ids)
                parts.append(values.select("model_id", *keep, "value"))
        return reduce(DataFrame.unionByName, parts)

    def _cells(self, rows: DataFrame, keep: Sequence[str]) -> list[DataFrame]:
        """Rows with the ``cells`` of the tips' joint tensor that they weigh, fixed, in pieces that may be broadcast."""
        flat = f"tip_{self.pops[0]}"
        for pop in self.pops[1:]:
            flat = f"flatten(transform({flat}, x -> transform(tip_{pop}, y -> x * y)))"
        places = f"transform({let('t', flat, 't')}, (w, i) -> named_struct('i', i, 'w', w))"
        listed = rows.selectExpr(*keep, f"filter({places}, c -> c.w is null or c.w <> 0D) as cells", "monotonically_increasing_id() as _nth")
        fixed = cut_lineage(listed)
        weight = fixed.selectExpr("coalesce(sum(200 + 40 * size(cells)), 0) as x").first().x
        pieces = max(1, -(-weight // BROADCAST_BYTES))
        if pieces == 1:
            return [fixed.drop("_nth")]
        return [fixed.where(f"pmod(xxhash64(_nth), {pieces}) = {k}").drop("_nth") for k in range(pieces)]

    def _without_fixed(self, values: DataFrame, models: DataFrame, layout: Layout, ids: dict[str, int]) -> DataFrame:
        """Take away branches above the ancestor of the whole sample, which a node below the root has counted."""
        ends = [f"{doubles([0.0] * n + [1.0])} as tip_{p}" for p, n in zip(self.pops, self.sizes)]
        one = values.sparkSession.range(1).selectExpr(*ends)
        fixed = Assembly(one.join(F.broadcast(models)), layout, ids).df.selectExpr("model_id", "value as fixed")
        share = " * ".join(f"element_at(tip_{p}, -1)" for p in self.pops)
        return values.join(fixed, "model_id").withColumn("value", F.expr(f"value - fixed * {share}"))

    def _tips(self, rows: DataFrame, error_matrices: Mapping[str, Sequence[Sequence[float]]] | None = None) -> DataFrame:
        """Observation vectors of configurations in ``anc`` and ``der`` (population order of the sweep)."""
        texts = []
        for i, (pop, n) in enumerate(zip(self.pops, self.sizes)):
            text = observation(f"anc[{i}]", f"der[{i}]", n)
            if error_matrices and pop in error_matrices:
                error = error_matrices[pop]
                if any(abs(sum(row[k] for row in error) - 1) > 1e-8 for k in range(n + 1)):
                    raise ValueError("columns of an error matrix must sum to 1")
                columns = [[error[j][k] for j in range(n + 1)] for k in range(n + 1)]
                text = let("o", text, apply_rows(matrix(columns), "o"))
            texts.append(f"{text} as tip_{pop}")
        return rows.selectExpr("*", *texts)

    # ---- expected spectra -----------------------------------------------------------------------------------------

    def normalisers(
        self, sizes: DataFrame, non_ascertained: Sequence[str] = (), error_matrices: Mapping | None = None
    ) -> DataFrame:
        """``(model_id, sizes, denom)``: total branch length seen as polymorphic by ``sizes`` calls per population.

        The all-ones row minus the rows for samples that are ancestral, or derived, throughout the ascertained ones.
        """
        mask = int_array_text([p not in non_ascertained for p in self.pops])
        zero = int_array_text([0] * len(self.pops))
        seen = f"zip_with(sizes, {mask}, (n, k) -> n * k)"
        rows = sizes.select("sizes").distinct().selectExpr(
            "sizes",
            f"inline(array(struct({zero} as anc, {zero} as der, 1D as sign), struct({seen} as anc, {zero} as der, -1D as sign),"
            f" struct({zero} as anc, {seen} as der, -1D as sign)))",
        )
        values = self.evaluate(self._tips(rows, error_matrices), ["sizes", "sign"])
        return values.groupBy("model_id", "sizes").agg(F.expr("sum(sign * value)").alias("denom"))

    def expected_sfs(
        self,
        configs: DataFrame,
        keep: Sequence[str] = (),
        normalized: bool = False,
        folded: bool = False,
        mut_rate: float = 1.0,
        non_ascertained: Sequence[str] = (),
        error_matrices: Mapping | None = None,
    ) -> DataFrame:
        """``(model_id, anc, der, *keep, value)`` for distinct configurations, for every model.

        ``normalized`` divides by the branch length that the same numbers of calls see as polymorphic, which makes the
        values probabilities. ``folded`` adds the allele-swapped configuration unless it is the same.
        """
        every = range(len(self.pops))
        base = configs.selectExpr("anc", "der", *keep)
        if folded:
            both = "if(anc = der, array(struct(anc as x, der as y)), array(struct(anc as x, der as y), struct(der as x, anc as y)))"
            oriented = base.selectExpr("anc as anc0", "der as der0", *keep, f"inline({both})")
            rows = oriented.withColumnsRenamed({"x": "anc", "y": "der"})
            values = self.evaluate(self._tips(rows, error_matrices), ["anc0", "der0", *keep])
            values = values.groupBy("model_id", "anc0", "der0", *keep).agg(F.sum("value").alias("value"))
            values = values.withColumnsRenamed({"anc0": "anc", "der0": "der"})
        else:
            values = self.evaluate(self._tips(base, error_matrices), ["anc", "der", *keep])
        values = values.withColumn("value", F.expr(f"if({polymorphic_text(every)}, value, 0D)"))
        if not normalized:
            return values.withColumn("value", F.expr(f"value * {float(mut_rate)!r}D"))
        sizes = configs.selectExpr(f"{sizes_text()} as sizes")
        denominators = self.normalisers(sizes, non_ascertained, error_matrices)
        joined = values.withColumn("sizes", F.expr(sizes_text())).join(denominators, ["model_id", "sizes"])
        return joined.selectExpr("model_id", "anc", "der", *keep, "try_divide(value, denom) as value")

    # ---- presets ------------------------------------------------------------------------------------------------

    def tensor_product(self, rows: Mapping[str, Mapping[str, Sequence[float]]]) -> DataFrame:
        """``(model_id, row, value)``: expected spectrum times given vectors; a population left out weighs 1."""
        spark = self.candidates.sparkSession
        listed = [
            (name, *[[float(x) for x in vectors.get(p, [1.0] * (n + 1))] for p, n in zip(self.pops, self.sizes)])
            for name, vectors in rows.items()
        ]
        schema = "row STRING, " + ", ".join(f"tip_{p} ARRAY<DOUBLE>" for p in self.pops)
        return self.evaluate(spark.createDataFrame(listed, schema), ["row"])

    def branch_length(self, non_ascertained: Sequence[str] = ()) -> DataFrame:
        """``(model_id, branch_length)``: expected total length of branches that make a site polymorphic."""
        spark = self.candidates.sparkSession
        full = spark.createDataFrame([(self.sizes,)], "sizes ARRAY<INT>")
        return self.normalisers(full, non_ascertained).selectExpr("model_id", "denom as branch_length")

    def tmrca(self) -> DataFrame:
        """``(model_id, tmrca)``: expected time to the common ancestor of the whole sample."""
        n = self.sizes[0]
        out = self.tensor_product({"t": {self.pops[0]: [i / n for i in range(n + 1)]}})
        return out.selectExpr("model_id", "value as tmrca")

    def deme_tmrca(self, pop: str) -> DataFrame:
        """``(model_id, tmrca)``: the same for the samples of one population."""
        n = int(self.sampled_n[pop])
        out = self.tensor_product({"t": {pop: [i / n for i in range(n)] + [0.0]}})
        return out.selectExpr("model_id", "value as tmrca")

    def heterozygosity(self, pops: Sequence[str] | None = None) -> DataFrame:
        """``(model_id, pop, e_het)``: expected pairwise differences per unit mutation rate in each population."""
        wanted = [p for p in (pops or self.pops) if self.sampled_n[p] >= 2]
        ones = lambda pop: int_array_text([int(p == pop) for p in self.pops])
        entries = ", ".join(f"struct('{p}' as pop, {ones(p)} as anc, {ones(p)} as der)" for p in wanted)
        rows = self.candidates.sparkSession.range(1).selectExpr(f"inline(array({entries}))")
        return self.evaluate(self._tips(rows), ["pop"]).withColumnRenamed("value", "e_het")


def _parents_text(n: int, p: str, transposed: bool = False) -> str:
    """Rows over (staying, moved) derived counts, columns over the derived count before the pulse, or transposed."""
    weights: dict = {}
    for d1, d2, d, by_m in two_parent_weights(n):
        weights.setdefault(d if transposed else (d1, d2), []).append(doubles(by_m))
    rows = "array(" + ", ".join(f"array({', '.join(cols)})" for cols in weights.values()) + ")"
    chance = f"transform(sequence(0, {n}), m -> ({comb_fold_text(str(n), 'm')}) * power(1D - {p}, m) * power({p}, {n} - m))"
    return let("c", chance, f"transform({rows}, row -> {'transform(row, w -> ' + dot('w', 'c') + ')'})")
