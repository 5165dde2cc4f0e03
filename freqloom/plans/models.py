"""Demographic models as tables.

A *template* lists the events of a model; every value is a number or a SQL expression over parameter columns. A *sweep*
is a template applied to a table of candidates, one row per model. All models are resolved, ordered and cut into epochs
together. Times are scaled by 4 N_e gen_time, sizes by N_e and growth rates by its inverse time unit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.configs import quoted
from freqloom.functions.scalar import expit_text, expm1_ratio_text, logit_text, truncated_exponential_text, uniform_text
from freqloom.session import cut_lineage

Value = float | int | str | None

# Order of kinds at equal times.
KIND_RANK = {"leaf": 0, "size": 1, "growth": 1, "join": 2, "pulse": 2}


@dataclass(frozen=True)
class Event:
    """``kind`` is leaf, size, growth, join (pop1 into pop2) or pulse (a part p of pop1 into pop2)."""

    kind: str
    pop1: str
    t: Value
    pop2: str | None = None
    p: Value = None
    n: Value = None
    g: Value = None


@dataclass(frozen=True)
class Parameter:
    """A random parameter: its draw, transform to the unbounded scale and back, as SQL texts over earlier columns.

    ``draw`` may use ``{u}``, a uniform number; ``scaled`` and ``unscaled`` use ``{x}``.
    """

    name: str
    draw: str
    scaled: str = "{x}"
    unscaled: str = "{x}"
    lower: str | None = None
    upper: str | None = None


@dataclass
class Template:
    """Builder for the events and parameters of a model."""

    n_e: float
    gen_time: float = 1.0
    muts_per_gen: float | None = None
    leaves: list[str] = field(default_factory=list)
    parameters: list[Parameter] = field(default_factory=list)
    _leaf_events: list[Event] = field(default_factory=list)
    _size_events: list[Event] = field(default_factory=list)
    _topology_events: list[Event] = field(default_factory=list)

    def add_leaf(self, pop: str, t: Value = 0, n: Value = None, g: Value = None) -> Template:
        self.leaves.append(pop)
        self._leaf_events.append(Event("leaf", pop, t))
        return self._sized(pop, t, n, g)

    def move_lineages(
        self, source: str, target: str, t: Value, p: Value = 1, n: Value = None, g: Value = None
    ) -> Template:
        """Backwards in time, each lineage of ``source`` moves to ``target`` with probability ``p``."""
        if p == 1:
            self._topology_events.append(Event("join", source, t, target))
        else:
            self._topology_events.append(Event("pulse", source, t, target, p=p))
        return self._sized(target, t, n, g)

    def _sized(self, pop: str, t: Value, n: Value, g: Value) -> Template:
        if n is not None:
            self.set_size(pop, t, n)
        if g is not None:
            self.set_size(pop, t, None, g)
        return self

    def set_size(self, pop: str, t: Value, n: Value = None, g: Value = 0) -> Template:
        """Set the size, and the growth rate with it (0 unless given)."""
        if n is not None:
            self._size_events.append(Event("size", pop, t, n=n))
        self._size_events.append(Event("growth", pop, t, g=g))
        return self

    @property
    def events(self) -> list[Event]:
        return [*self._leaf_events, *self._size_events, *self._topology_events]

    @property
    def time_scale(self) -> float:
        return 4.0 * self.n_e * self.gen_time

    # ---- parameters ---------------------------------------------------------------------------------------------

    def add_parameter(self, parameter: Parameter) -> Template:
        if parameter.name in {p.name for p in self.parameters}:
            raise ValueError(f"parameter {parameter.name} exists already")
        self.parameters.append(parameter)
        return self

    def add_size_param(self, name: str, lower: float = 1, upper: float = 1e10, draw: str | None = None) -> Template:
        draw = draw or truncated_exponential_text("{u}", f"{float(lower)!r}D", f"{float(upper)!r}D", self.n_e)
        bounds = (f"ln({float(lower)!r}D)", f"ln({float(upper)!r}D)")
        return self.add_parameter(Parameter(name, draw, "ln({x})", "exp({x})", *bounds))

    def add_time_param(
        self, name: str, lower: float = 0.0, upper: float | None = None, lower_constraints: Sequence[str] = (),
        upper_constraints: Sequence[str] = (), draw: str | None = None,
    ) -> Template:
        """A time between bounds that may be earlier parameters; logit scale when bounded above, else an offset."""
        low = _extreme("greatest", [f"{float(lower)!r}D", *lower_constraints])
        tops = [*upper_constraints, *([] if upper is None else [f"{float(upper)!r}D"])]
        high = _extreme("least", tops) if tops else None
        draw = draw or truncated_exponential_text("{u}", low, high, self.n_e * self.gen_time)
        if high is None:
            return self.add_parameter(Parameter(name, draw, f"{{x}} - {low}", f"{low} + {{x}}", "1e-12D"))
        share = f"({{x}} - {low}) / ({high} - {low})"
        back = f"(1D - {expit_text('{x}')}) * {low} + {expit_text('{x}')} * {high}"
        return self.add_parameter(Parameter(name, draw, logit_text(share), back))

    def add_pulse_param(self, name: str, lower: float = 0.0, upper: float = 1.0, draw: str | None = None) -> Template:
        draw = draw or f"{float(lower)!r}D + {{u}} * {float(upper - lower)!r}D"
        bounds = (
            None if lower == 0 else logit_text(f"{float(lower)!r}D"), None if upper == 1 else logit_text(f"{float(upper)!r}D")
        )
        return self.add_parameter(Parameter(name, draw, logit_text("{x}"), expit_text("{x}"), *bounds))

    def add_growth_param(self, name: str, lower: float = -1e-3, upper: float = 1e-3, draw: str | None = None) -> Template:
        draw = draw or f"{float(lower)!r}D + {{u}} * {float(upper - lower)!r}D"
        return self.add_parameter(Parameter(name, draw, lower=f"{float(lower)!r}D", upper=f"{float(upper)!r}D"))


def _extreme(function: str, texts: Sequence[str]) -> str:
    return texts[0] if len(texts) == 1 else f"{function}({', '.join(texts)})"


# ---- candidates -------------------------------------------------------------------------------------------------


def draw_candidates(
    models: DataFrame, template: Template, seed: int = 0, uniform: Callable[[int], str] | None = None
) -> DataFrame:
    """One random value per parameter for each row of ``models(model_id, ...)``, in parameter order.

    A uniform number is a hash of (model, parameter, seed), so the draw does not depend on the partitioning. ``uniform`` may
    give the SQL text of another number in [0, 1) for the i-th parameter.
    """
    uniform = uniform or (lambda i: uniform_text("model_id", str(i), str(int(seed))))
    out = models
    for i, parameter in enumerate(template.parameters):
        out = out.withColumn(parameter.name, F.expr(parameter.draw.format(u=uniform(i))))
    return out


def scaled_parameters(candidates: DataFrame, template: Template) -> DataFrame:
    """Parameters on their unbounded scale."""
    return candidates.select(
        "model_id", *[F.expr(p.scaled.format(x=p.name)).alias(p.name) for p in template.parameters]
    )


def unscaled_parameters(scaled: DataFrame, template: Template) -> DataFrame:
    """Inverse of :func:`scaled_parameters`; bounds may refer to parameters restored before."""
    out = scaled
    for p in template.parameters:
        out = out.withColumn(p.name, F.expr(p.unscaled.format(x=p.name)))
    return out


# ---- resolution and ordering --------------------------------------------------------------------------------------


def _text(value: Value) -> str:
    return "cast(null as double)" if value is None else f"double({value})"


def resolve(candidates: DataFrame, template: Template) -> DataFrame:
    """``(model_id, seq, kind, pop1, pop2, t, p, n, g)`` in scaled units: a projection and a generator, no join."""
    quote = lambda s: "cast(null as string)" if s is None else quoted(s)
    time, size, rate = template.time_scale, template.n_e, 0.25 / template.n_e / template.gen_time
    entries = ", ".join(
        f"struct({i} as seq, '{e.kind}' as kind, {quote(e.pop1)} as pop1, {quote(e.pop2)} as pop2,"
        f" {_text(e.t)} / {time!r}D as t, {_text(e.p)} as p, {_text(e.n)} / {size!r}D as n, {_text(e.g)} / {rate!r}D as g)"
        for i, e in enumerate(template.events)
    )
    return candidates.selectExpr("model_id", f"inline(array({entries}))")


def ordered(events: DataFrame) -> DataFrame:
    """Events with their position ``pos`` in each model: by time, then leaves, sizes, topology, then listing order."""
    rank = "element_at(map(" + ", ".join(f"'{k}', {v}" for k, v in KIND_RANK.items()) + "), kind)"
    return events.selectExpr(
        "*", f"row_number() over (partition by model_id order by t, {rank}, seq) as pos"
    )


def signed(events: DataFrame) -> DataFrame:
    """Ordered events with ``signature``, the order of their model's events; models that share it share their graph.

    Every window of this module is partitioned by the model first, so one shuffle by model serves them all.
    """
    return ordered(events).selectExpr(
        "*",
        "array_join(transform(array_sort(collect_list(struct(pos, seq)) over (partition by model_id)), x -> string(x.seq)), ',')"
        " as signature",
    )


def timelines(events: DataFrame) -> DataFrame:
    """Change points of every population: ``(model_id, pop, pos, step, t, set_n, set_g, bump, ends)``.

    ``bump`` marks the start of a new node; a population that is not sampled when it first appears starts at node 1, and
    one that is sampled after it appeared passes through a node of no length before its next node.
    """
    o = events if "pos" in events.columns else ordered(events)
    touches = o.selectExpr(
        "model_id", "pos", "t", "kind", "n", "g",
        "inline(case when kind in ('join', 'pulse') then array(struct(pop1 as pop, 'source' as side), struct(pop2 as pop, 'target' as side))"
        " else array(struct(pop1 as pop, 'self' as side)) end)",
    )
    # A source that does not exist yet has no lineages to move: the event does nothing for either side.
    first = touches.selectExpr("*", "row_number() over (partition by model_id, pop order by pos) as nth").selectExpr(
        "*", "max(nth = 1 and side = 'source') over (partition by model_id, pos) as idle"
    )
    live = first.where("not idle").selectExpr(
        "*", "row_number() over (partition by model_id, pop order by pos) as rank"
    )
    appears = "struct(0 as step, 1D as set_n, 0D as set_g, if(kind = 'leaf', 0, 1) as bump, false as ends)"
    changes = (
        "struct(1 as step, if(kind = 'size', n, null) as set_n, case kind when 'size' then 0D when 'growth' then g end as set_g,"
        " if(kind in ('join', 'pulse', 'leaf') and not (kind = 'join' and side = 'source'), 1, 0) as bump,"
        " kind = 'join' and side = 'source' as ends)"
    )
    return live.selectExpr(
        "model_id", "pop", "pos", "t",
        f"inline(case when rank > 1 then array({changes}) when kind = 'leaf' then array({appears})"
        f" else array({appears}, {changes}) end)",
    )


def epochs(events: DataFrame) -> DataFrame:
    """Epochs of constant growth: ``(model_id, pop, node, epoch, t, tau, n, g, n_top, scaled_time)``.

    Sizes and growth rates carry on from one change point to the next; a size decays by the growth since it was set.
    """
    by_pop = "partition by model_id, pop order by pos, step"
    spans = timelines(events).selectExpr(
        "*",
        f"sum(bump) over ({by_pop}) as node",
        f"coalesce(lead(t) over ({by_pop}), double('infinity')) - t as tau",
        f"last_value(set_g, true) over ({by_pop}) as g",
        f"sum(if(set_n is null, 0, 1)) over ({by_pop}) as era",
    )
    in_era = "partition by model_id, pop, era order by pos, step"
    sized = spans.where("not ends").selectExpr(
        "*",
        f"first_value(set_n) over ({in_era}) * exp(-coalesce(sum(if(g = 0, 0D, g * tau)) over"
        f" ({in_era} rows between unbounded preceding and 1 preceding), 0D)) as n",
    )
    return sized.selectExpr(
        "model_id", "pop", "node",
        "row_number() over (partition by model_id, pop, node order by pos, step) - 1 as epoch",
        "t", "tau", "n", "g", "if(g = 0, n, n * exp(-g * tau)) as n_top",
        f"case when tau = double('infinity') then tau when g = 0 then 2D * tau / n"
        f" else 2D * tau / n * {expm1_ratio_text('g * tau')} end as scaled_time",
    )


def violations(events: DataFrame) -> DataFrame:
    """``(model_id, rule)`` for every broken rule of a model."""
    o = ordered(events)
    removed = o.where("kind = 'join'").selectExpr("model_id", "pop1 as pop", "pos as gone")
    used = o.selectExpr(
        "model_id", "pos", "kind", "explode(array_compact(array(pop1, pop2))) as pop"
    )
    late = used.join(removed, ["model_id", "pop"]).where("pos > gone").selectExpr(
        "model_id",
        "case when kind = 'leaf' then 'leaf_after_removal' when kind in ('size', 'growth') then 'size_after_removal'"
        " else 'lineages_after_removal' end as rule",
    )
    values = o.selectExpr(
        "model_id",
        "explode(array_compact(array("
        "if(kind = 'pulse' and (p < 0 or p > 1), 'pulse_probability', null), if(t < 0, 'negative_time', null),"
        "if(kind = 'size' and n < 0, 'negative_size', null), if(kind = 'size' and n = 0, 'zero_size', null),"
        "if(isnan(coalesce(t, 0D)) or isnan(coalesce(n, 0D)) or isnan(coalesce(p, 0D)) or isnan(coalesce(g, 0D)),"
        " 'not_a_number', null)))) as rule",
    )
    pieces = epochs(events)
    growing = pieces.where("tau = double('infinity') and g <> 0").selectExpr("model_id", "'final_growth' as rule")
    roots = pieces.where("tau = double('infinity')").groupBy("model_id").agg(F.count_distinct("pop").alias("k")).where(
        "k > 1"
    ).selectExpr("model_id", "'more_than_one_root' as rule")
    return late.unionByName(values).unionByName(growing).unionByName(roots).distinct()


def edges(events: DataFrame) -> DataFrame:
    """``(model_id, pos, parent, child, prob)`` between nodes written ``pop:number``."""
    live = timelines(events).selectExpr(
        "model_id", "pop", "pos", "step", "bump", "ends",
        "sum(bump) over (partition by model_id, pop order by pos, step) as node",
    )
    moves = ordered(events).where("kind in ('join', 'pulse', 'leaf')").select("model_id", "pos", "kind", "pop1", "pop2", "p")
    after = live.where("step = 1")
    node = lambda side: after.selectExpr(
        "model_id", "pos", f"pop as {side}", f"node as {side}_node", f"bump as {side}_bump"
    )
    joined = moves.join(node("pop1"), ["model_id", "pos", "pop1"]).join(node("pop2"), ["model_id", "pos", "pop2"], "left")
    up1, up2 = "concat(pop1, ':', pop1_node)", "concat(pop2, ':', pop2_node)"
    below1, below2 = "concat(pop1, ':', pop1_node - pop1_bump)", "concat(pop2, ':', pop2_node - pop2_bump)"
    arrow = lambda parent, child, prob: f"struct({parent} as parent, {child} as child, double({prob}) as prob)"
    return joined.selectExpr(
        "model_id", "pos",
        "inline(case kind"
        f" when 'join' then array({arrow(up2, below1, 1)}, {arrow(up2, below2, 1)})"
        f" when 'pulse' then array({arrow(up1, below1, '1 - p')}, {arrow(up2, below1, 'p')}, {arrow(up2, below2, 1)})"
        " else array(" + arrow(up1, "concat(pop1, ':0')", 1) + ", " + arrow(up1, below1, 1) + ") end)",
    )


def lineages(events: DataFrame, sampled_n: Mapping[str, int]) -> DataFrame:
    """``(model_id, node, n)``: sampled alleles below every node.

    Models whose events come in the same order share their graph, so only one model of each order is looked at. Ancestors
    are found by doubling: paths of up to 1, 2, 4, ... edges are joined with themselves until no pair is new, so the rounds are
    about the logarithm of the graph's depth, whatever the number of events. Each round is fixed in the checkpoint folder:
    the plan does not grow. Calling this runs these rounds.
    """
    orders = signed(events).select("model_id", "signature").distinct()
    one = orders.groupBy("signature").agg(F.min("model_id").alias("model_id"))
    graph = edges(events.join(one, "model_id", "left_semi")).select("model_id", "child", "parent").distinct()
    nodes = graph.selectExpr("model_id", "inline(array(struct(child as node), struct(parent as node)))").distinct()
    paths = cut_lineage(graph.unionByName(nodes.selectExpr("model_id", "node as child", "node as parent")))
    known, size = -1, paths.count()
    while size != known:
        step = paths.selectExpr("model_id", "child as parent", "parent as top")
        paths = cut_lineage(paths.join(step, ["model_id", "parent"]).selectExpr("model_id", "child", "top as parent").distinct())
        known, size = size, paths.count()
    tips = ", ".join(f"struct({quoted(p + ':0')} as child, {int(n)} as n)" for p, n in sampled_n.items())
    leaves = one.selectExpr("model_id", f"inline(array({tips}))")
    above = leaves.join(paths, ["model_id", "child"], "left").selectExpr("model_id", "coalesce(parent, child) as node", "n")
    below = above.groupBy("model_id", "node").agg(F.sum("n").alias("n"))
    shared = below.join(one, "model_id").select("signature", "node", "n")
    return orders.join(shared, "signature").select("model_id", "node", "n")


def bound_violations(candidates: DataFrame, template: Template) -> DataFrame:
    """``(model_id, rule)``: one row ``bounds:<parameter>`` for each value outside its parameter's bounds.

    Bounds are those of the unbounded scale; a value that has no place on that scale (a time outside its interval, a size
    that is not positive, null or NaN) is outside too.
    """
    entries = []
    for parameter in template.parameters:
        x = parameter.scaled.format(x=parameter.name)
        outside = [f"({x}) is null", f"isnan({x})"]
        outside += [f"({x}) < {parameter.lower}"] if parameter.lower else []
        outside += [f"({x}) > {parameter.upper}"] if parameter.upper else []
        entries.append(f"if({' or '.join(outside)}, {quoted('bounds:' + parameter.name)}, null)")
    return candidates.selectExpr("model_id", f"explode(array_compact(array({', '.join(entries)}))) as rule")
