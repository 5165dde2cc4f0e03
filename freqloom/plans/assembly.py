"""The likelihood recursion of one event order as a chain of projections.

Each row carries, per cluster of populations that share ancestry, a flat tensor over derived counts and the spectrum mass
collected so far. Events in time order turn into column expressions on these arrays; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame

from freqloom.functions.constants import reduction_matrix, split_weights
from freqloom.functions.vectors import apply_rows, dot, doubles, let, map_rows, matrix, permuted, rows_of
from freqloom.plans.models import Event


@dataclass(frozen=True)
class Node:
    """A stretch of one population's history: name ``pop:number``, sampled leaves below it, lineages followed."""

    name: str
    leaves: frozenset[str]
    n: int


@dataclass
class Cluster:
    """Column suffix and axes (in tensor order) of one joint likelihood."""

    key: int
    axes: list[Node]


class Layout:
    """Walks the events of one order and records the nodes, the pulses and the steps to apply."""

    def __init__(self, events: Sequence[tuple[int, Event]], sampled_n: dict[str, int]):
        self.nodes: dict[str, Node] = {}
        self.pulses: dict[int, int] = {}
        self.steps: list[tuple] = []
        self._n = sampled_n
        self._now: dict[str, Node | None] = {}
        for seq, event in events:
            getattr(self, f"_{event.kind}")(seq, event)
        roots = [node for node in self._now.values() if node is not None]
        if len(roots) != 1:
            raise ValueError("a model must have a single root population")
        self.root = roots[0]

    def sample_meets_below_root(self) -> bool:
        """Does a node other than the root follow the lineages of the whole sample?"""
        return any(n.leaves == self.root.leaves and n.name != self.root.name for n in self.nodes.values())

    def bytes_per_model(self) -> int:
        """Size of the arrays one model carries."""
        nodes = sum((n.n + 1) * (n.n + 2) for n in self.nodes.values())
        return 8 * (nodes + sum((n + 1) ** 3 for n in self.pulses.values()))

    def joint_cells(self) -> int:
        """The most cells that one tensor over all present axes has, from the tips to the root."""
        sizes = {self.root.name: self.root.n + 1}
        most = 0
        for step in reversed(self.steps):
            if step[0] == "merge":
                a, b, above = step[1:]
                del sizes[above.name]
                sizes |= {a.name: a.n + 1, b.name: b.n + 1}
            elif step[0] == "split":
                source, stay, moved, _ = step[1:]
                del sizes[stay.name], sizes[moved.name]
                sizes[source.name] = source.n + 1
            most = max(most, prod(sizes.values()))
        return most

    def _new(self, name: str, leaves: frozenset[str]) -> Node:
        node = Node(name, leaves, sum(self._n[p] for p in leaves))
        self.nodes[name] = node
        return node

    def _next(self, pop: str, leaves: frozenset[str]) -> Node:
        number = int(self._now[pop].name.rsplit(":", 1)[1]) + 1
        return self._new(f"{pop}:{number}", leaves)

    def _present(self, pop: str) -> Node:
        """Current node of ``pop``; one that was never sampled starts without lineages."""
        if pop not in self._now:
            self._now[pop] = self._new(f"{pop}:1", frozenset())
            self.steps.append(("ghost", self._now[pop]))
        node = self._now[pop]
        if node is None:
            raise ValueError(f"population {pop} was removed by an earlier event")
        return node

    def _leaf(self, seq: int, event: Event) -> None:
        pop = event.pop1
        sampled = pop in self._n
        tip = self._new(f"{pop}:0", frozenset([pop] if sampled else []))
        self.steps.append(("tip", tip, pop) if sampled else ("ghost", tip))
        if pop not in self._now:
            self._now[pop] = tip
            return
        before = self._present(pop)
        above = self._next(pop, before.leaves | tip.leaves)
        # The tip joins its population at once: it has no length to close.
        self.steps += [("close", before), ("merge", tip, before, above)]
        self._now[pop] = above

    def _size(self, seq: int, event: Event) -> None:
        self._present(event.pop1)

    _growth = _size

    def _join(self, seq: int, event: Event) -> None:
        if event.pop1 not in self._now:
            return
        source, target = self._present(event.pop1), self._present(event.pop2)
        above = self._next(event.pop2, source.leaves | target.leaves)
        self.steps += [("close", source), ("close", target), ("merge", source, target, above)]
        self._now[event.pop1], self._now[event.pop2] = None, above

    def _pulse(self, seq: int, event: Event) -> None:
        if event.pop1 not in self._now:
            return
        source, target = self._present(event.pop1), self._present(event.pop2)
        stay = self._next(event.pop1, source.leaves)
        above = self._next(event.pop2, source.leaves | target.leaves)
        moved = Node(f"moved:{seq}", source.leaves, source.n)
        self.pulses[seq] = source.n
        self.steps += [
            ("close", source), ("close", target), ("split", source, stay, moved, seq), ("merge", moved, target, above)
        ]
        self._now[event.pop1], self._now[event.pop2] = stay, above


class Assembly:
    """Applies a layout to rows holding ``tip_<pop>`` vectors and the per-node arrays of their model."""

    def __init__(self, rows: DataFrame, layout: Layout, columns: dict[str, int]):
        self.df = rows
        self._id = columns
        self._clusters: list[Cluster] = []
        self._count = 0
        for step in layout.steps:
            getattr(self, f"_{step[0]}")(*step[1:])
        self._close_root(layout.root)

    def _find(self, node: Node) -> Cluster:
        return next(c for c in self._clusters if any(a.name == node.name for a in c.axes))

    def _fresh(self) -> int:
        self._count += 1
        return self._count

    def _project(self, drop: Sequence[Cluster], key: int, tensor: str, mass: str) -> None:
        gone = {f"{x}{c.key}" for c in drop for x in ("lik", "mass")}
        keep = [f"`{c}`" for c in self.df.columns if c not in gone]
        self.df = self.df.selectExpr(*keep, f"{tensor} as lik{key}", f"{mass} as mass{key}")

    def _replace(self, cluster: Cluster, axes: list[Node], tensor: str, mass: str) -> None:
        key = self._fresh()
        self._project([cluster], key, tensor, mass)
        cluster.key, cluster.axes = key, axes

    @staticmethod
    def _width(axes: Sequence[Node]) -> int:
        out = 1
        for a in axes:
            out *= a.n + 1
        return out

    def _last(self, cluster: Cluster, node: Node) -> tuple[str, list[Node]]:
        """Tensor text with ``node`` as last axis, and the new order of axes."""
        at = [a.name for a in cluster.axes].index(node.name)
        text = permuted(f"lik{cluster.key}", [a.n + 1 for a in cluster.axes], at)
        return text, [a for k, a in enumerate(cluster.axes) if k != at] + [cluster.axes[at]]

    def _tip(self, node: Node, pop: str) -> None:
        key = self._fresh()
        self._project([], key, f"tip_{pop}", "0D")
        self._clusters.append(Cluster(key, [node]))

    def _ghost(self, node: Node) -> None:
        key = self._fresh()
        self._project([], key, "array(1D)", "0D")
        self._clusters.append(Cluster(key, [node]))

    def _close(self, node: Node) -> None:
        """Collect the mass that arises in ``node`` and carry its axis to the node's upper end."""
        if node.n == 0:
            return
        cluster, k = self._find(node), self._id[node.name]
        text, axes = self._last(cluster, node)
        m = node.n + 1
        tensor = let("t", text, map_rows("t", self._width(axes[:-1]), m, apply_rows(f"moves_{k}", "v")))
        mass = f"mass{cluster.key} + {let('t', text, dot(f'slice(t, 1, {m})', f'arising_{k}'))}"
        self._replace(cluster, axes, tensor, mass)

    def _close_root(self, node: Node) -> None:
        cluster, k = self._find(node), self._id[node.name]
        self.df = self.df.withColumnRenamed(f"mass{cluster.key}", "_mass").selectExpr(
            "*", f"_mass + {dot(f'lik{cluster.key}', f'arising_{k}')} as value"
        )

    def _merge(self, a: Node, b: Node, above: Node) -> None:
        first, second = self._find(a), self._find(b)
        n = a.n + b.n
        weights = split_weights(a.n, b.n)
        pairs = lambda left, right: (
            f"transform(sequence(0, {n}), k -> aggregate(sequence(greatest(0, k - {b.n}), least({a.n}, k)), 0D,"
            f" (s, i) -> s + {left} * {right} * {doubles(weights.ravel())}[k * {a.n + 1} + i]))"
        )
        if first is second:
            # Two axes of one tensor: put them last, sum along antidiagonals, follow no more lineages than needed.
            text, axes = self._last(first, a)
            key = self._fresh()
            self._project([first], key, text, f"mass{first.key}")
            first.key, first.axes = key, axes
            text, axes = self._last(first, b)
            width = (a.n + 1) * (b.n + 1)
            body = pairs("v[i * %d + k - i]" % (b.n + 1), "1D")
            if above.n < n:
                columns = reduction_matrix(n, above.n).T
                body = let("e", body, apply_rows(matrix(columns), "e"))
            tensor = let("t", text, map_rows("t", self._width(axes[:-2]), width, body))
            self._replace(first, [*axes[:-2], above], tensor, f"mass{first.key}")
            return
        text1, axes1 = self._last(first, a)
        text2, axes2 = self._last(second, b)
        rest1, rest2 = axes1[:-1], axes2[:-1]
        body = (
            f"flatten(transform({rows_of('t', self._width(rest1), a.n + 1)}, v -> flatten(transform("
            f"{rows_of('u', self._width(rest2), b.n + 1)}, w -> {pairs('v[i]', 'w[k - i]')}))))"
        )
        tensor = let("t", text1, let("u", text2, body))
        mass = f"mass{first.key} * lik{second.key}[0] + mass{second.key} * lik{first.key}[0]"
        key = self._fresh()
        self._project([first, second], key, tensor, mass)
        self._clusters = [c for c in self._clusters if c is not first and c is not second]
        self._clusters.append(Cluster(key, [*rest1, *rest2, above]))

    def _split(self, source: Node, stay: Node, moved: Node, seq: int) -> None:
        """One axis becomes two: the alleles that stay and those that move."""
        cluster = self._find(source)
        text, axes = self._last(cluster, source)
        tensor = let("t", text, map_rows("t", self._width(axes[:-1]), source.n + 1, apply_rows(f"parents_{seq}", "v")))
        self._replace(cluster, [*axes[:-1], stay, moved], tensor, f"mass{cluster.key}")


class Joint:
    """A layout taken in reverse: one weight for each combination of derived counts at the tips, once per model.

    The result of :class:`Assembly` is linear in each tip vector, and derived alleles found in no other cluster's lineages stay
    so on the way up. So the weights of the state after a step give those before it: a closed node adds its own spectrum where
    all other axes are 0. ``df`` has the flat tensor ``joint`` over the tips of ``pops``; all observations read it.
    Node columns are as for :class:`Assembly`, with ``moves`` and ``parents`` transposed.
    """

    def __init__(self, models: DataFrame, layout: Layout, columns: dict[str, int], pops: Sequence[str]):
        self._id = columns
        self._axes = [layout.root]
        self._keep = ["model_id"] + [c for c in models.columns if c.startswith(("arising_", "moves_", "parents_"))]
        self._tips: dict[str, str] = {}
        self.df = models.selectExpr(*self._keep, f"arising_{columns[layout.root.name]} as joint")
        for step in reversed(layout.steps):
            getattr(self, f"_{step[0]}")(*step[1:])
        for pop in pops:
            self._to_end(self._tips[pop])
        self.df = self.df.select("model_id", "joint")

    def _set(self, text: str) -> None:
        self.df = self.df.selectExpr(*self._keep, f"{let('t', 'joint', text)} as joint")

    def _to_end(self, name: str) -> None:
        at = [a.name for a in self._axes].index(name)
        if at < len(self._axes) - 1:
            self._set(permuted("t", [a.n + 1 for a in self._axes], at))
            self._axes.append(self._axes.pop(at))

    def _others(self, last: int = 1) -> int:
        return prod(a.n + 1 for a in self._axes[:-last])

    def _tip(self, node: Node, pop: str) -> None:
        self._tips[pop] = node.name

    def _ghost(self, node: Node) -> None:
        self._axes = [a for a in self._axes if a.name != node.name]

    def _close(self, node: Node) -> None:
        if node.n == 0:
            return
        k, m = self._id[node.name], node.n + 1
        self._to_end(node.name)
        moved = map_rows("t", self._others(), m, apply_rows(f"moves_{k}", "v"))
        self._set(moved)
        arisen = f"zip_with(slice(t, 1, {m}), arising_{k}, (x, y) -> x + y)"
        self._set(arisen if self._others() == 1 else f"concat({arisen}, slice(t, {m + 1}, {(self._others() - 1) * m}))")

    def _merge(self, a: Node, b: Node, above: Node) -> None:
        self._to_end(above.name)
        n, others = a.n + b.n, self._others()
        if above.n < n:
            self._set(map_rows("t", others, above.n + 1, apply_rows(matrix(reduction_matrix(n, above.n)), "v")))
        cells = [(i + j, i) for i in range(a.n + 1) for j in range(b.n + 1)]
        weights = split_weights(a.n, b.n)
        places = f"array({', '.join(str(k) for k, _ in cells)})"
        body = f"zip_with({places}, {doubles(weights[k, i] for k, i in cells)}, (q, x) -> v[q] * x)"
        self._set(map_rows("t", others, n + 1, body))
        self._axes[-1:] = [a, b]

    def _split(self, source: Node, stay: Node, moved: Node, seq: int) -> None:
        self._to_end(stay.name)
        self._to_end(moved.name)
        self._set(map_rows("t", self._others(2), (source.n + 1) ** 2, apply_rows(f"parents_{seq}", "v")))
        self._axes[-2:] = [source]
