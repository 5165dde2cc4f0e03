"""Arrays of doubles as small vectors and matrices inside SQL texts.

Whatever a lambda reads repeatedly is bound first with :func:`let`: the optimizer may put the expression behind a column
name in its place, and inside a lambda that expression would be computed again for every element.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from freqloom.functions.scalar import comb_fold_text


def doubles(values: Iterable[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def matrix(rows: Iterable[Iterable[float]]) -> str:
    return "array(" + ", ".join(doubles(row) for row in rows) + ")"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, z) -> s + z)"


def apply_rows(rows: str, vector: str) -> str:
    """Matrix (array of rows) times vector; ``vector`` must be a name."""
    return f"transform({rows}, w -> {dot('w', vector)})"


def rows_of(flat: str, n_rows: int, width: int) -> str:
    """Flat tensor as an array of rows of its last axis; ``flat`` must be a name."""
    if n_rows == 1:
        return f"array({flat})"
    return f"transform(sequence(0, {n_rows - 1}), r -> slice({flat}, r * {width} + 1, {width}))"


def map_rows(flat: str, n_rows: int, width: int, body: str) -> str:
    """Apply ``body`` (over a row called ``v``) to each row and flatten the results."""
    return f"flatten(transform({rows_of(flat, n_rows, width)}, v -> {body}))"


def permuted(flat: str, shape: Sequence[int], last: int) -> str:
    """Flat tensor with axis ``last`` moved to the end."""
    if last == len(shape) - 1:
        return flat
    strides, step = [0] * len(shape), 1
    for k in reversed(range(len(shape))):
        strides[k] = step
        step *= shape[k]
    order = [k for k in range(len(shape)) if k != last] + [last]
    places = [0]
    for k in order:
        places = [base + i * strides[k] for base in places for i in range(shape[k])]
    return let("m", flat, f"transform(array({', '.join(map(str, places))}), q -> m[q])")


def observation(anc: str, der: str, n: int) -> str:
    """Chance of a sub-sample with ``anc`` and ``der`` alleles for each derived count 0..n of the full sample."""
    hit, miss = comb_fold_text("x", der), comb_fold_text(f"{n} - x", anc)
    return f"transform(sequence(0, {n}), x -> ({hit}) * ({miss}) / ({comb_fold_text(str(n), f'{anc} + {der}')}))"
