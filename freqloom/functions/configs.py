"""Expressions on allele configurations: two INT arrays, ``anc`` and ``der``, in population order.

Array arguments are SQL texts (usually column names) and results are Columns; building one SQL text per expression is much
cheaper on the driver than composing Column objects operator by operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANC, DER = "anc", "der"


def at_text(counts: str, index: int) -> str:
    return f"{counts}[{index}]"


def sum_text(counts: str, indices: Sequence[int]) -> str:
    return "(" + (" + ".join(at_text(counts, i) for i in indices) or "0") + ")"


def polymorphic_text(indices: Sequence[int], anc: str = ANC, der: str = DER) -> str:
    return f"({sum_text(anc, indices)} > 0 and {sum_text(der, indices)} > 0)"


def sizes_text(anc: str = ANC, der: str = DER) -> str:
    return f"zip_with({anc}, {der}, (a, d) -> a + d)"


def int_array_text(values: Sequence[int]) -> str:
    return "array(" + ", ".join(str(int(v)) for v in values) + ")"


def at(counts: str, index: int) -> Column:
    """Count of the population at ``index`` (0-based)."""
    return F.expr(at_text(counts, index))


def pick(counts: str, indices: Sequence[int]) -> Column:
    """Counts of the listed populations, in that order."""
    return F.expr("array(" + ", ".join(at_text(counts, i) for i in indices) + ")")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sizes(anc: str = ANC, der: str = DER) -> Column:
    """Non-missing calls per population."""
    return F.expr(sizes_text(anc, der))


def is_polymorphic(indices: Sequence[int], anc: str = ANC, der: str = DER) -> Column:
    """Both alleles seen among the listed populations."""
    return F.expr(polymorphic_text(indices, anc, der))


def is_complete(sampled_n: Sequence[int], anc: str = ANC, der: str = DER) -> Column:
    """No missing call in any population."""
    return F.expr(f"{sizes_text(anc, der)} = {int_array_text(sampled_n)}")


def folded_pair(anc: str = ANC, der: str = DER) -> tuple[Column, Column]:
    """Representative of {config, swapped config}: swap iff the ancestral vector sorts before the derived one."""
    pick_one = "case when {a} < {d} then {x} else {y} end"
    return (
        F.expr(pick_one.format(a=anc, d=der, x=der, y=anc)),
        F.expr(pick_one.format(a=anc, d=der, x=anc, y=der)),
    )


def config_key(anc: str = ANC, der: str = DER) -> Column:
    """Text form ``anc,der`` per population, tab separated."""
    return F.expr(f"concat_ws('\\t', zip_with({anc}, {der}, (a, d) -> concat(a, ',', d)))")


def parse_key(key: str) -> tuple[Column, Column]:
    """Inverse of :func:`config_key`."""
    side = "transform(split(trim({key}), '\\\\s+'), p -> cast(split(p, ',')[{k}] as int))"
    return F.expr(side.format(key=key, k=0)), F.expr(side.format(key=key, k=1))
