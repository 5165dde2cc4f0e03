"""Dimension data that depends on sample sizes only: spectrum weights, Moran eigenvectors, sampling matrices."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import comb, factorial

import numpy as np


@lru_cache(None)
def spectrum_weights(n: int) -> tuple[tuple[float, ...], ...]:
    """``w[b - 1][j - 2]``: expected spectrum entry b per unit of expected first coalescence time of j lineages.

    The number of ancestors of n lineages has the exponential mixture of Tavare (1984); a branch present while k
    ancestors remain has b of n descendants with the probability of Fu (1995). Summed in exact fractions.
    """
    rising = lambda x, k: factorial(x + k - 1) // factorial(x - 1)
    out = []
    for b in range(1, n):
        row = []
        for j in range(2, n + 1):
            total = Fraction(0)
            for k in range(2, j + 1):
                if k - 2 > n - b - 1:
                    continue
                descend = Fraction(comb(n - b - 1, k - 2), comb(n - 1, k - 1))
                mixture = Fraction(
                    (2 * j - 1) * (-1) ** (j - k) * rising(k, j - 1) * (factorial(n) // factorial(n - j)),
                    factorial(k) * factorial(j - k) * rising(n, j),
                )
                total += k * descend * mixture
            row.append(float(total))
        out.append(tuple(row))
    return tuple(out)


@lru_cache(None)
def moran_system(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right eigenvectors, rates and inverse eigenvectors of the Moran generator on 0..n derived alleles.

    Allele counts step up and down at rate i (n - i) / 2 each, with eigenvalues -j (j - 1) / 2. Interior states are
    reversible, so that block is solved as a symmetric matrix; the two fixed states carry the stationary vectors.
    """
    inner = np.arange(1, n)
    rate = inner * (n - inner) / 2.0
    sym = np.diag(-2.0 * rate) + np.diag(np.sqrt(rate[:-1] * rate[1:]), 1) + np.diag(np.sqrt(rate[:-1] * rate[1:]), -1)
    values, q = np.linalg.eigh(sym) if n > 1 else (np.zeros(0), np.zeros((0, 0)))
    scale = np.sqrt(rate)
    right = np.zeros((n + 1, n + 1))
    left = np.zeros((n + 1, n + 1))
    right[:, 0], right[:, 1] = 1.0 - np.arange(n + 1) / n, np.arange(n + 1) / n
    right[1:n, 2:] = q * scale[:, None]
    left[2:, 1:n] = (q / scale[:, None]).T
    # The rows for the fixed states pick the end points; the others subtract what the linear vectors explain.
    left[0, 0] = left[1, n] = 1.0
    left[2:, 0] = -left[2:, 1:n] @ right[1:n, 0]
    left[2:, n] = -left[2:, 1:n] @ right[1:n, 1]
    return right, np.concatenate(([0.0, 0.0], -values)), left


@lru_cache(None)
def split_weights(n1: int, n2: int) -> np.ndarray:
    """``w[k, i]``: chance that i of k derived alleles fall among the first n1 of n1 + n2 lineages."""
    n = n1 + n2
    return np.array([
        [comb(n1, i) * comb(n2, k - i) / comb(n, k) if 0 <= k - i <= n2 else 0.0 for i in range(n1 + 1)] for k in range(n + 1)
    ])


@lru_cache(None)
def reduction_matrix(big: int, small: int) -> np.ndarray:
    """``m[k, j]`` re-expressing a likelihood on ``big`` lineages by one on ``small`` lineages (pseudo-inverse)."""
    down = np.array([
        [comb(k, j) * comb(big - k, small - j) / comb(big, small) for k in range(big + 1)] for j in range(small + 1)
    ])
    return np.linalg.pinv(down)


@lru_cache(None)
def two_parent_weights(n: int) -> list[tuple[int, int, int, list[float]]]:
    """``(d1, d2, d, by_m)``: chance of d derived among n alleles when m come from the first parent, n - m from the second.

    Both parents hold n lineages, d1 and d2 of them derived; ``by_m`` lists m = 0..n.
    """
    def draw(x: int, d: int, m: int) -> float:
        return comb(d, x) * comb(n - d, m - x) / comb(n, m) if 0 <= x <= d and 0 <= m - x <= n - d else 0.0

    return [
        (d1, d2, d, [sum(draw(x, d1, m) * draw(d - x, d2, n - m) for x in range(d + 1)) for m in range(n + 1)])
        for d1 in range(n + 1) for d2 in range(n + 1) for d in range(n + 1)
    ]


@lru_cache(None)
def panel_quadrature(panels: int = 8, order: int = 10) -> tuple[tuple[float, float], ...]:
    """Gauss-Legendre nodes and weights on [0, 1] in equal panels."""
    x, w = np.polynomial.legendre.leggauss(order)
    return tuple(
        (float((k + (xi + 1) / 2) / panels), float(wi / 2 / panels)) for k in range(panels) for xi, wi in zip(x, w)
    )
