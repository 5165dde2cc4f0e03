"""Scalar formulas as SQL texts: combinatorics, log-gamma, links and truncated draws.

Arguments and results are SQL expressions for ``F.expr``. Constants carry the D suffix so that they are DOUBLE.
"""

from __future__ import annotations

from math import factorial

# Up to this subset size a binomial coefficient is written out as one product; beyond it a fold keeps the plan small.
UNROLL_LIMIT = 16

# Up to this fixed number of draws the hypergeometric distribution is written out.
UNROLL_DRAWS = 8

# Lanczos approximation of the gamma function, g = 7, nine coefficients.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
LOG_SQRT_2PI = 0.91893853320467274178


def product_text(factors: list[str]) -> str:
    """Product of SQL texts; the empty product is 1."""
    return " * ".join(f"({f})" for f in factors) if factors else "1D"


def falling_text(x: str, k: int) -> str:
    """x (x-1) ... (x-k+1); zero for whole numbers 0 <= x < k."""
    return product_text([f"({x}) - {i}D" for i in range(k)])


def comb_text(n: str, k: int) -> str:
    """C(n, k) for a non-negative integer expression and a fixed k; zero where k > n or k < 0."""
    if k < 0:
        return "0D"
    if k <= UNROLL_LIMIT:
        return f"{product_text([f'({n}) - {k - i}D' for i in range(1, k + 1)])} / {float(factorial(k))}D" if k else "1D"
    return comb_fold_text(n, str(k))


def comb_fold_text(n: str, k: str) -> str:
    """C(n, k) with both arguments per row; zero outside 0 <= k <= n."""
    fold = f"aggregate(sequence(1, greatest(int({k}), 1)), 1D, (acc, i) -> acc * (({n}) - ({k}) + i) / i)"
    return f"case when ({k}) < 0 or ({k}) > ({n}) then 0D when ({k}) = 0 then 1D else {fold} end"


def log_gamma_plus_one_text(x: str) -> str:
    """ln Gamma(x + 1) for x >= 0."""
    x = f"double({x})"
    series = " + ".join([f"{LANCZOS[0]!r}D", *[f"({c!r}D) / ({x} + {i}D)" for i, c in enumerate(LANCZOS[1:], start=1)]])
    t = f"({x} + {LANCZOS_G + 0.5}D)"
    return f"({LOG_SQRT_2PI!r}D + ({x} + 0.5D) * ln({t}) - {t} + ln({series}))"


def expm1_ratio_text(x: str) -> str:
    """(exp(x) - 1) / x, continued by its series around 0."""
    series = f"1D + ({x}) / 2D + ({x}) * ({x}) / 6D + ({x}) * ({x}) * ({x}) / 24D"
    return f"(case when abs({x}) < 1e-4 then {series} else expm1({x}) / ({x}) end)"


def floored_log_text(p: str, floor: float = 1e-100) -> str:
    """ln(p) with probabilities below ``floor`` raised to it."""
    return f"ln(greatest({p}, {floor!r}D))"


def logit_text(p: str) -> str:
    return f"ln(({p}) / (1D - ({p})))"


def expit_text(x: str) -> str:
    return f"(1D / (1D + exp(-({x}))))"


def truncated_exponential_text(u: str, low: str, high: str | None, scale: float) -> str:
    """Inverse CDF at ``u`` of an exponential with mean ``scale`` restricted to [low, high)."""
    mass = "1D" if high is None else f"(-expm1(-(({high}) - ({low})) / {float(scale)!r}D))"
    return f"(({low}) - {float(scale)!r}D * log1p(-({u}) * {mass}))"


def uniform_text(*keys: str) -> str:
    """A reproducible number in [0, 1) by a hash of the keys."""
    return f"(pmod(xxhash64({', '.join(keys)}), {1 << 52}) / {float(1 << 52)}D)"


def md5_uniform_text(*keys: str) -> str:
    """The same by MD5 of the keys' text forms, joined by slashes: other systems can draw the same numbers."""
    return f"(cast(conv(substr(md5(concat_ws('/', {', '.join(keys)})), 1, 13), 16, 10) as bigint) / {float(1 << 52)}D)"


def hypergeometric_draw_text(u: str, population: str, hits: str, draws: str) -> str:
    """How many of ``draws`` from ``population`` with ``hits`` hits are hits: the inverse distribution at ``u`` in [0, 1).

    Probabilities follow from one another, in logarithms, beginning nine deviations below the mean or at the smallest
    possible number, so the steps go with the deviation, not with the size of the population. A small fixed number of draws
    is written out as sums of products instead. Arguments are named often and should be columns or variables.
    """
    if draws.isdigit() and 0 < int(draws) <= UNROLL_DRAWS:
        return _few_draws_text(u, population, hits, int(draws))
    size, k, n = f"double({population})", f"double({hits})", f"double({draws})"
    lf = log_gamma_plus_one_text
    spread = f"sqrt({n} * ({k} / {size}) * (1D - {k} / {size}) * greatest({size} - {n}, 0D) / greatest({size} - 1D, 1D))"
    low = f"greatest(0D, {n} + {k} - {size}, floor({n} * {k} / {size} - 9D * {spread}) - 9D)"
    high = f"least({n}, {k}, ceil({n} * {k} / {size} + 9D * {spread}) + 9D)"
    first = (
        f"{lf(k)} - {lf('b.low')} - {lf(f'{k} - b.low')} + {lf(f'{size} - {k}')} - {lf(f'{n} - b.low')}"
        f" - {lf(f'{size} - {k} - {n} + b.low')} - {lf(size)} + {lf(n)} + {lf(f'{size} - {n}')}"
    )
    more = f"ln(({k} - s.at) * ({n} - s.at) / ((s.at + 1D) * ({size} - {k} - {n} + s.at + 1D)))"
    # A state: the last number looked at, its log-probability, and what of u lies beyond it.
    start = f"named_struct('at', b.low, 'lp', {first}, 'left', {u} - exp({first}))"
    step = f"if(s.left < 0D, s, named_struct('at', s.at + 1D, 'lp', s.lp + {more}, 'left', s.left - exp(s.lp + {more})))"
    fold = f"if(b.low >= b.high, b.low, aggregate(sequence(1L, bigint(b.high - b.low)), {start}, (s, i) -> {step}, s -> s.at))"
    return (
        f"if({draws} = 0 or {hits} = 0, 0L, if({draws} >= {population}, bigint({hits}),"
        f" bigint(transform(array(named_struct('low', {low}, 'high', {high})), b -> {fold})[0])))"
    )


def _few_draws_text(u: str, population: str, hits: str, draws: int) -> str:
    """The same for a small fixed number of draws: how many of the distribution's partial sums ``u`` has reached.

    No lambda and no logarithm, so that it is compiled: this runs once for each site and population.
    """
    whole = comb_text(f"double({population})", draws)
    chances = [
        f"{comb_text(f'double({hits})', k)} * ({comb_text(f'double({population}) - {hits}', draws - k)})" for k in range(draws)
    ]
    reached = " + ".join(f"if({u} < ({' + '.join(chances[: k + 1])}) / ({whole}), 0L, 1L)" for k in range(draws))
    return f"if({hits} = 0, 0L, if({draws} >= {population}, bigint({hits}), least({reached}, bigint({hits}))))"
