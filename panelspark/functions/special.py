"""Distribution functions for result rows: beta, Student t, normal, chi-square, signed-rank."""

from __future__ import annotations

import math
from functools import lru_cache


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz evaluation."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def bisect(fn, lo: float, hi: float, target: float) -> float:
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if fn(mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def beta_quantile(p: float, a: float, b: float) -> float:
    return bisect(lambda x: beta_cdf(x, a, b), 0.0, 1.0, p)


def jeffreys(k: int, n: int, conf: float = 0.95) -> tuple[float, float]:
    """Jeffreys interval of a proportion; the bound is 0 at no success and 1 at no failure."""
    if n <= 0 or not 0 <= k <= n:
        raise ValueError(f"k={k} of n={n}")
    tail = (1.0 - conf) / 2.0
    lo = 0.0 if k == 0 else beta_quantile(tail, k + 0.5, n - k + 0.5)
    hi = 1.0 if k == n else beta_quantile(1.0 - tail, k + 0.5, n - k + 0.5)
    return lo, hi


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * beta_cdf(x, df / 2.0, 0.5)
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    return bisect(lambda t: t_cdf(t, df), -1e4, 1e4, p)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf_even(x: float, df: int) -> float:
    """Upper tail of chi-square for an even number of degrees of freedom: a finite Poisson sum."""
    half, term, total = x / 2.0, 1.0, 1.0
    for i in range(1, df // 2):
        term *= half / i
        total += term
    return math.exp(-half) * total


def gamma_sf(x: float, a: float) -> float:
    """Regularised upper incomplete gamma, series below a + 1 and continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    return chi2_sf_even(x, df) if df % 2 == 0 else gamma_sf(x / 2.0, df / 2.0)


@lru_cache(maxsize=64)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """Number of sign patterns of ranks 1..n giving each positive rank sum."""
    counts = [1]
    for rank in range(1, n + 1):
        wider = counts + [0] * rank
        for i, c in enumerate(counts):
            wider[i + rank] += c
        counts = wider
    return tuple(counts)


def wilcoxon_p(w_plus: float, n: int, ties: float, has_ties: bool, zeros: int, side: str, method: str = "normal") -> float:
    """p-value of the signed-rank sum by the named method, whatever the size.

    ``normal`` corrects for ties; ``exact`` counts sign patterns and is not a number with ties or zeros.
    ``ties`` is the sum of t^3 - t over tie groups; ``side`` is two-sided, greater or less.
    """
    if method not in ("normal", "exact"):
        raise ValueError(method)
    if n == 0:
        return 1.0
    total = n * (n + 1) / 2.0
    if method == "exact":
        if has_ties or zeros:
            return math.nan
        counts = signed_rank_counts(n)
        w = int(round(w_plus))
        upper, lower = sum(counts[w:]) / 2**n, sum(counts[: w + 1]) / 2**n
        if side == "greater":
            return upper
        if side == "less":
            return lower
        return min(1.0, 2.0 * min(upper, lower))
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if var <= 0:
        return 1.0
    z = (w_plus - total / 2.0) / math.sqrt(var)
    if side == "greater":
        return normal_sf(z)
    if side == "less":
        return normal_sf(-z)
    return 2.0 * normal_sf(abs(z))
