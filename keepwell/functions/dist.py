"""Tail probabilities and quantiles for a handful of aggregated statistics (plain Python).

These run on the driver over bounded result tables (tests, arms, designs), never over rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()
_EPS = 1e-16
_TINY = 1e-300


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse CDF: the standard library's value polished by one Newton step."""
    z = _N.inv_cdf(p)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return z - (normal_cdf(z) - p) / density if density > 1e-290 else z


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        h *= step
        if abs(step - 1) < _EPS * 4:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the Lentz continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS * 4:
            break
    return front * h


def chi2_sf(x: float | None, df: float | None) -> float | None:
    return None if x is None or not df else gamma_q(df / 2, x / 2)


def t_sf2(t: float | None, df: float | None) -> float | None:
    """Two-sided t probability."""
    return None if t is None or df is None else beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    return None if f is None else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_sf2(z: float | None) -> float | None:
    return None if z is None else min(1.0, 2 * normal_sf(abs(z)))


def fisher_2x2(a: int, b: int, c: int, d: int) -> tuple[float | None, float]:
    """(sample odds ratio, two-sided p): the hypergeometric terms no likelier than the table."""
    r1, r2, c1 = a + b, c + d, a + c
    lo, hi = max(0, c1 - r2), min(c1, r1)

    def log_p(k: int) -> float:
        def choose(n: int, m: int) -> float:
            return math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
        return choose(r1, k) + choose(r2, c1 - k) - choose(r1 + r2, c1)

    limit = log_p(a) + 1e-7
    p = math.fsum(math.exp(v) for v in map(log_p, range(lo, hi + 1)) if v <= limit)
    odds = math.inf if b * c == 0 and a * d > 0 else (a * d / (b * c) if b * c else None)
    return odds, min(1.0, p)
