"""Distributions without a statistics package: upper chi-square tail, binomial sum, normal quantile, log sums."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def log10_sum(a: float, b: float) -> float:
    """log10(10**a + 10**b)."""
    hi, lo = max(a, b), min(a, b)
    return hi if lo == -math.inf else hi + math.log1p(10 ** (lo - hi)) / math.log(10)


def _gamma_series(a: float, x: float) -> float:
    """log of the regularised lower incomplete gamma function, by its series; for x < a + 1."""
    term = total = 1 / a
    n = a
    for _ in range(10_000):
        n += 1
        term *= x / n
        total += term
        if term < total * 1e-16:
            break
    return math.log(total) - x + a * math.log(x) - math.lgamma(a)


def _gamma_fraction(a: float, x: float) -> float:
    """log of the regularised upper incomplete gamma function, by its continued fraction; for x >= a + 1."""
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.log(h) - x + a * math.log(x) - math.lgamma(a)


def chi2_log_upper(x: float, df: float) -> float:
    """Natural log of the probability that a chi-square variable exceeds x."""
    if x <= 0:
        return 0.0
    a, y = df / 2, x / 2
    if y < a + 1:
        low = math.exp(_gamma_series(a, y))
        return math.log1p(-low) if low < 1 else -math.inf
    return _gamma_fraction(a, y)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Probability of at most k hits in n trials."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
