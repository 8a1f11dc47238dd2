"""Special functions that numpy lacks: digamma, the regularised incomplete beta, Student's t tail."""

from __future__ import annotations

import math

import numpy as np


def digamma(x):
    """For positive arguments: the recurrence up to 10, then the asymptotic series."""
    x = np.array(x, dtype=float, copy=True, ndmin=1)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    out += np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return out


def lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def pearson_p(r: float, n: int) -> float:
    """The two-sided p-value of a correlation of n pairs."""
    if r != r or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return betainc((n - 2) / 2, 0.5, 1 - r * r)
