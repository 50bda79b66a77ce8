"""Distribution functions as plain Python, for parameters and small tables on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + k * d or tiny)
            c = 1.0 + k / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return p if t > 0 else 1.0 - p


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) of the binomial distribution."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def signed_rank_sf(w: int, n: int) -> float:
    """Exact P(W+ >= w) of the signed-rank statistic of n untied differences."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return sum(ways[max(0, math.ceil(w)) :]) / 2**n
