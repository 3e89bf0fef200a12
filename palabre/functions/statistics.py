"""Exact tails and intervals on the driver, for handfuls of rows; no library beyond the standard one."""

from __future__ import annotations

import math


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact test: the chance of counts no likelier than ``k``."""
    if n == 0:
        return 1.0
    prob = lambda i: math.exp(log_choose(n, i) + (i * math.log(p) if p > 0 else (0 if i == 0 else -math.inf)) + ((n - i) * math.log1p(-p) if p < 1 else (0 if i == n else -math.inf)))
    here = prob(k)
    return min(1.0, sum(q for i in range(n + 1) if (q := prob(i)) <= here * (1 + 1e-7)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a two-by-two table."""
    n, row, col = a + b + c + d, a + b, a + c
    prob = lambda x: math.exp(log_choose(col, x) + log_choose(n - col, row - x) - log_choose(n, row))
    here = prob(a)
    return min(1.0, sum(q for x in range(max(0, row + col - n), min(row, col) + 1) if (q := prob(x)) <= here * (1 + 1e-7)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion, by bisection of the beta distribution."""
    def inverse(a: float, b: float, q: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < q else (lo, mid)
        return (lo + hi) / 2
    tail = (1 - level) / 2
    return (0.0 if k == 0 else inverse(k, n - k + 1, tail)), (1.0 if k == n else inverse(k + 1, n - k, 1 - tail))
