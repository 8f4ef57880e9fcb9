"""Ratios, bounds and tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F, types as T


def floor_div(x: Column, y: Column) -> Column:
    """Whole numbers' quotient, rounded down; exact, without decimals or binary fractions."""
    return F.call_function("div", x - F.pmod(x, y), y)


def ratio4(part: Column, whole: Column) -> Column:
    """part / whole of whole numbers, half up to four decimals without a detour over binary fractions."""
    p, w = part.cast("long"), whole.cast("long")
    return F.when(w > 0, floor_div(p * 20000 + w, 2 * w).cast("double") / 10000.0)


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval, within 0 and 1; 0 without trials."""
    k, m = hits.cast("double"), n.cast("double")
    p = k / m
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low = (p + z * z / (2 * m) - spread) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.least(low, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1, by Stirling's series from x + 8 on."""
    below = np.zeros_like(x)
    for i in range(8):
        below += np.log(x + i)
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - below


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for all elements at once."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    steps = int(200 + 4 * np.sqrt(max(float(np.max(a + b, initial=1.0)), 1.0)))
    for m in range(1, steps):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return out


def upper_tails(hits: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= hits) of binomials, as the regularised incomplete beta function I_p(hits, n - hits + 1)."""
    hits, n, p = (np.asarray(v, dtype=float) for v in (hits, n, p))
    out = np.where((hits <= 0) | (p >= 1.0), 1.0, 0.0)
    real = (hits > 0) & (hits <= n) & (p > 0.0) & (p < 1.0)
    a, b, x = hits[real], (n - hits)[real] + 1.0, p[real]
    if len(a):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        u, v, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
        part = front * _fraction(u, v, y) / u
        out[real] = np.clip(np.where(low, part, 1.0 - part), 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def binomial_upper_tail(hits: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact one-sided p-value of each row, a batch at a time."""
    return pd.Series(upper_tails(hits.to_numpy(), n.to_numpy(), p.to_numpy()))


def binomial_tail_native(hits: Column, n: Column, p: Column) -> Column:
    """The same by a fold over the terms k..n, each from the one before: small n only, no Python."""
    first = F.aggregate(
        F.when(hits > 0, F.sequence(F.lit(1), hits.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.pow(1 - p, n - hits).cast("double"),
        lambda acc, i: acc * p * (n - hits + i) / i,
    )
    rest = F.when(hits < n, F.sequence(hits.cast("int") + 1, n.cast("int"))).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(
        rest,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * (n - i + 1) / i * p / (1 - p)).alias("term"),
            (acc["total"] + acc["term"] * (n - i + 1) / i * p / (1 - p)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(hits <= 0, 1.0).otherwise(F.least(folded, F.lit(1.0)))
