"""Quantiles and p-values of Student's t and Wilcoxon's signed ranks, for the few rows that are left after aggregation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tail(t: float, df: float) -> float:
    """P(|T| > t): the regularised incomplete beta function, by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d, out = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 0.0
        out = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + k * d), 1 + k / c
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _quantile(df: float, p: float = 0.05) -> float:
    """The t that |T| exceeds with chance p."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, df) > p else (low, mid)
    return low


def _signed_rank(w: float, n: int, uneven: float = 0, ties: float = 0) -> float:
    """P-value of the smaller rank sum of n differences: exact for up to 50 whose ranks are those from 1 to n, else by the normal curve.

    uneven is above 0 if there are ties or pairs without a difference; ties (the sum of t^3 - t) takes from the variance.
    """
    if n > 50 or uneven > 0:
        mean, var = n * (n + 1) / 4, (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
        return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0
    ways = [1]  # ways to reach each sum of ranks
    for k in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if 0 <= i - k < len(ways) else 0) for i in range(len(ways) + k)]
    return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)


def _apply(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(lambda x, n: 0.0 if math.isinf(x) else _tail(abs(x), n), t, df)


@F.pandas_udf(T.DoubleType())
def t_quantile(df: pd.Series) -> pd.Series:
    """The 0.975 quantile."""
    return _apply(_quantile, df)


@F.pandas_udf(T.DoubleType())
def signed_rank_p_value(w: pd.Series, n: pd.Series, uneven: pd.Series, ties: pd.Series) -> pd.Series:
    return _apply(lambda x, k, u, t: _signed_rank(x, int(k), u, t), w, n, uneven, ties)
