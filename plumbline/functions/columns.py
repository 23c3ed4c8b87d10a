"""Small column expressions that many relations use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def six(c: str | Column) -> Column:
    """Rounded to six digits; only results are rounded, never what other relations build on."""
    return F.round(col(c), 6)


def nudged(c: str | Column) -> Column:
    """Six digits of a mean over few rows; a nudge of 1e-9 decides ties at the sixth digit alike in every engine."""
    return F.round(col(c) + 1e-9, 6)


def share(condition: Column) -> Column:
    """The share of rows for which the condition holds; null counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once; within the lambda of an array function it would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total_of(v: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def binned(value: Column, n: int, closed: str) -> Column:
    """Number of the bin of equal width: (lo, hi] for right, [lo, hi) with a closed last bin for left; compared with literal edges."""
    out = F.lit(None).cast("int")
    for k in range(n):
        lo, hi = k / n, (k + 1) / n
        inside = (value > lo) & (value <= hi) if closed == "right" else (value >= lo) & ((value < hi) if k < n - 1 else (value <= hi))
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out
