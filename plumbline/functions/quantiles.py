"""Exact medians by key without a task that holds a key's values: counts by bin, then only the bin that holds the middle rank.

Each level counts the values between two bounds in BINS bins of equal width (combined before the shuffle), and the next one looks
into the bin with the rank, between the least and the greatest value that it has. After LEVELS of them a bin has about one of BINS ** LEVELS values
of a spread-out column; these few, as counts of distinct values, are ranked in full. Ties cost nothing, for equal values are one row; a column of
which nearly all values crowd together takes more levels, never another result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, LEVELS = 4096, 2


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def medians(df: DataFrame, keys: list[str], column: str | Column, bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """(keys, median) of each key that has a value; NaN and null are none. Of an even number the mean of the two in the middle. Keys may be null."""
    x = F.col(column) if isinstance(column, str) else column
    rows = df.select(*keys, x.cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    one = not keys
    if one:
        keys, rows = ["all"], rows.withColumn("all", F.lit(0))
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    # One rank of one key a row: it lies between low and high, with so many values below low.
    at = held.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"))
    inside = lambda: rows.join(at, _same(keys) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    mine = [*(f"_{k}" for k in keys), "rank"]
    width = F.col("high") / 2 - F.col("low") / 2  # halves, for the difference may exceed a double
    for _ in range(levels):
        part = F.when(width > 0, F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        counts = inside().groupBy(*mine, "below", part.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.col("below") + F.sum("n").over(W.partitionBy(*mine).orderBy("bin"))  # a row for each bin
        chosen = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        at = chosen.select(*mine, "low", "high", (F.col("upto") - F.col("n")).alias("below"))
    values = inside().groupBy(*mine, "below", "x").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*mine).orderBy("x"))
    found = values.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    out = found.groupBy(*(f"_{k}" for k in keys)).agg(F.avg("x").alias("median"))
    return out.select(*([] if one else [F.col(f"_{k}").alias(k) for k in keys]), "median")


def with_median(aggregated: DataFrame, middle: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The aggregates with their medians, rounded to six digits, as a column."""
    renamed = middle.select(*(F.col(k).alias(f"_{k}") for k in keys), F.round("median", 6).alias(name))
    return aggregated.join(renamed, _same(keys), "left").drop(*(f"_{k}" for k in keys))
