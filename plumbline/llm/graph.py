"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) can reach, for all nodes that are not it.

    Alternating large-star and small-star steps: each node's larger neighbours move to its smallest
    neighbour, then its smaller ones do. The edges never grow beyond their first number, and each round is
    two aggregates and two joins over them; minima are combined before the shuffle, so a hub costs one row
    per task, and its edges are split among tasks by the skew join. Each round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    edges = cut(spark, edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while (now := _print(edges)) != was and now[0]:
        was = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(spark, small.filter("u <> v").distinct())
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
