"""Mixing sources to target weights.

Each source has a weight; together the sources share all words of the input in proportion to the
weights, but no target exceeds `cap` times its source's words (the rest goes to the other sources by
weight, until none is above). A document is then emitted floor(rate) times, plus one more copy with the
probability of the fraction, drawn from a hash of its id, so that reruns agree.

Only two aggregates cross the network: words by source (combined before the shuffle, so that a source
with a third of all rows costs no more than another), and the plan, one row per source, which Spark
broadcasts where its measured size allows and else joins with skew splitting.

The windows of the plan run over one row per source in one task; a source is a data set, so there are
thousands of them at most, not millions.

Null texts and texts of white space have size 0 and are never taken. A null source is a source of its
own, last in order. Equal ids draw equally. Extra columns of any name pass through the mixture unchanged. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import WORD

#: Weights of the sources in order, repeating; the largest repetition.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix:"


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds target to (key, source_size, weight): the shares of all words by weight, none above cap times its source.

    Sorted by cap / weight, the sources that reach their cap come first. With the first k at their caps the
    others take (total - caps) / weights each; the right k is the first for which the next one stays under its cap.
    The windows run over one row per source, never over documents.
    """
    order = W.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("key").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    top = F.col("source_size") * cap
    steps = sources.withColumns({"level": level, "at": F.row_number().over(order)})
    first = F.min(F.when(F.col("level") * F.col("weight") <= top, F.struct("at", "level"))).over(W.partitionBy())["level"]
    return steps.withColumn("level", first).withColumn("target", F.least(top.cast("double"), F.col("level") * F.col("weight"))).drop("level", "at")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size, weight, target, rate) of each source, from (key, size) of each document."""
    by = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(W.orderBy(F.col("key").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return water_level(by.withColumn("weight", weight), cap).withColumn("rate", rate)


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of its md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _mixed(docs: DataFrame, carried: list[str], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies); row holds the carried columns, so that their names meet no others."""
    sized = docs.select(F.struct(*carried).alias("row"), draw(seed=seed).alias("drawn"), F.col("source").alias("of"), words_of("text").alias("size"))
    lean = docs.select(F.col("source").alias("key"), words_of("text").alias("size"))
    joined = sized.join(plan(lean, weights, cap), F.col("of").eqNullSafe(F.col("key")))
    whole = F.floor("rate")
    copies = whole + (F.col("drawn") < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of each document."""
    return _mixed(docs, ["doc_id"], **options).select("row.doc_id", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns."""
    taken = _mixed(docs, docs.columns, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
