"""Queries over the sources and sinks: gathered summaries, and records by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.frames import Frames, relation
from plumbline.sources import sinks, summaries


@relation
def s4_gathered(r: Frames) -> DataFrame:
    """The records of all summaries."""
    return summaries.gather(r.summaries)


@relation
def s4_scopes(r: Frames) -> DataFrame:
    return r.s4_gathered.groupBy("benchmark_scope", "error").agg(F.count("*").alias("records"), F.count_distinct("path").alias("summaries"))


@relation
def s8_disagreements(r: Frames) -> DataFrame:
    """Disagreements by sample."""
    lists = sinks.by_key(r.a3_disagreements.select("sample_id", "model_name", "predicted_class", "confidence"), "sample_id")
    return lists.groupBy("key").agg(F.sum("n").alias("n"), F.replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "records"))), lambda x: x["records"]), ""), F.lit("]["), F.lit(",")).alias("records"))


@relation
def s8_trust(r: Frames) -> DataFrame:
    """Samples by trust level: how many, and the lists' first and last sample."""
    lists = sinks.by_key(r.d10_trust.select("trust_level", "sample_id"), "trust_level", most=100)
    one = lambda at: F.get_json_object("records", f"$[{at}].sample_id")
    ends = lists.select("key", "n", one(0).alias("first"), F.regexp_extract("records", r'"sample_id":"([^"]*)"\}\]$', 1).alias("last"))
    return ends.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
