"""Gathering of benchmark records from experiment summaries: JSON documents of differing shape, each read once as a VARIANT.

A summary is a list of records; or has them under benchmark_records or records; or has model_rankings and perturbation_rankings, whose
rows get the scope model or perturbation; or has stage_summaries, whose entries are records with the stage as scope unless they name
one. The first of these that fits counts. What is no JSON, has no such shape, or is no record in its list gives a row with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: where an experiment keeps its summary.
SUMMARIES = "experiment_*/summaries/experiment_summary.json"
FIELDS = {"model_name": "string", "perturbation_type": "string", "severity_level": "string", "robustness": "double", "instability": "double", "uncertainty": "double"}


def read_summaries(spark: SparkSession, root: str, pattern: str = SUMMARIES) -> DataFrame:
    """(path, text) of each summary below a folder; a document is a row, read by one task."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}")
    return files.select("path", F.col("content").cast("string").alias("text"))


def _at(v: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def gather(summaries: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """(path, position, benchmark_scope, the fields, error) of each record of (path, text); what a record lacks, or has as something
    else, is null. Position -1 is a document without records."""
    v = F.col("v")
    listed, none = "array<variant>", F.lit(None).cast("string")
    records = lambda path, scope=none: F.transform(_at(v, path, listed), lambda x: F.struct(scope.alias("scope"), x.alias("record"), F.lit(True).alias("outright")))
    empty = F.array().cast("array<struct<scope:string,record:variant,outright:boolean>>")
    ranks = F.concat(*(F.coalesce(records(f"$.{name}_rankings", F.lit(name)), empty) for name in ("model", "perturbation")))
    ranked = _at(v, "$.model_rankings", "variant").isNotNull() | _at(v, "$.perturbation_rankings", "variant").isNotNull()
    stages = F.transform(F.map_entries(_at(v, "$.stage_summaries", "map<string,variant>")), lambda x: F.struct(x["key"].alias("scope"), x["value"].alias("record"), F.lit(False).alias("outright")))
    found = F.coalesce(records("$"), records("$.benchmark_records"), records("$.records"), F.when(ranked, ranks), stages)
    rows = summaries.select("path", F.try_parse_json("text").alias("v"))
    rows = rows.select("path", F.col("v").isNull().alias("broken"), found.alias("found"))
    rows = rows.select("path", "broken", F.col("found").isNull().alias("other"), F.posexplode_outer("found").alias("position", "x"))
    record = F.col("x.record")
    whole = _at(record, "$", "map<string,variant>").isNotNull()
    own = _at(record, "$.benchmark_scope", "string")
    scope = F.when(F.col("x.outright") & F.col("x.scope").isNotNull(), F.col("x.scope")).otherwise(F.coalesce(own, F.col("x.scope")))
    error = F.when(F.col("broken"), "no JSON").when(F.col("other"), "no records").when(F.col("x").isNotNull() & ~F.coalesce(whole, F.lit(False)), "no record")
    out = rows.select("path", F.coalesce("position", F.lit(-1)).alias("position"), scope.alias("benchmark_scope"), *(_at(record, f"$.{name}", kind).alias(name) for name, kind in fields.items()), error.alias("error"))
    return out.filter((F.col("position") >= 0) | F.col("error").isNotNull())
