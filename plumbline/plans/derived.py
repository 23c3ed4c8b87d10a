"""Prediction logs, logits, attention maps, plates, runs and benchmark records derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.frames import Frames


def log_of(lineitem: DataFrame) -> DataFrame:
    """A prediction log: parts are samples, suppliers models, line numbers severities; seq orders the rows."""
    t, r = F.col("l_partkey") % 4, F.col("l_linenumber") % 4
    confidence = F.round(0.3 + F.col("l_quantity") / 80.0, 4)
    harder = F.round(100 * F.col("l_discount")) >= 10 - F.greatest(r - 1, F.lit(0))
    shifted = harder & ((r > 0) | (F.col("l_quantity").cast("int") % 4 == 0))
    kinds = F.element_at(F.array(*map(F.lit, ("gaussian_blur", "high_contrast", "gaussian_noise"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    severities = F.element_at(F.array(*map(F.lit, ("clean", "mild", "moderate", "severe"))), (r + 1).cast("int"))
    # Vectors as they come from many sources: missing, not normalised, with what is no number, without mass, whole.
    odd = F.col("l_orderkey") % 7
    vector = (
        F.when(odd == 1, F.array(confidence, F.lit(0.5)))
        .when(odd == 2, F.array(F.lit(-0.1), confidence, F.lit(float("nan")), F.lit(0.25)))
        .when(odd == 3, F.array(F.lit(0.0), F.lit(0.0)))
        .when(odd == 4, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)))
    )
    return lineitem.select(
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("sample_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model_name"),
        F.concat(F.lit("c"), F.when(shifted, (t + 1) % 4).otherwise(t).cast("string")).alias("predicted_class"),
        confidence.alias("confidence"),
        F.when(r == 0, "clean").otherwise(kinds).alias("perturbation_type"),
        severities.alias("severity_level"),
        F.concat(F.lit("c"), t.cast("string")).alias("true_label"),
        vector.alias("probabilities"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
    )


def logits_of(embeddings: DataFrame) -> DataFrame:
    """Four models' logits for four classes: sixteenths of the embedding, with a bonus for the label."""
    models = embeddings.select("vec_id", (F.col("label") % 4).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.explode(F.array(*map(F.lit, range(4)))).alias("m"))
    z = F.transform(F.slice("e", 16 * F.col("m") + 1, 4), lambda x, i: 8.0 * x + F.when(F.col("label") == i, 1.5).otherwise(0.0))
    return models.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("model_name"), F.col("label").cast("int").alias("label"), z.alias("logits"))


def attention_of(embeddings: DataFrame) -> DataFrame:
    """Maps from embeddings: 8 x 8 cells, or 4 x 8 for some; eight for each sample, of two models under four severities."""
    at = F.col("vec_id") % 8
    rows = F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 5 == 0, 3).otherwise(7)), lambda i: F.transform(F.slice("embedding", 8 * i + 1, 8), lambda x: x.cast("double")))
    severity = F.element_at(F.array(*map(F.lit, ("clean", "low", "moderate", "high"))), (F.floor(at / 2) + 1).cast("int"))
    return embeddings.select(
        F.concat(F.lit("s"), F.floor(F.col("vec_id") / 8).cast("string")).alias("sample_id"), F.concat(F.lit("m"), (at % 2).cast("string")).alias("model_name"), severity.alias("severity_level"),
        F.when(F.floor(at / 2) == 0, "clean").otherwise("blur").alias("perturbation_type"), F.concat(F.lit("c"), (F.col("label") % 4).cast("string")).alias("predicted_class"), rows.alias("attention_map"))


def record_columns() -> list[Column]:
    types = F.element_at(F.array(*map(F.lit, ("clean", "blur", "contrast", "noise", "hue"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    severities = F.element_at(F.array(*map(F.lit, ("mild", "moderate", "severe"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    price = F.round("o_totalprice").cast("long")
    return [
        F.col("o_orderpriority").alias("model_name"), types.alias("perturbation_type"), severities.alias("severity_level"), (F.col("o_orderkey") % 5).alias("seed"),
        (price % 1000 / 1000.0).alias("robustness"), (F.col("o_orderkey") % 97 / 97.0).alias("instability"), (price % 89 / 89.0).alias("uncertainty"),
        (price % 71 / 71.0).alias("attention_stability"), (F.col("o_custkey") % 83 / 83.0).alias("consensus_reliability"), ((F.col("o_orderkey") + F.col("o_custkey")) % 61 / 61.0).alias("risk"),
        (price % 53 / 53.0).alias("attention_drift"), (F.col("o_custkey") % 47 / 47.0).alias("disagreement_rate")]


def records_of(orders: DataFrame) -> DataFrame:
    return orders.select(*record_columns())


def summaries_of(orders: DataFrame) -> DataFrame:
    """Summaries as JSON text: one for each customer, whose orders' records they hold in one of five shapes, or cut off."""
    rows = orders.select("o_custkey", F.struct("o_orderkey", F.struct(*(c for k, c in enumerate(record_columns()) if k != 3)).alias("r")).alias("x"))
    r = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"])  # the orders of one customer
    by = rows.groupBy("o_custkey").agg(r.alias("r")).withColumn("shape", F.col("o_custkey") % 6)
    wrapped = {1: {"benchmark_records": F.col("r")}, 2: {"records": F.col("r"), "note": F.lit("x")}, 3: {"model_rankings": F.col("r"), "perturbation_rankings": F.slice("r", 1, 1)}, 4: {"stage_summaries": F.struct(F.element_at("r", 1).alias("first"), F.element_at("r", -1).alias("last"))}}
    text = F.to_json("r")
    for k, parts in wrapped.items():
        text = F.when(F.col("shape") == k, F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))).otherwise(text)
    text = F.when(F.col("shape") == 5, F.substring(F.to_json("r"), F.lit(1), F.length(F.to_json("r")) - 1)).otherwise(text)
    return by.select(F.concat(F.lit("experiment_"), F.col("o_custkey").cast("string")).alias("path"), text.alias("text"))


def images_of(embeddings: DataFrame) -> DataFrame:
    """RGB images of 8 x 8 from embeddings: the three channels are the components from the 1st, the 22nd and the 43rd on, around the middle level."""
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double")))).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: level(F.floor(i / 3) + (i % 3) * 21))
    data = F.unhex(F.array_join(F.transform(levels, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return embeddings.select(F.col("vec_id").cast("string").alias("sample_id"), F.concat(F.lit("c"), (F.col("label") % 4).cast("string")).alias("true_label"), F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("pixels"))


def registry_of(events: DataFrame) -> DataFrame:
    """Registered experiments: some of a user's events, their types are the stages, four models are used in turn."""
    model = F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string"))
    return events.groupBy(F.concat(F.lit("exp"), F.col("user_id").cast("string"), F.lit("_"), (F.col("event_id") % 37).cast("string")).alias("experiment_id")).agg(F.sort_array(F.collect_set("event_type")).alias("enabled_stages"), F.sort_array(F.collect_set(model)).alias("models"))


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """All derived inputs; none is read before a relation asks for it."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    status = F.element_at(F.array(*map(F.lit, ("failed", "skipped", "completed", "completed", "completed"))), (F.col("event_id") % 5 + 1).cast("int"))
    rare = F.col("c_custkey") % 97 == 0  # classes of one plate
    return Frames(
        log=log_of(read("lineitem")), logits=logits_of(read("embeddings")), attention=attention_of(read("embeddings")), images=images_of(read("embeddings")), records=records_of(read("orders")), summaries=summaries_of(read("orders")),
        plates=read("customer").select(F.when(rare, F.concat(F.lit("RARE"), (F.col("c_custkey") % 5).cast("string"))).otherwise(F.col("c_mktsegment")).alias("class_name"), F.when(rare, "Plate").otherwise(F.concat(F.lit("Plate"), F.col("c_nationkey").cast("string"))).alias("plate_name"), F.col("c_custkey").alias("image_id")),
        registry=registry_of(read("events")),
        runs=read("events").select(F.col("user_id").alias("experiment"), F.col("event_type").alias("stage"), status.alias("status")),
    )
