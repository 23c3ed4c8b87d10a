"""Robustness of each model against its own clean predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import binned, share, six
from plumbline.functions.labels import ROBUSTNESS, is_clean, label
from plumbline.operators.frames import Frames, relation

# Weights of consistency, stability, resistance and calibration in each scheme; the first is the score's.
SCHEMES = {"Prior_30_30_20_20": (0.30, 0.30, 0.20, 0.20), "Equal_25_25_25_25": (0.25, 0.25, 0.25, 0.25), "Consistency_40_30_15_15": (0.40, 0.30, 0.15, 0.15), "Calibration_20_20_30_30": (0.20, 0.20, 0.30, 0.30)}
PARTS = ("consistency", "stability", "resistance", "calibration")


@relation
def confidences(r: Frames) -> DataFrame:
    """Spread of each model's confidences over all its rows, the clean ones too."""
    c = F.col("confidence")
    return r.log.groupBy("model_name").agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.min_by(c, F.when(is_clean(), F.col("seq"))).alias("original"))


@relation
def c1_consistency(r: Frames) -> DataFrame:
    """Perturbed rows that keep the class of their clean row; saturated: all do, at a mean confidence (of all rows) over 0.95."""
    kept = ~F.col("prediction_changed")
    by = r.j2_against_clean.groupBy("model_name").agg(F.count("*").alias("perturbed"), F.count_if(kept).alias("kept"), share(kept).alias("rate"))
    joined = by.join(r.confidences.select("model_name", "mean"), "model_name")
    return joined.select("model_name", "perturbed", "kept", six(100.0 * F.col("rate")).alias("consistency_pct"), ((F.col("kept") == F.col("perturbed")) & (F.col("mean") > 0.95)).alias("saturated"))


@relation
def c1_flips(r: Frames) -> DataFrame:
    return r.j2_against_clean.filter("prediction_changed").select("model_name", "sample_id", "perturbation_type", "severity_level", "clean_class", "predicted_class")


@relation
def c2_stability(r: Frames) -> DataFrame:
    """Confidence over all rows; the drop goes from the first clean row to the least of all rows."""
    original, mean = F.col("original"), F.col("mean")
    impact = F.abs(original - F.col("confidence"))
    worst = r.log.filter(~is_clean()).join(F.broadcast(r.confidences.select("model_name", "original")), "model_name").groupBy("model_name").agg(F.max(F.struct(impact.alias("impact"), "perturbation_type")).alias("worst"))
    joined = r.confidences.join(worst, "model_name", "left")
    return joined.select(
        "model_name", F.coalesce(original, mean).alias("original_confidence"), six(mean).alias("mean_confidence"), six("std").alias("std_confidence"), F.col("low").alias("min_confidence"), F.col("high").alias("max_confidence"),
        six(F.coalesce(original - F.col("low"), F.lit(0.0))).alias("confidence_drop"), six(mean - 0.25).alias("above_chance"), F.col("worst.perturbation_type").alias("most_damaging"), six("worst.impact").alias("greatest_impact"),
        ((mean > 0.98) & (F.col("std") < 0.01)).alias("saturated"),
    )


@relation
def against_original(r: Frames) -> DataFrame:
    """Perturbed rows beside their own clean row, or else the model's first."""
    first = r.log.filter(is_clean()).groupBy("model_name").agg(F.min_by(F.struct("predicted_class", "confidence"), "seq").alias("first"))
    joined = r.j2_against_clean.join(F.broadcast(first), "model_name")
    own = F.col("clean_class").isNotNull()
    change = F.abs(F.when(own, F.col("clean_confidence")).otherwise(F.col("first.confidence")) - F.col("confidence"))
    flipped = F.coalesce(F.col("predicted_class") != F.when(own, F.col("clean_class")).otherwise(F.col("first.predicted_class")), F.lit(True))
    return joined.select("model_name", "sample_id", "perturbation_type", "severity_level", "confidence", change.alias("confidence_delta"), flipped.alias("flipped"))


@relation
def c3_sensitivity(r: Frames) -> DataFrame:
    """Each perturbed row as critical (flipped), moderate (moved by more than 0.05) or low."""
    d = F.col("confidence_delta")
    return r.against_original.select("model_name", "sample_id", "perturbation_type", "severity_level", six(d).alias("confidence_delta"), "flipped", F.when(F.col("flipped"), "critical").when(d > 0.05, "moderate").otherwise("low").alias("severity"))


@relation
def c3_summary(r: Frames) -> DataFrame:
    """The most and the least sensitive record of each model: greatest by (flipped, change), without sorting all."""
    key = F.struct("flipped", six("confidence_delta").alias("confidence_delta"), "perturbation_type", "severity_level", "sample_id")
    by = r.against_original.groupBy("model_name").agg(F.count("*").alias("perturbed"), F.count_if("flipped").alias("flips"), F.max(key).alias("most"), F.min(key).alias("least"))
    return by.select("model_name", "perturbed", "flips", F.col("most.perturbation_type").alias("most_sensitive"), F.col("most.confidence_delta").alias("most_delta"), F.col("least.perturbation_type").alias("least_sensitive"), F.col("least.confidence_delta").alias("least_delta"))


@relation
def calibration_part(r: Frames) -> DataFrame:
    """(model_name, calibration): from the error of ten bins where the truth is known, else less for confidences near 1."""
    known = r.log.filter("true_label IS NOT NULL")
    bins = known.groupBy("model_name", binned(F.col("confidence"), 10, "left").alias("bin")).agg(F.count("*").alias("n"), (F.avg("confidence") - share(F.col("predicted_class") == F.col("true_label"))).alias("off"))
    error = bins.groupBy("model_name").agg((F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs("off")).otherwise(0.0)) / F.sum("n")).alias("ece"))
    penalty = F.greatest(F.lit(0.0), F.least(F.lit(30.0), (F.col("mean") - 0.97) / 0.03 * 30.0))
    joined = r.confidences.select("model_name", "mean").join(error, "model_name", "left")
    return joined.select("model_name", "ece", F.greatest(F.lit(0.0), F.coalesce(100.0 * (1.0 - F.col("ece")), 100.0 - penalty)).alias("calibration"))


@relation
def robustness_parts(r: Frames) -> DataFrame:
    kept = r.j2_against_clean.groupBy("model_name").agg((100.0 * share(~F.col("prediction_changed"))).alias("consistency"))
    flips = r.against_original.groupBy("model_name").agg((100.0 * (1.0 - share(F.col("flipped")))).alias("resistance"))
    joined = r.confidences.join(kept, "model_name", "left").join(flips, "model_name", "left").join(r.calibration_part.select("model_name", "calibration"), "model_name")
    full = lambda c: F.coalesce(F.col(c), F.lit(100.0)).alias(c)
    return joined.select("model_name", full("consistency"), F.greatest(F.lit(0.0), 100.0 * (1.0 - 2.5 * F.col("std"))).alias("stability"), full("resistance"), "calibration")


@relation
def robustness_totals(r: Frames) -> DataFrame:
    return r.robustness_parts.withColumn("robustness_score", six(sum((w * F.col(c) for c, w in zip(PARTS[1:], SCHEMES["Prior_30_30_20_20"][1:])), 0.30 * F.col("consistency"))))


@relation
def c4_robustness(r: Frames) -> DataFrame:
    return r.robustness_totals.select("model_name", *(six(c).alias(c) for c in PARTS), "robustness_score", label(F.col("robustness_score"), ROBUSTNESS).alias("interpretation"))


@relation
def c5_weighting(r: Frames) -> DataFrame:
    """Scores and ranks under each scheme; invariant says whether a model has the same place under the prior and equal weights."""
    scores = F.array(*(F.struct(F.lit(name).alias("scheme"), F.round(sum((w * F.col(c) for c, w in zip(PARTS[1:], ws[1:])), ws[0] * F.col(PARTS[0])), 2).alias("score")) for name, ws in SCHEMES.items()))
    long = r.robustness_parts.select("model_name", F.inline(scores))
    placed = long.withColumn("place", F.row_number().over(W.partitionBy("scheme").orderBy(F.desc("score"), "model_name")))
    mine = W.partitionBy("model_name")
    place_in = lambda name: F.max(F.when(F.col("scheme") == name, F.col("place"))).over(mine)
    return placed.withColumn("invariant", place_in("Prior_30_30_20_20") == place_in("Equal_25_25_25_25")).select("scheme", "model_name", "score", "place", "invariant")


@relation
def c6_comparison(r: Frames) -> DataFrame:
    score = F.col("robustness_score")
    diagnosis = F.array_join(F.array_compact(F.array(F.when(F.col("consistency") < 80, "unstable_predictions"), F.when(F.col("stability") < 80, "unstable_confidence"), F.when(F.col("calibration") < 90, "miscalibrated"))), "|")
    return r.robustness_totals.select("model_name", "robustness_score", F.row_number().over(W.orderBy(F.desc(score), "model_name")).alias("place"), six(F.max(score).over(W.partitionBy()) - score).alias("gap"), diagnosis.alias("diagnosis"))


@relation
def c18_degradation(r: Frames) -> DataFrame:
    """By type: mean, spread and greatest of (the model's last clean confidence - the row's)."""
    last = r.log.filter(is_clean()).groupBy("model_name").agg(F.max_by("confidence", "seq").alias("last"))
    drop = F.col("last") - F.col("confidence")
    rows = r.log.filter(~is_clean()).join(F.broadcast(last), "model_name")
    return rows.groupBy("perturbation_type").agg(six(F.avg(drop)).alias("mean_degradation"), six(F.coalesce(F.stddev_samp(drop), F.lit(0.0))).alias("std_degradation"), six(F.max(drop)).alias("max_degradation"), F.count("*").alias("n"))


@relation
def c18_experiment_summary(r: Frames) -> DataFrame:
    models = r.c6_comparison.agg(F.count("*").alias("models"), F.min_by("model_name", "place").alias("most_robust"), F.max_by("model_name", "place").alias("least_robust"), six(F.avg("robustness_score")).alias("mean_robustness"))
    rows = r.log.agg(F.count("*").alias("rows"), six(F.avg("confidence")).alias("mean_confidence"), F.count_distinct("perturbation_type").alias("types"))
    flips = r.j2_against_clean.agg(F.count_if("prediction_changed").alias("flips"))
    return models.crossJoin(rows).crossJoin(flips)


@relation
def c18_models(r: Frames) -> DataFrame:
    rows = r.log.groupBy("model_name").agg(F.count("*").alias("rows"))
    return r.c4_robustness.select("model_name", "robustness_score").join(r.calibration_part.select("model_name", six("ece").alias("ece")), "model_name").join(rows, "model_name")
