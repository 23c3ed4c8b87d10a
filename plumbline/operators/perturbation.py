"""Disagreement and instability under perturbation: observations of a sample under a type and a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import over, share, six
from plumbline.functions.labels import is_clean, rank
from plumbline.operators.agreement import hashed
from plumbline.operators.frames import Frames, relation

SAMPLE_KEY = ["sample_id", "perturbation_type", "severity_level"]
# The canonical order of corruptions in tables; others follow by name.
CORRUPTIONS = ("original", "bright", "dark", "high_contrast", "low_contrast", "gaussian_noise", "gaussian_blur", "stain_shift", "defocus_blur", "jpeg_compression")


def extremes(*names: str) -> list[Column]:
    """Least and greatest hash of the named columns of a group, and of such groups: they are the same where the group has one value. Longs, which aggregate without objects."""
    return [f(f"{c}_{end}").alias(f"{c}_{end}") for c in names for end, f in (("low", F.min), ("high", F.max))]


@relation
def sample_rows(r: Frames) -> DataFrame:
    """The log as narrow rows, dealt by sample: names of sample, type and severity, hashes of model and class."""
    ends = [hashed(c).alias(f"{n}_{end}") for c, n in (("model_name", "model"), ("predicted_class", "class")) for end in ("low", "high")]
    log = r.log.select("sample_id", "perturbation_type", "severity_level", "model_name", "predicted_class").repartition("sample_id")
    return log.select(*SAMPLE_KEY, "predicted_class", *ends)


@relation
def sample_cells(r: Frames) -> DataFrame:
    """A sample under a type and a severity, clean ones too, with the extremes of its models and classes."""
    return r.sample_rows.groupBy(*SAMPLE_KEY).agg(*extremes("model", "class")).withColumn("severity_rank", rank("severity_level"))


@relation
def observations(r: Frames) -> DataFrame:
    """A sample under a type and a severity, seen by two models or more; whether they differ."""
    seen = r.sample_cells.filter(~is_clean()).filter("model_low <> model_high")
    return seen.select(*SAMPLE_KEY, "severity_rank", (F.col("class_low") != F.col("class_high")).alias("differ"))


@relation
def levels(r: Frames) -> DataFrame:
    """Samples by severity, all types together. Classes are counted as groups."""
    seen = r.sample_rows.groupBy("sample_id", "severity_level", "predicted_class").agg(*extremes("model"))
    seen = seen.groupBy("sample_id", "severity_level").agg(F.count("predicted_class").cast("int").alias("n_classes"), *extremes("model"))
    return seen.filter("model_low <> model_high").withColumn("severity_rank", rank("severity_level")).select("sample_id", "severity_level", "severity_rank", (F.col("n_classes") == 1).alias("models_agree"), F.col("n_classes").alias("n_unique_classes"))


@relation
def top_rank(r: Frames) -> DataFrame:
    """One row: the greatest rank of the perturbed rows."""
    return r.log.filter(~is_clean()).agg(F.max(rank("severity_level")).alias("top_rank"))


@relation
def j4_induced_disagreements(r: Frames) -> DataFrame:
    """Perturbed rows of the observations that disagree although the sample's clean classes agree."""
    found = r.observations.filter("differ").join(r.agreed, "sample_id", "left_semi").select(*SAMPLE_KEY)
    rows = r.rows.filter(~is_clean()).join(found, SAMPLE_KEY, "left_semi")
    return rows.select("sample_id", "model_name", "perturbation_type", "severity_level", "predicted_class", "confidence", F.lit(True).alias("perturbation_induced"))


@relation
def b1_sensitivity(r: Frames) -> DataFrame:
    differ = F.coalesce("differ", F.lit(False))
    return r.observations.groupBy("perturbation_type").agg(F.count("*").alias("observations"), F.count_if(differ).alias("disagreements"), six(share(differ)).alias("disagreement_rate"))


@relation
def b2_severity_rates(r: Frames) -> DataFrame:
    differ = ~F.col("models_agree")
    return r.levels.groupBy("severity_level").agg(F.min("severity_rank").alias("severity_rank"), F.count("*").alias("observations"), F.count_if(differ).alias("disagreements"), six(share(differ)).alias("disagreement_rate"))


@relation
def ladders(r: Frames) -> DataFrame:
    """The ladder of each sample: its first break so far (rank and label), its place, and the state one step before."""
    ladder = W.partitionBy("sample_id").orderBy("severity_rank", "severity_level")
    broken = F.when(~F.col("models_agree"), F.struct("severity_rank", "severity_level"))
    return r.levels.withColumns({
        "first_break": F.min(broken).over(ladder.rowsBetween(W.unboundedPreceding, 0)),
        "agreed_before": F.lag("models_agree").over(ladder),
    })


@relation
def b3_stability(r: Frames) -> DataFrame:
    here = F.col("first_break") == F.struct("severity_rank", "severity_level")
    return r.ladders.select(
        "sample_id", "severity_level", "severity_rank", "models_agree", "n_unique_classes",
        F.coalesce(here, F.lit(False)).alias("stability_breakpoint"), F.col("first_break.severity_level").alias("collapse_severity"),
    )


@relation
def walks(r: Frames) -> DataFrame:
    """One row for each sample, from one dealing of the log: its ladder (steps, steps before the break, the break, changes of state, the greatest rank; null
    without steps) and its observations (how many, how many differ, the first rank and the share of the types that do; null without any).

    Each cell counts for its severity (a step of the ladder) and for its type; both are groups of the same aggregate.
    """
    names = F.inline(F.array(F.struct(F.lit(True).alias("step"), F.col("severity_level").alias("name")), F.struct(F.lit(False).alias("step"), F.col("perturbation_type").alias("name"))))
    seen = F.coalesce(~is_clean() & (F.col("model_low") != F.col("model_high")), F.lit(False))
    split = seen & F.coalesce(F.col("class_low") != F.col("class_high"), F.lit(False))
    told = r.sample_cells.select("sample_id", "severity_rank", *(f"{c}_{end}" for c in ("model", "class") for end in ("low", "high")), seen.alias("seen"), split.alias("split"), names)
    first = F.min(F.when(F.col("split"), F.col("severity_rank"))).alias("first_rank")
    sides = told.groupBy("sample_id", "step", "name").agg(F.min("severity_rank").alias("severity_rank"), *extremes("model", "class"), F.count_if("seen").alias("seen"), F.count_if("split").alias("split"), first)
    step, kind = F.col("step"), ~F.col("step")
    sides = sides.filter((step & (F.col("model_low") != F.col("model_high"))) | (kind & (F.col("seen") > 0))).withColumn("agree", F.coalesce(F.col("class_low") == F.col("class_high"), F.lit(False)))
    ladder = W.partitionBy("sample_id", "step").orderBy("severity_rank", "name")
    walked = sides.withColumns({"before": F.lag("agree").over(ladder), "breaks": F.count_if(~F.col("agree")).over(ladder.rowsBetween(W.unboundedPreceding, 0))})
    agree, before, breaks = F.col("agree"), F.col("before"), F.col("breaks")
    here = step & ~agree & (breaks == 1)
    known = F.col("name").isNotNull()
    of = lambda condition, c: F.when(condition, F.col(c))
    by = walked.groupBy("sample_id").agg(
        F.nullif(F.count_if(step), F.lit(0)).alias("total_steps"), F.count_if(step & (breaks == 0)).alias("steps_before"), F.max(of(here, "severity_rank")).alias("break_rank"), F.max(of(here, "name")).alias("break_level"),
        F.max(of(step, "severity_rank")).alias("last_rank"), F.count_if(step & agree).alias("agreeing"), F.count_if(step & before.isNotNull()).alias("transitions"), F.count_if(step & (before != agree)).alias("changes"),
        F.nullif(F.coalesce(F.sum(of(kind, "seen")), F.lit(0)), F.lit(0)).alias("observations"), F.sum(of(kind, "split")).alias("breaks"), F.min(of(kind, "first_rank")).alias("first_rank"),
        over(F.count_if(kind & known & (F.col("split") > 0)).cast("double"), F.count_if(kind & known).cast("double")).alias("breadth"))
    none = F.col("total_steps").isNull()
    steps = ("steps_before", "transitions", "changes")
    by = by.withColumns({**{c: F.when(~none, F.col(c)) for c in steps}, "survival": F.col("agreeing") / F.col("total_steps"), "rate": F.col("breaks") / F.col("observations")}).drop("agreeing")
    early = 1.0 - F.col("first_rank").cast("double") / (F.col("top_rank") + 1)
    score = F.when(F.col("breaks") == 0, 0.0).otherwise(0.4 * F.col("rate") + 0.35 * early * F.col("rate") + 0.25 * F.col("breadth"))
    return by.crossJoin(F.broadcast(r.top_rank)).withColumn("instability_score", F.when(F.col("observations").isNotNull(), six(score))).drop("top_rank")


@relation
def clean_last(r: Frames) -> DataFrame:
    """The last clean row of each sample and model."""
    last = F.max_by(F.struct("predicted_class", "confidence"), "seq").alias("last")
    by = r.log.filter(is_clean()).groupBy("sample_id", "model_name").agg(last)
    return by.select("sample_id", "model_name", F.col("last.predicted_class").alias("clean_class"), F.col("last.confidence").alias("clean_confidence"))


@relation
def j2_against_clean(r: Frames) -> DataFrame:
    """Perturbed rows beside their own clean row; without one the class counts as changed and the confidence as kept."""
    perturbed = r.log.filter(~is_clean()).select("sample_id", "model_name", "perturbation_type", "severity_level", rank("severity_level").alias("severity_rank"), "predicted_class", "confidence", "true_label", "seq")
    joined = perturbed.join(r.clean_last, ["sample_id", "model_name"], "left")
    return joined.select(
        "sample_id", "model_name", "perturbation_type", "severity_level", "severity_rank", "predicted_class", "confidence", "true_label", "clean_class", "clean_confidence",
        F.coalesce(F.col("predicted_class") != F.col("clean_class"), F.lit(True)).alias("prediction_changed"),
        F.coalesce(F.col("clean_confidence") - F.col("confidence"), F.lit(0.0)).alias("confidence_drop"),
    )


@relation
def model_instability(r: Frames) -> DataFrame:
    changed = F.col("prediction_changed")
    by = r.j2_against_clean.filter("clean_class IS NOT NULL").groupBy("model_name").agg(
        F.count("*").alias("perturbed"), F.count_if(changed).alias("flips"), share(changed).alias("flip_rate"), F.round(F.avg(F.when(changed, F.col("severity_rank"))), 4).alias("mean_flip_rank"))
    rate = F.col("flip_rate")
    early = 1.0 - F.col("mean_flip_rank") / (F.col("top_rank") + 1)
    score = F.when(F.col("flips") == 0, 0.0).otherwise(0.4 * rate + 0.35 * early * rate + 0.25 * rate)
    return by.crossJoin(F.broadcast(r.top_rank)).withColumn("instability_score", six(score)).drop("top_rank")


@relation
def b4_model_instability(r: Frames) -> DataFrame:
    return r.model_instability.withColumn("flip_rate", six("flip_rate"))


@relation
def b5_sample_instability(r: Frames) -> DataFrame:
    scored = r.walks.filter("observations IS NOT NULL")
    return scored.select("sample_id", "observations", "breaks", six("rate").alias("disagreement_rate"), "first_rank", six("breadth").alias("breadth"), "instability_score")


@relation
def b6_instability_summary(r: Frames) -> DataFrame:
    score = F.col("instability_score")
    models = r.b4_model_instability.agg(six(F.avg(score)).alias("mean_model_instability"), F.max(score).alias("max_model_instability"), F.max_by("model_name", score).alias("worst_model"))
    samples = r.b5_sample_instability.agg(six(F.avg(score)).alias("mean_sample_instability"), F.max(score).alias("max_sample_instability"), F.count("*").alias("samples"))
    both = models.crossJoin(samples)
    return both.withColumn("overall_instability", six((F.col("mean_model_instability") + F.col("mean_sample_instability")) / 2.0))


@relation
def b6_top_samples(r: Frames) -> DataFrame:
    return r.b5_sample_instability.select("sample_id", "instability_score").orderBy(F.desc("instability_score"), "sample_id").limit(5)


def trend(curve: DataFrame, value: str, label: str) -> DataFrame:
    """One row over a small curve (a value for each severity_rank and label): delta, direction, peak, its label, monotonic."""
    point = F.struct("severity_rank", label, F.col(value).alias("value"))
    one = curve.agg(F.array_sort(F.collect_list(point)).alias("curve"))  # one row for each severity
    values = F.transform("curve", lambda x: x["value"])
    delta = F.element_at(values, -1) - F.element_at(values, 1)
    later = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    rises = F.forall(F.zip_with(F.slice(values, 1, F.size(later)), later, lambda a, b: b >= a), lambda ok: ok)
    peak = F.array_max(values)
    peaks = F.transform(F.filter("curve", lambda x: x["value"] == peak), lambda x: x[label])
    direction = F.when(delta > 0.02, "increasing").when(delta < -0.02, "decreasing").otherwise("stable")
    return one.filter(F.size("curve") > 0).select(six(delta).alias("delta"), direction.alias("direction"), peak.alias("peak_rate"), F.array_min(peaks).alias("peak_severity"), rises.alias("monotonic"))


@relation
def b7_escalation(r: Frames) -> DataFrame:
    return trend(r.b2_severity_rates, "disagreement_rate", "severity_level")


def placed(df: DataFrame, key: str, value: str) -> DataFrame:
    """A small table ranked by value, with the spread of all."""
    every = W.partitionBy()
    return df.select(key, value, F.row_number().over(W.orderBy(F.desc(value), key)).alias("place"), six(F.max(value).over(every) - F.min(value).over(every)).alias("spread"))


@relation
def b7_models(r: Frames) -> DataFrame:
    return placed(r.b4_model_instability, "model_name", "instability_score")


@relation
def b7_perturbations(r: Frames) -> DataFrame:
    return placed(r.b1_sensitivity, "perturbation_type", "disagreement_rate")


@relation
def b8_flip_rates(r: Frames) -> DataFrame:
    """Flip rate and confidence drop of every type and model, 0 where a model has none, with the canonical order of the types."""
    seen = r.j2_against_clean.groupBy("perturbation_type", "model_name").agg(six(share(F.col("prediction_changed"))).alias("flip_rate"), six(F.avg("confidence_drop")).alias("mean_drop"))
    grid = seen.select("perturbation_type").distinct().crossJoin(seen.select("model_name").distinct())
    full = grid.join(seen, ["perturbation_type", "model_name"], "left").na.fill(0.0, ["flip_rate", "mean_drop"])
    return full.withColumn("type_order", canonical_order("perturbation_type"))


def canonical_order(column: str) -> Column:
    """Place of a corruption in tables; all that are not in the list share the last place and follow by name."""
    at = F.array_position(F.array(*map(F.lit, CORRUPTIONS)), F.col(column)).cast("int")
    return F.when(at > 0, at).otherwise(len(CORRUPTIONS) + 1)


@relation
def b9_instability_metrics(r: Frames) -> DataFrame:
    drop = F.col("confidence_drop")
    return r.j2_against_clean.groupBy("model_name").agg(
        six(share(F.col("prediction_changed"))).alias("flip_rate"), six(F.avg(drop)).alias("mean_drop"), six(F.max(drop)).alias("max_drop"),
        six(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0))).alias("confidence_std"), F.count("*").alias("observations"))


@relation
def b10_accuracy(r: Frames) -> DataFrame:
    right = F.col("predicted_class") == F.col("true_label")
    return r.log.groupBy("model_name", "perturbation_type").agg(six(100.0 * share(right)).alias("accuracy_pct"), six(F.avg("confidence")).alias("mean_confidence"), F.count("*").alias("n"))


@relation
def b10_by_class(r: Frames) -> DataFrame:
    return r.log.groupBy("predicted_class", "perturbation_type").agg(six(F.avg("confidence")).alias("mean_confidence"), F.count("*").alias("n"))
