"""Entropy and dispersion of probability vectors of any length, confidence collapse, conflicts and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import clip, let, nudged, six, total_of
from plumbline.functions.labels import RISK, SHAPE, UNCERTAINTY_LADDER, is_clean, label, rank
from plumbline.operators.perturbation import placed, trend
from plumbline.operators.frames import Frames, relation

#: Size of a vector that is filled from a confidence.
FILLED = 4


def normalised(rows: DataFrame, p: str, confidence: str, size: int = 2) -> DataFrame:
    """Adds status and p: the vector without what is no number and without negatives, made to add up to 1; without one, the
    confidence and the rest; without that, even shares. Each step is a column, so that none is computed twice."""
    finite = F.filter(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = rows.withColumn("_held", F.transform(finite, lambda x: F.greatest(x, F.lit(0.0))))
    held = held.withColumn("_total", total_of(F.col("_held")))
    sound, known = (F.size("_held") > 0) & (F.col("_total") > 0), F.col(confidence).isNotNull() & ~F.isnan(confidence)
    near = F.abs(F.col("_total") - 1.0) <= 1e-6
    status = F.when(sound, F.when(near, "valid").otherwise("normalized")).when(known, "confidence_proxy").otherwise("uniform_fallback")
    c = clip(F.col(confidence))
    v = F.when(sound, F.when(near, F.col("_held")).otherwise(F.transform("_held", lambda x: x / F.col("_total")))).when(known, F.array(c, 1.0 - c)).otherwise(F.array_repeat(F.lit(1.0 / size), size))
    return held.withColumns({"status": status, "p": v}).drop("_held", "_total")


def filled(p: Column, index: Column, confidence: Column, size: int = FILLED) -> Column:
    """The vector, or where it is missing the confidence at the predicted class and even shares of the rest."""
    c = clip(F.coalesce(confidence, F.lit(0.5)))
    made = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.pmod(index, F.lit(size)), c).otherwise((1.0 - c) / (size - 1)))
    return F.coalesce(p, made)


@relation
def vectors(r: Frames) -> DataFrame:
    """The log with probability vectors, filled where there is none; a class's index is the number at the end of its name."""
    index = F.regexp_extract("predicted_class", r"(\d+)$", 1).try_cast("int")
    held = F.col("probabilities") if "probabilities" in r.log.columns else F.lit(None).cast("array<double>")
    return r.log.select("sample_id", "model_name", "perturbation_type", "severity_level", "seq", "confidence", filled(held, F.coalesce(index, F.lit(0)), F.col("confidence")).alias("probabilities"))


@relation
def p6_filled(r: Frames) -> DataFrame:
    long = r.vectors.select("model_name", "severity_level", F.posexplode("probabilities").alias("k", "p"))
    return long.groupBy("model_name", "severity_level", "k").agg(F.count("*").alias("n"), six(F.avg("p")).alias("mean_probability"))


@relation
def entropies(r: Frames) -> DataFrame:
    """Metrics of each row's vector, rounded to six digits before anything is averaged."""
    rows = normalised(r.vectors, "probabilities", "confidence").withColumns({"size": F.size("p"), "m": sums_of(F.col("p"))})
    n, top, entropy = F.col("size"), F.col("m.top"), F.col("m.entropy")
    mean = F.col("m.total") / n
    variance = F.greatest(F.lit(0.0), F.col("m.squares") / n - mean * mean)
    score = F.when(n > 1, clip(entropy / F.ln(n))).otherwise(0.0)
    return rows.select(
        "sample_id", "model_name", "perturbation_type", "severity_level", "seq", "confidence", "status", six(entropy).alias("entropy"), six(score).alias("uncertainty_score"), six(top).alias("peak"),
        six(variance).alias("variance"), six(F.sqrt(variance)).alias("std"), six(top - F.col("m.least")).alias("spread"), "size", six("m.total").alias("total"),
        (F.col("status") == "confidence_proxy").alias("proxy"), six(1.0 - top).alias("flatness"), six(top - F.col("m.second")).alias("top2_gap"), label(top, SHAPE).alias("shape"),
    )


def sums_of(p: Column) -> Column:
    """total, squares, entropy, top, second and least of a vector, in one pass over it."""
    zero = F.struct(*(F.lit(x).alias(n) for n, x in (("total", 0.0), ("squares", 0.0), ("entropy", 0.0), ("top", 0.0), ("second", 0.0), ("least", float("inf")))))

    def add(s: Column, x: Column) -> Column:
        safe = F.least(F.lit(1.0), F.greatest(x, F.lit(1e-12)))
        return F.struct(
            (s["total"] + x).alias("total"), (s["squares"] + x * x).alias("squares"), (s["entropy"] - safe * F.ln(safe)).alias("entropy"), F.greatest(s["top"], x).alias("top"),
            F.greatest(s["second"], F.least(s["top"], x)).alias("second"), F.least(s["least"], x).alias("least"))

    return F.aggregate(p, zero, add)


@relation
def p5_status(r: Frames) -> DataFrame:
    return r.entropies.groupBy("status").agg(F.count("*").alias("n"), six(F.avg("total")).alias("mean_total"), F.max("size").alias("most_classes"))


@relation
def p7_entropy(r: Frames) -> DataFrame:
    names = ["entropy", "uncertainty_score", "peak", "variance", "std", "spread", "total"]
    return r.entropies.groupBy("sample_id", "model_name").agg(F.count("*").alias("n"), *(nudged(F.avg(c)).alias(c) for c in names), F.count_if("proxy").alias("proxies"))


@relation
def p8_dispersion(r: Frames) -> DataFrame:
    names = {"peak": "concentration", "flatness": "flatness", "top2_gap": "top2_gap", "variance": "variance", "spread": "spread"}
    return r.entropies.groupBy("sample_id", "model_name").agg(*(nudged(F.avg(c)).alias(name) for c, name in names.items()), *(F.count_if(F.col("shape") == s).alias(s) for _, s in SHAPE))


U = "uncertainty_score"


@relation
def u1_entropy_summary(r: Frames) -> DataFrame:
    u = F.col(U)
    return r.entropies.agg(F.count("*").alias("n"), six(F.avg("entropy")).alias("mean_entropy"), six(F.avg(u)).alias("mean_uncertainty"), F.max(u).alias("max_uncertainty"), F.count_if(u >= 0.6).alias("high"), F.count_if(u >= 0.8).alias("critical"))


@relation
def u2_sample_uncertainty(r: Frames) -> DataFrame:
    u = F.col(U)
    return r.entropies.groupBy("sample_id").agg(nudged(F.avg(u)).alias("mean_uncertainty"), F.max(u).alias("max_uncertainty"), F.min(u).alias("min_uncertainty"), nudged(F.avg("entropy")).alias("mean_entropy"), nudged(F.avg("confidence")).alias("mean_confidence"), F.count("*").alias("observations"))


def curve(rows: DataFrame, key: str) -> DataFrame:
    u = F.col(U)
    return rows.groupBy(key).agg(F.count("*").alias("observations"), six(F.avg(u)).alias("mean_uncertainty"), F.max(u).alias("max_uncertainty"), F.min(u).alias("min_uncertainty"))


@relation
def u3_severity_curve(r: Frames) -> DataFrame:
    return curve(r.entropies, "severity_level").withColumn("severity_rank", rank("severity_level", UNCERTAINTY_LADDER))


@relation
def u4_perturbations(r: Frames) -> DataFrame:
    return curve(r.entropies, "perturbation_type").withColumns({"spread": six(F.col("max_uncertainty") - F.col("min_uncertainty")), "place": F.row_number().over(W.orderBy(F.desc("mean_uncertainty"), "perturbation_type"))})


@relation
def u5_collapses(r: Frames) -> DataFrame:
    """For each sample and model the first row, in order of severity, whose entropy rises by 0.25 or whose confidence falls by 0.20
    against the first clean row (without one, the first row). Clean rows have the least rank, so that is the first row in either case: one dealing
    and one order of the rows serve for both."""
    rows = r.entropies.select("sample_id", "model_name", "perturbation_type", "severity_level", "seq", "confidence", U).withColumn("severity_rank", rank("severity_level", UNCERTAINTY_LADDER))
    key = ["sample_id", "model_name"]
    order = W.partitionBy(*key).orderBy("severity_rank", "severity_level", "seq")
    held = F.struct(U, F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    joined = rows.withColumn("base", F.first(held).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rise = F.col(U) - F.col(f"base.{U}")
    fall = F.col("base.confidence") - F.coalesce("confidence", "base.confidence")
    reason = F.array_join(F.array_compact(F.array(F.when(rise >= 0.25, "entropy_spike"), F.when(fall >= 0.2, "confidence_degradation"))), "|")
    found = joined.withColumns({"rise": rise, "fall": fall}).filter((F.col("rise") >= 0.25) | (F.col("fall") >= 0.2)).withColumn("reason", reason)
    first = found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*key, F.struct("perturbation_type", "severity_level", "severity_rank", "base", U, "confidence", "rise", "fall", "reason").alias("x"))
    return first.select(
        *key, F.col("x.perturbation_type").alias("collapse_trigger"), F.col("x.severity_level").alias("collapse_severity"), F.col("x.severity_rank").alias("collapse_rank"), F.col(f"x.base.{U}").alias("baseline_entropy"), F.col(f"x.{U}").alias("collapse_entropy"),
        six("x.rise").alias("entropy_shift"), six("x.fall").alias("confidence_drop"), F.col("x.reason").alias("collapse_reason"),
    )


@relation
def u6_collapse_summary(r: Frames) -> DataFrame:
    return r.u5_collapses.agg(
        F.count("*").alias("collapses"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("model_name").alias("models"), six(F.coalesce(F.avg("entropy_shift"), F.lit(0.0))).alias("mean_shift"), six(F.coalesce(F.avg("confidence_drop"), F.lit(0.0))).alias("mean_drop"))


@relation
def u6_collapse_counts(r: Frames) -> DataFrame:
    long = r.u5_collapses.select(F.inline(F.array(F.struct(F.lit("trigger").alias("part"), F.col("collapse_trigger").alias("name")), F.struct(F.lit("severity").alias("part"), F.col("collapse_severity").alias("name")))))
    return long.groupBy("part", "name").agg(F.count("*").alias("n"))


def dispersion(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(six(F.avg("peak")).alias("mean_concentration"), six(F.avg("top2_gap")).alias("mean_gap"), six(F.avg("std")).alias("mean_std"), F.count_if(F.col("shape") == "flat").alias("flat"), F.count_if(F.col("shape") == "peaked").alias("peaked"))


@relation
def u7_dispersion_by_model(r: Frames) -> DataFrame:
    return dispersion(r.entropies, "model_name")


@relation
def u7_dispersion_by_sample(r: Frames) -> DataFrame:
    return dispersion(r.entropies, "sample_id").withColumns({c: nudged(c) for c in ("mean_concentration", "mean_gap", "mean_std")})


@relation
def u8_top_samples(r: Frames) -> DataFrame:
    return r.u2_sample_uncertainty.select("sample_id", "mean_uncertainty").orderBy(F.desc("mean_uncertainty"), "sample_id").limit(5)


@relation
def u8_levels(r: Frames) -> DataFrame:
    return r.u2_sample_uncertainty.groupBy(label(F.coalesce("mean_uncertainty", F.lit(0.5)), RISK).alias("uncertainty_level")).agg(F.count("*").alias("samples"))


@relation
def u8_summary(r: Frames) -> DataFrame:
    """Uncertainty of all observations: statistics, levels, and the five most uncertain samples. Scores have six digits, so the median's map has a million
    entries at most."""
    u = F.col(U)
    least = {name: low for low, name in RISK}
    level = label(u, RISK)
    whole = r.entropies.agg(F.count("*").alias("observations"), six(F.avg(u)).alias("mean_uncertainty"), F.max(u).alias("max_uncertainty"), F.min(u).alias("min_uncertainty"), six(F.median(u)).alias("median_uncertainty"), *(F.count_if(level == name).alias(name) for name in least))
    top = r.u8_top_samples.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean_uncertainty")).alias("m"), "sample_id"))), lambda x: x["sample_id"]), "|").alias("most_uncertain"))  # five rows
    return whole.crossJoin(top)


@relation
def signals(r: Frames) -> DataFrame:
    """Uncertainty, mean disagreement of pairs and instability of each sample."""
    others = r.sample_signals.select("sample_id", F.col("mean_disagreement").alias("disagreement"), F.col("instability_score").alias("instability"))
    return r.u2_sample_uncertainty.select("sample_id", F.col("mean_uncertainty").alias("uncertainty")).join(others, "sample_id", "left")


@relation
def u9_conflicts(r: Frames) -> DataFrame:
    """Samples on which two signals are 0.6 or more, or one is and their mean is 0.65 or more."""
    names = ("disagreement", "instability", "uncertainty")
    reasons = F.array_compact(F.array(*(F.when(F.col(c) >= 0.6, F.lit(c)) for c in names)))
    present = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), clip(F.col(c))) for c in names)))
    score = total_of(present) / F.size(present)
    found = r.signals.withColumns({"reasons": reasons, "conflict_score": clip(score)})
    found = found.filter((F.size("reasons") >= 2) | ((F.size("reasons") == 1) & (F.col("conflict_score") >= 0.65)))
    return found.select("sample_id", nudged("uncertainty").alias("uncertainty"), nudged("disagreement").alias("disagreement"), nudged("instability").alias("instability"), nudged("conflict_score").alias("conflict_score"), F.array_join("reasons", "|").alias("conflict_reason"))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over the rows that have both; 0 where it is not defined."""
    r = F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


@relation
def u10_relationship(r: Frames) -> DataFrame:
    out = {"uncertainty_vs_disagreement": ("uncertainty", "disagreement"), "uncertainty_vs_instability": ("uncertainty", "instability"), "disagreement_vs_instability": ("disagreement", "instability")}
    one = r.signals.agg(*(six(correlation(*pair)).alias(name) for name, pair in out.items()))
    return one.crossJoin(r.u9_conflicts.agg(F.count("*").alias("conflicts"), six(F.coalesce(F.avg("conflict_score"), F.lit(0.0))).alias("mean_conflict_score")))


@relation
def u11_model_profiles(r: Frames) -> DataFrame:
    """Uncertainty of each model, clean against perturbed (or all, without clean rows), dispersion, collapses, sensitivity and its label."""
    u, clean = F.col(U), is_clean("severity_level", UNCERTAINTY_LADDER)
    by = r.entropies.groupBy("model_name").agg(
        F.count("*").alias("n"), F.avg(u).alias("mean"), F.max(u).alias("high"), F.min(u).alias("low"), F.stddev_pop(u).alias("std"), F.avg(F.when(clean, u)).alias("clean"), F.avg(F.when(~clean, u)).alias("perturbed"),
        F.avg("variance").alias("variance"), F.avg("std").alias("deviation"), F.avg("spread").alias("spread"), F.avg("peak").alias("peak"))
    falls = r.u5_collapses.groupBy("model_name").agg(F.count("*").alias("collapses"), six(F.avg("entropy_shift")).alias("shift"))
    joined = by.join(falls, "model_name", "left").withColumns({"delta": F.coalesce(F.col("perturbed") - F.coalesce("clean", "mean"), F.lit(0.0)), "falls": F.coalesce("collapses", F.lit(0))})
    mean, delta = F.col("mean"), F.col("delta")
    name = F.when((mean >= 0.80) | (delta >= 0.30) | (F.col("falls") > 0), "highly_sensitive").when((mean >= 0.60) | (delta >= 0.15), "sensitive").when((mean >= 0.35) | (delta >= 0.08), "moderate").when(mean >= 0.15, "stable").otherwise("very_stable")
    return joined.select(
        "model_name", "n", six("mean").alias("mean_uncertainty"), F.col("high").alias("max_uncertainty"), F.col("low").alias("min_uncertainty"), six("std").alias("std_uncertainty"), six("clean").alias("clean_uncertainty"), six("perturbed").alias("perturbed_uncertainty"),
        six(delta).alias("uncertainty_delta"), six("variance").alias("mean_variance"), six("deviation").alias("mean_std"), six("spread").alias("mean_spread"), six("peak").alias("mean_concentration"), F.col("falls").alias("collapses"), F.coalesce("shift", F.lit(0.0)).alias("mean_collapse_shift"),
        six(clip(0.7 * F.greatest(delta, F.lit(0.0)) + 0.3 * F.col("spread"))).alias("sensitivity"), name.alias("stability_label"))


@relation
def u11_summary(r: Frames) -> DataFrame:
    """The most and the least certain model, the one that loses most under perturbation, and those that are sensitive."""
    mean, delta = F.col("mean_uncertainty"), F.col("uncertainty_delta")
    first = lambda a, b: F.min(F.struct(a.alias("a"), b.alias("b"), "model_name"))["model_name"]
    least = F.max(F.struct((-mean).alias("a"), (-delta).alias("b"), "model_name"))["model_name"]
    sensitive = F.sort_array(F.collect_list(F.when(F.col("stability_label").isin("sensitive", "highly_sensitive"), F.col("model_name"))))  # models are a catalogue
    return r.u11_model_profiles.agg(F.count("*").alias("total_models"), six(F.avg(mean)).alias("mean_uncertainty"), least.alias("most_stable_model"), first(-mean, -delta).alias("highest_uncertainty_contributor"), first(-delta, -mean).alias("fastest_deteriorating_model"), F.array_join(sensitive, "|").alias("sensitive_models"))


@relation
def u12_trend(r: Frames) -> DataFrame:
    return trend(r.u3_severity_curve, "mean_uncertainty", "severity_level")


@relation
def u12_perturbations(r: Frames) -> DataFrame:
    return placed(r.u4_perturbations, "perturbation_type", "mean_uncertainty")
