"""Attention maps (arrays of rows of numbers): features, drift from the clean map, likeness of two models' maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import clip, let, nudged, six, total_of
from plumbline.functions.labels import UNCERTAINTY_LADDER, is_clean, rank
from plumbline.operators.uncertainty import correlation
from plumbline.operators.agreement import pairs_of
from plumbline.operators.frames import Frames, relation

#: A cell belongs to the focus of a map from this share of its peak on.
FOCUS = 0.60


def cleaned(m: Column) -> Column:
    """The map between 0 and 1: no number is 0, negatives are 0; a flat map is all zeros."""
    ok = F.transform(m, lambda row: F.transform(row, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(x, F.lit(0.0)))))
    scaled = lambda low, high: F.transform(ok, lambda row: F.transform(row, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0)))
    flat = F.flatten(ok)
    return let(F.struct(F.array_min(flat).alias("low"), F.array_max(flat).alias("high")), lambda e: scaled(e["low"], e["high"]))


def valid(m: Column) -> Column:
    """Whether all rows of the map are equally long, and there are some."""
    return F.coalesce((F.size(m) > 0) & (F.size(F.get(m, F.lit(0))) > 0) & F.forall(m, lambda row: F.size(row) == F.size(F.get(m, F.lit(0)))), F.lit(False))


def resized(m: Column, height: Column, width: Column) -> Column:
    """The map at another size, by the nearest index (half to even)."""
    at = lambda i, old, new: F.when(new > 1, F.bround(i * (old - 1) / (new - 1))).otherwise(0).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    row = lambda i: F.element_at(m, at(i, F.size(m), height) + 1)
    return F.transform(span(height), lambda i: F.transform(span(width), lambda j: F.element_at(row(i), at(j, F.size(F.get(m, F.lit(0))), width) + 1)))


def entropy_of(v: Column) -> Column:
    """Entropy of a flat map's shares, between 0 and 1; without mass 1."""
    total, n = total_of(v), F.size(v)
    p = let(total, lambda t: F.transform(v, lambda x: F.greatest(x / t, F.lit(1e-12))))
    return F.when(total <= 0, 1.0).when(n > 1, clip(total_of(p, lambda x: -x * F.ln(x)) / F.ln(n))).otherwise(0.0)


def centre_of(m: Column, total: Column) -> tuple[Column, Column]:
    """Centre of mass (x, y), each between 0 and 1; without mass the middle."""
    height, width = F.size(m), F.size(F.get(m, F.lit(0)))
    y = total_of(F.transform(m, lambda row, i: total_of(row) * i))
    x = total_of(F.transform(m, lambda row: total_of(F.transform(row, lambda v, j: v * j))))
    mid = lambda s, n: F.when(total > 0, clip(s / total / F.greatest(n - 1, F.lit(1)))).otherwise(0.5)
    return mid(x, width), mid(y, height)


@relation
def maps(r: Frames) -> DataFrame:
    """The maps made comparable, flat as well, with mass, centre and entropy; invalid maps stay without them."""
    keys = ["sample_id", "model_name", "severity_level", "perturbation_type", "predicted_class"]
    ok = valid(F.col("attention_map"))
    rows = r.attention.select(*keys, ok.alias("ok"), F.when(ok, cleaned(F.col("attention_map"))).alias("m"))
    rows = rows.select("*", F.flatten("m").alias("v"))
    rows = rows.select("*", total_of(F.col("v")).alias("mass"))
    x, y = centre_of(F.col("m"), F.col("mass"))
    return rows.select("*", F.when(F.col("ok"), x).alias("x"), F.when(F.col("ok"), y).alias("y"), F.when(F.col("ok"), entropy_of(F.col("v"))).alias("entropy"))


@relation
def p13_features(r: Frames) -> DataFrame:
    v, n = F.col("v"), F.size("v")
    mean, peak = F.col("mass") / n, F.array_max("v")
    variance = let(mean, lambda m: total_of(v, lambda a: (a - m) * (a - m))) / n
    part = lambda least: let(least, lambda l: F.size(F.filter(v, lambda a: a >= l))) / n
    return r.maps.select(
        "sample_id", "model_name", "severity_level", "perturbation_type", F.when(F.col("ok"), "ok").otherwise("invalid").alias("status"), six(mean).alias("mean"), six(variance).alias("variance"), six(F.sqrt(variance)).alias("std"),
        six("entropy").alias("entropy"), six(peak).alias("peak"), six(peak - F.array_min("v")).alias("spread"), six("x").alias("center_x"), six("y").alias("center_y"), six(part(mean)).alias("mass_above_mean"), six(part(0.5 * peak)).alias("active_ratio"))


def focus(v: Column) -> Column:
    return let(F.array_max(v), lambda peak: F.transform(v, lambda x: (peak > 0) & (x >= peak * FOCUS)))


def overlap_of(a: Column, b: Column) -> Column:
    """Cells in both focuses over cells in either."""
    both = F.size(F.filter(F.zip_with(focus(a), focus(b), lambda p, q: p & q), lambda t: t))
    either = F.size(F.filter(F.zip_with(focus(a), focus(b), lambda p, q: p | q), lambda t: t))
    return F.when(either > 0, both / either).otherwise(0.0)


def at_one_size(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Two columns of maps at the larger height and width, flat."""
    height = F.greatest(F.size(one), F.size(two))
    width = F.greatest(F.size(F.get(one, F.lit(0))), F.size(F.get(two, F.lit(0))))
    fit = lambda c: F.when((F.size(c) == height) & (F.size(F.get(c, F.lit(0))) == width), F.col(c)).otherwise(resized(F.col(c), height, width))
    sized = rows.select("*", fit(one).alias("_one"), fit(two).alias("_two"))
    return sized.withColumns({one: F.flatten("_one"), two: F.flatten("_two")}).drop("_one", "_two")


@relation
def x1_drift(r: Frames) -> DataFrame:
    """Each map against the sample's and model's clean one (the first by type); clean maps are left out."""
    key = ["sample_id", "model_name"]
    clean = is_clean("severity_level", UNCERTAINTY_LADDER)
    base = r.maps.filter(clean).groupBy(*key).agg(F.min_by(F.struct("m", "x", "y", "entropy", "ok"), F.struct("severity_level", "perturbation_type")).alias("b"))
    rows = r.maps.filter(~clean).join(base, key).filter(F.col("ok") & F.col("b.ok"))
    rows = rows.select(*key, "severity_level", "perturbation_type", "x", "y", "entropy", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.entropy").alias("b_entropy"), F.col("m").alias("now"), F.col("b.m").alias("was"))
    rows = at_one_size(rows, "now", "was")
    moved = F.sqrt(F.pow(F.col("bx") - F.col("x"), 2) + F.pow(F.col("by") - F.col("y"), 2)) / F.sqrt(F.lit(2.0))
    shift = total_of(F.zip_with("now", "was", lambda a, b: F.abs(a - b))) / F.size("now")
    rows = rows.select(*key, "severity_level", "perturbation_type", moved.alias("displacement"), overlap_of(F.col("now"), F.col("was")).alias("overlap"), shift.alias("l1"), clip(F.col("entropy") - F.col("b_entropy")).alias("entropy_shift"))
    drift = clip(0.45 * F.col("displacement") + 0.35 * (1.0 - F.col("overlap")) + 0.20 * F.col("entropy_shift"))
    reason = F.array_join(F.array_compact(F.array(F.when(F.col("displacement") >= 0.25, "activation_displacement"), F.when(1.0 - F.col("overlap") >= 0.35, "overlap_reduction"), F.when(F.col("entropy_shift") >= 0.25, "entropy_spike"))), "|")
    rows = rows.withColumns({"drift": drift, "severity_rank": rank("severity_level", UNCERTAINTY_LADDER)})
    fell = (F.col("drift") >= 0.65) | (F.col("overlap") <= 0.30) | (F.col("entropy_shift") >= 0.25)
    return rows.select(*key, "severity_level", "severity_rank", "perturbation_type", six("drift").alias("drift"), six("displacement").alias("displacement"), six("overlap").alias("overlap"), six("l1").alias("l1_shift"), six("entropy_shift").alias("entropy_shift"), fell.alias("collapsed"), reason.alias("reason"))


@relation
def x2_similarity(r: Frames) -> DataFrame:
    """Pairs of models' maps of one sample, severity and type."""
    key = ["sample_id", "severity_level", "perturbation_type"]
    by = r.maps.filter("ok").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("model_name", "predicted_class", "m"))).alias("held"))  # the maps of a sample's models
    both = by.select(*key, F.explode(pairs_of(F.col("held"))).alias("p"))
    side = lambda s: [F.col(f"p.{s}.{c}").alias(f"{n}_{s}") for c, n in (("model_name", "model"), ("predicted_class", "class"), ("m", "map"))]
    rows = both.select(*key, *side("a"), *side("b")).filter("model_a < model_b")
    rows = at_one_size(rows, "map_a", "map_b")
    a, b, n = F.col("map_a"), F.col("map_b"), F.size("map_a")
    dot = total_of(F.zip_with(a, b, lambda p, q: p * q))
    sums = {"n": n, "sa": total_of(a), "sb": total_of(b), "aa": total_of(a, lambda x: x * x), "bb": total_of(b, lambda x: x * x), "ab": dot, "mad": total_of(F.zip_with(a, b, lambda p, q: F.abs(p - q))) / n, "overlap": overlap_of(a, b)}
    rows = rows.select(*key, "model_a", "model_b", "class_a", "class_b", *(c.alias(k) for k, c in sums.items()))
    var = lambda s, q: F.col(q) / F.col("n") - F.pow(F.col(s) / F.col("n"), 2)
    covariance = F.col("ab") / F.col("n") - F.col("sa") * F.col("sb") / (F.col("n") * F.col("n"))
    r_ = F.when((var("sa", "aa") > 1e-15) & (var("sb", "bb") > 1e-15), covariance / F.sqrt(var("sa", "aa") * var("sb", "bb"))).otherwise(0.0)
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))))).otherwise(0.0)
    rows = rows.withColumns({"r": r_, "cosine": cosine})
    rows = rows.withColumn("similarity", clip((F.col("overlap") + F.greatest("r", F.lit(0.0)) + F.greatest("cosine", F.lit(0.0))) / 3.0))
    return rows.select(
        *key, "model_a", "model_b", six("similarity").alias("similarity"), six(1.0 - F.col("similarity")).alias("divergence"), six("overlap").alias("overlap"), six("r").alias("correlation"), six("cosine").alias("cosine"), six("mad").alias("mean_absolute_difference"),
        ((F.col("overlap") >= 0.60) & (F.col("r") >= 0.40)).alias("same_focus"), ((F.col("class_a") != F.col("class_b")) & (1.0 - F.col("similarity") >= 0.25)).alias("disagreement_attention"))


@relation
def x3_summary(r: Frames) -> DataFrame:
    ok = F.col("status") == "ok"
    return r.p13_features.agg(F.count("*").alias("maps"), F.count_if(~ok).alias("invalid"), *(six(F.avg(c)).alias(f"mean_{c}") for c in ("entropy", "peak", "spread", "active_ratio")))


@relation
def x3_focused_samples(r: Frames) -> DataFrame:
    """The five most and the five least focused samples, by mean entropy."""
    by = r.p13_features.groupBy("sample_id").agg(nudged(F.avg("entropy")).alias("mean_entropy")).filter("mean_entropy IS NOT NULL")
    top = by.orderBy("mean_entropy", "sample_id").limit(5).withColumn("end", F.lit("most_focused"))
    return top.unionByName(by.orderBy(F.desc("mean_entropy"), "sample_id").limit(5).withColumn("end", F.lit("least_focused")))


@relation
def x4_stability_curve(r: Frames) -> DataFrame:
    return r.x1_drift.groupBy("severity_level", "severity_rank").agg(F.count("*").alias("n"), *(six(F.avg(c)).alias(f"mean_{c}") for c in ("drift", "displacement", "overlap")), six(F.avg(F.col("collapsed").cast("double"))).alias("collapse_rate"))


@relation
def x5_collapses(r: Frames) -> DataFrame:
    """The first collapse of each sample and model, by rank, then the greatest drift."""
    first = F.min(F.struct("severity_rank", (-F.col("drift")).alias("minus"), "severity_level", "perturbation_type", "displacement", "overlap", "reason")).alias("f")
    by = r.x1_drift.filter("collapsed").groupBy("sample_id", "model_name").agg(first)
    return by.select("sample_id", "model_name", F.col("f.severity_level").alias("collapse_severity"), F.col("f.severity_rank").alias("collapse_rank"), F.col("f.perturbation_type").alias("collapse_trigger"), (-F.col("f.minus")).alias("drift"), "f.displacement", "f.overlap", "f.reason")


@relation
def x6_divergence(r: Frames) -> DataFrame:
    return r.x2_similarity.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), six(F.avg("divergence")).alias("mean_divergence"), F.max("divergence").alias("max_divergence"), six(F.avg("similarity")).alias("mean_similarity"), F.count_if("disagreement_attention").alias("disagreements"))


@relation
def x6_consistency(r: Frames) -> DataFrame:
    s = F.col("similarity")
    return r.x2_similarity.agg(F.count("*").alias("pairs"), six(F.avg(s)).alias("mean_similarity"), six(F.avg("overlap")).alias("mean_overlap"), F.count_if(s >= 0.70).alias("consistent"), F.count_if(s < 0.40).alias("inconsistent"), F.count_if("same_focus").alias("same_focus"))


@relation
def x7_drift_summary(r: Frames) -> DataFrame:
    d = F.col("drift")
    worst = lambda key: r.x1_drift.groupBy(key).agg(six(F.avg(d)).alias("m")).agg(F.min(F.struct((-F.col("m")).alias("m"), key))[key].alias(f"most_sensitive_{key}"))
    whole = r.x1_drift.agg(F.count("*").alias("n"), six(F.avg(d)).alias("mean_drift"), F.max(d).alias("max_drift"), F.count_if("collapsed").alias("collapses"), F.count_if(d >= 0.65).alias("high_drift"))
    return whole.crossJoin(worst("model_name")).crossJoin(worst("perturbation_type"))


@relation
def x7_high_drift(r: Frames) -> DataFrame:
    """The samples with a drift of 0.65 or more, and how often."""
    return r.x1_drift.filter("drift >= 0.65").groupBy("sample_id").agg(F.count("*").alias("rows"), F.max("drift").alias("max_drift"))


@relation
def x7_relationship(r: Frames) -> DataFrame:
    """Correlation of each sample's mean drift with its uncertainty, disagreement and instability."""
    drift = r.x1_drift.groupBy("sample_id").agg(F.avg("drift").alias("drift"))
    joined = drift.join(r.signals, "sample_id", "left")
    return joined.agg(F.count("*").alias("samples"), *(six(correlation("drift", c)).alias(f"drift_vs_{c}") for c in ("uncertainty", "disagreement", "instability")))
