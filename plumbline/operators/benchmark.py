"""Benchmark records (model, perturbation, severity, seed, metrics), runs and group splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import over, six
from plumbline.functions.labels import BENCHMARK_LADDER, EFFECT, FEW, label, rank
from plumbline.functions.quantiles import medians, with_median
from plumbline.functions.significance import signed_rank_p_value, t_p_value, t_quantile
from plumbline.operators.frames import Frames, relation

METRICS = ("robustness", "instability", "uncertainty")
BENEFICIAL = ("robustness", "attention_stability", "consensus_reliability")
#: Boards and their metrics; the metrics that are held against the baseline.
BOARDS = {"robustness": "robustness", "stability": "attention_stability", "reliability": "consensus_reliability", "risk": "risk", "uncertainty": "uncertainty", "instability": "instability", "attention_drift": "attention_drift"}
DELTAS = ("robustness", "instability", "uncertainty", "attention_drift", "consensus_reliability", "risk", "disagreement_rate")
BASELINES = ("clean", "original", "baseline")
# Shares of the training and validation splits, least share that is skewed, enough images of a class.
TRAIN, VALIDATION, SKEWED, ENOUGH = 0.70, 0.15, 0.8, 50
#: Hexadecimal digits of a hash that name its bucket: 4,096 of them.
BUCKET_DIGITS = 3


def long_metrics(r: Frames) -> DataFrame:
    return r.records.select("model_name", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS))))


def statistics(m: str) -> list[Column]:
    x = F.col(m)
    return [six(F.avg(x)).alias("mean"), six(F.stddev_pop(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]


@relation
def e1_scalar_statistics(r: Frames) -> DataFrame:
    """All metrics in one aggregate, then as long rows; medians by bins."""
    names = ("n", "mean", "median", "variance", "std", "min", "max", "spread")
    of = lambda m: F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), *statistics(m), six(F.var_pop(m)).alias("variance"), six(F.max(m) - F.min(m)).alias("spread"))
    long = r.records.agg(F.array(*map(of, METRICS)).alias("x")).select(F.inline("x"))
    return with_median(long, medians(long_metrics(r), ["metric"], "x"), ["metric"], "median").select("metric", *names)


@relation
def e2_group_statistics(r: Frames) -> DataFrame:
    columns = [c for m in METRICS for c in (six(F.avg(m)).alias(f"{m}_mean"), six(F.stddev_pop(m)).alias(f"{m}_std"))]
    return r.records.groupBy("model_name", "perturbation_type").agg(F.count("*").alias("record_count"), *columns)


@relation
def e3_levels(r: Frames) -> DataFrame:
    known = r.records.withColumn("severity_rank", rank("severity_level", BENCHMARK_LADDER)).filter("severity_rank < 99")
    columns = [c for m in METRICS for c in (six(F.avg(m)).alias(f"{m}_mean"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    return known.groupBy("severity_level", "severity_rank").agg(F.count("*").alias("n"), *columns)


@relation
def e3_escalation(r: Frames) -> DataFrame:
    """Last level minus first, for each metric, the greatest first; the trend increases if any does."""
    ends = r.e3_levels.agg(*(six(F.max_by(f"{m}_mean", "severity_rank") - F.min_by(f"{m}_mean", "severity_rank")).alias(m) for m in METRICS))
    long = ends.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("escalation")) for m in METRICS))))
    any_up = F.max("escalation").over(W.partitionBy()) > 0
    return long.select("metric", "escalation", F.row_number().over(W.orderBy(F.desc("escalation"), "metric")).alias("escalation_rank"), F.when(any_up, "increasing").otherwise("stable").alias("trend"))


@relation
def e4_correlations(r: Frames) -> DataFrame:
    """All pairs of metrics in one aggregate; the strongest first, with the mean strength."""
    pairs = list(combinations(METRICS, 2))
    one = r.records.agg(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), six(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).alias("r")) for a, b in pairs)).alias("x"))
    long, strength = one.select(F.inline("x")), F.abs("r")
    return long.select("*", F.row_number().over(W.orderBy(F.desc(strength), "metric_a", "metric_b")).alias("place"), six(F.avg(strength).over(W.partitionBy())).alias("mean_strength"))


@relation
def e5_statistics(r: Frames) -> DataFrame:
    """Mean, median, deviation, least and greatest of every metric of each model."""
    of = lambda m: F.struct(F.lit(m).alias("metric"), *statistics(m))
    long = r.records.groupBy("model_name").agg(F.array(*map(of, METRICS)).alias("x")).select("model_name", F.inline("x"))
    keys = ["model_name", "metric"]
    return with_median(long, medians(long_metrics(r), keys, "x"), keys, "median").select(*keys, "mean", "median", "std", "min", "max")


def known(r: Frames, metrics: tuple[str, ...]) -> DataFrame:
    """The records with all of these metrics; one that they do not have is 0 throughout."""
    return r.records.select("*", *(F.lit(0.0).alias(m) for m in metrics if m not in r.records.columns))


@relation
def e5_model_benchmark(r: Frames) -> DataFrame:
    """Each metric's mean between the least (0) and the best (1) of all models; constant metrics count as 1, so absent ones too."""
    metrics = tuple(BOARDS.values())
    means = known(r, metrics).groupBy("model_name").agg(F.count("*").alias("n"), *(six(F.avg(m)).alias(m) for m in metrics))
    every = W.partitionBy()

    def part(m: str) -> Column:
        value = F.coalesce(F.col(m), F.lit(0.0))
        low, high = F.min(value).over(every), F.max(value).over(every)
        at = (value - low) / F.nullif(high - low, F.lit(0.0))
        return F.coalesce(at if m in BENEFICIAL else 1.0 - at, F.lit(1.0))

    scored = means.withColumns({f"s_{m}": part(m) for m in metrics})
    score = six(sum((F.col(f"s_{m}") for m in metrics[1:]), F.col(f"s_{metrics[0]}")) / float(len(metrics)))
    return scored.select("model_name", "n", *(F.col(m).alias(f"mean_{m}") for m in metrics), score.alias("benchmark_score"))


@relation
def e5_leaderboards(r: Frames) -> DataFrame:
    """Places by the score and on each of seven boards, the best first."""
    rows = {"benchmark_score": ("benchmark_score", 1), **{board: (f"mean_{m}", 1 if m in BENEFICIAL else -1) for board, m in BOARDS.items()}}
    boards = F.array(*(F.struct(F.lit(board).alias("board"), F.col(c).alias("value"), (F.col(c) * sign).alias("order")) for board, (c, sign) in rows.items()))
    long = r.e5_model_benchmark.select("model_name", F.inline(boards))
    return long.select("board", "model_name", "value", F.row_number().over(W.partitionBy("board").orderBy(F.desc("order"), "model_name")).alias("place"))


@relation
def e5_summary(r: Frames) -> DataFrame:
    """The leader of each kind; the best model is that of the highest score (of the greater robustness on ties)."""
    first = lambda *order: F.min(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(order)), "model_name"))["model_name"]
    most = lambda m: first(-F.col(f"mean_{m}"))
    least = lambda m: first(F.col(f"mean_{m}"))
    return r.e5_model_benchmark.agg(
        F.count("*").alias("total_models"), first(-F.col("benchmark_score"), -F.col("mean_robustness")).alias("best_robustness_model"), least("instability").alias("most_stable_model"), least("risk").alias("lowest_risk_model"),
        most("attention_stability").alias("best_attention_stability_model"), most("robustness").alias("strongest_perturbation_resilience"), most("consensus_reliability").alias("reliability_leader"))


@relation
def e6_perturbation_benchmark(r: Frames) -> DataFrame:
    """Means of each type against the baseline types, or all records where there is none, and the places of the types."""
    rows = known(r, DELTAS)
    by = rows.groupBy("perturbation_type").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in DELTAS))
    base = F.lower("perturbation_type").isin(*BASELINES)
    some = F.count_if(base) > 0
    baseline = rows.agg(*(F.when(some, F.avg(F.when(base, F.col(m)))).otherwise(F.avg(m)).alias(f"base_{m}") for m in DELTAS))
    deltas = by.crossJoin(F.broadcast(baseline)).withColumns({f"delta_{m}": six(F.col(m) - F.col(f"base_{m}")) for m in DELTAS})
    delta = lambda m: F.coalesce(F.col(f"delta_{m}"), F.lit(0.0))
    pressure = six((delta("disagreement_rate") + delta("uncertainty") + delta("attention_drift")) / 3.0)
    out = deltas.select("perturbation_type", "n", *(F.col(f"delta_{m}") for m in DELTAS), (-delta("robustness")).alias("degradation_impact"), pressure.alias("collapse_pressure"))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("collapse_pressure"), F.desc("degradation_impact"), "perturbation_type")))


@relation
def e6_summary(r: Frames) -> DataFrame:
    rows = r.e6_perturbation_benchmark
    most = lambda c: F.min(F.struct((-F.col(c)).alias("v"), "perturbation_type"))["perturbation_type"]
    mean = lambda c, name: six(F.avg(F.coalesce(F.col(c), F.lit(0.0)))).alias(name)
    return rows.agg(
        F.count("*").alias("total_perturbations"), F.min_by("perturbation_type", "place").alias("most_disruptive"), most("delta_uncertainty").alias("most_uncertain"), most("degradation_impact").alias("most_fragile"),
        mean("degradation_impact", "mean_degradation_impact"), mean("delta_disagreement_rate", "mean_disagreement_escalation"), mean("delta_uncertainty", "mean_uncertainty_escalation"), mean("delta_attention_drift", "mean_attention_drift_impact"))


@relation
def seed_scores(r: Frames) -> DataFrame:
    return r.records.groupBy("model_name", "seed").agg(F.avg("robustness").alias("score"))


@relation
def seed_moments(r: Frames) -> DataFrame:
    return r.seed_scores.groupBy("model_name").agg(F.count("*").alias("seeds"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.median("score").alias("median"))


@relation
def e7_seed_statistics(r: Frames) -> DataFrame:
    return r.seed_moments.select("model_name", "seeds", six("mean").alias("mean"), six("std").alias("std"), six("median").alias("median"))


@relation
def e7_intervals(r: Frames) -> DataFrame:
    """The 95 % interval of each model's mean score, by Student's t."""
    df = F.when(F.col("seeds") > 1, F.col("seeds") - 1).cast("double")
    margin = F.coalesce(t_quantile(df) * F.col("std") / F.sqrt("seeds"), F.lit(0.0))
    four = lambda c: F.round(c, 4)
    return r.seed_moments.select("model_name", "seeds", four(F.col("mean")).alias("mean"), four(F.col("mean") - margin).alias("ci_lower"), four(F.col("mean") + margin).alias("ci_upper"))


@relation
def best_model(r: Frames) -> DataFrame:
    """One row: the model of the highest mean score, the first by name on ties."""
    return r.seed_moments.agg(F.min(F.struct((-F.col("mean")).alias("m"), "model_name"))["model_name"].alias("best_name"))


@relation
def paired(r: Frames) -> DataFrame:
    """Scores of the best and of each other model by seed."""
    named = r.seed_scores.crossJoin(F.broadcast(r.best_model))
    best = named.filter("model_name = best_name").select("seed", F.col("score").alias("best_score"))
    return named.filter("model_name <> best_name").join(best, "seed").select("model_name", "seed", "score", "best_score", (F.col("best_score") - F.col("score")).alias("d"))


@relation
def paired_tests(r: Frames) -> DataFrame:
    """(model_name, pairs, cohens_d, t), not rounded: 0 for fewer than two pairs or equal scores; t is infinite where all differ by the same."""
    pooled = F.sqrt((F.var_samp("best_score") + F.var_samp("score")) / 2.0)
    mean, deviation, pairs = F.avg("d"), F.stddev_samp("d"), F.count("*")
    by = r.paired.groupBy("model_name").agg(pairs.alias("pairs"), over(F.avg("best_score") - F.avg("score"), pooled).alias("d"), mean.alias("mean"), deviation.alias("deviation"))
    same = F.when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * float("inf"))
    t = F.when(F.col("deviation") > 0, F.col("mean") / (F.col("deviation") / F.sqrt(F.col("pairs").cast("double")))).when(F.col("pairs") > 1, same).otherwise(0.0)
    return by.select("model_name", "pairs", F.coalesce("d", F.lit(0.0)).alias("cohens_d"), t.alias("t"))


@relation
def e8_against_best(r: Frames) -> DataFrame:
    return r.paired_tests.select("model_name", "pairs", F.round("cohens_d", 4).alias("cohens_d"), F.round("t", 4).alias("t"))


@relation
def signed_ranks(r: Frames) -> DataFrame:
    """(model_name, n, wilcoxon, zeros, ties): the smaller sum of the ranks of positive and negative differences. Equal sizes share their mean
    rank; ties is the sum of t^3 - t over groups of t equal sizes, zeros the pairs that are left out for being equal."""
    sized = r.paired.withColumn("size", F.round(F.abs("d"), 12))
    w = W.partitionBy("model_name").orderBy("size")
    alike = F.count("*").over(W.partitionBy("model_name", "size"))
    ranked = sized.filter("size > 0").withColumns({"alike": alike, "rank": F.rank().over(w) + (alike - 1) / 2.0})
    sums = ranked.groupBy("model_name").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"), F.sum(F.col("alike") * F.col("alike") - 1.0).alias("ties"))
    zeros = sized.groupBy("model_name").agg(F.count_if(F.col("size") == 0).alias("zeros"))
    return sums.join(zeros, "model_name").select("model_name", "n", F.least("up", "down").alias("wilcoxon"), "zeros", "ties")


@relation
def e8_signed_ranks(r: Frames) -> DataFrame:
    return r.signed_ranks.select("model_name", "n", "wilcoxon")


@relation
def e9_significance(r: Frames) -> DataFrame:
    """Each model against the best: effect, both tests with p-values, stars of the t-test. Tests without enough pairs (two, or three for the
    ranks) or without a difference have statistic 0 and p 1."""
    joined = r.paired_tests.join(r.signed_ranks, "model_name", "left")
    p = F.coalesce(t_p_value(F.when(F.col("pairs") > 1, F.col("t")), (F.col("pairs") - 1).cast("double")), F.lit(1.0))
    ranked = F.when(F.col("pairs") >= 3, F.col("wilcoxon"))
    p_ranks = signed_rank_p_value(ranked, F.col("n").cast("double"), F.col("ties") + F.col("zeros"), F.col("ties"))
    rows = joined.withColumns({"p": p, "w": ranked, "p_w": F.coalesce(p_ranks, F.lit(1.0))})
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    effect = F.when(F.col("pairs") < 2, FEW).otherwise(label(F.abs("cohens_d"), EFFECT))
    return rows.select("model_name", F.round("cohens_d", 4).alias("cohens_d"), effect.alias("effect"), F.round("t", 4).alias("t"), F.round("p", 6).alias("p_t"), F.coalesce("w", F.lit(0.0)).alias("wilcoxon"), F.round("p_w", 6).alias("p_wilcoxon"), stars.alias("stars"))


@relation
def e10_stage_usage(r: Frames) -> DataFrame:
    return r.runs.groupBy("stage").agg(F.count("*").alias("runs"), F.count_distinct("experiment").alias("experiments"))


@relation
def e10_registry(r: Frames) -> DataFrame:
    """How many registered experiments use each stage and each model."""
    named = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    uses = r.registry.select(F.inline(F.concat(named("stage", F.col("enabled_stages")), named("model", F.col("models")))))
    return uses.groupBy("kind", "name").agg(F.count("*").alias("experiments"))


@relation
def e10_totals(r: Frames) -> DataFrame:
    return r.registry.agg(F.count("*").alias("total_experiments"), F.count_distinct("experiment_id").alias("experiment_ids"))


@relation
def e10_execution(r: Frames) -> DataFrame:
    status = F.col("status")
    return r.runs.agg(F.count_distinct("experiment").alias("experiments"), *(F.count_if(status == s).alias(s) for s in ("completed", "failed", "skipped")), six(over(F.count_if(status == "completed").cast("double"), F.count("*").cast("double"))).alias("integrity"))


@relation
def e11_class_counts(r: Frames) -> DataFrame:
    by = r.log.groupBy("true_label").agg(F.count("*").alias("n"))
    return by.select("true_label", "n", six(F.least(F.col("n") / float(ENOUGH), F.lit(1.0))).alias("sufficiency"), six(F.col("n") / F.sum("n").over(W.partitionBy()).cast("double")).alias("share"))


@relation
def e11_readiness(r: Frames) -> DataFrame:
    """Balance of the classes, coverage, sufficiency, their mean in percent, and what to mend (names joined by |)."""
    n = F.col("n")
    classes = r.e11_class_counts.filter("true_label IS NOT NULL").agg(
        F.count("*").alias("classes"), F.sum("n").alias("rows"), F.coalesce(over(F.min(n).cast("double"), F.max(n).cast("double")), F.lit(0.0)).alias("balance"), six(F.avg("sufficiency")).alias("mean_sufficiency"), F.count_if(n < ENOUGH).alias("small_classes"))
    graded = rank("severity_level", BENCHMARK_LADDER) < 99
    clean = F.col("severity_level").isin("clean", "none", "original")
    covered = r.log.agg(F.count_distinct(F.when(~clean, F.col("perturbation_type"))).alias("profiles"), F.count_distinct(F.when(graded, F.col("severity_level"))).alias("levels"))
    calibrated = r.c11_frame.agg(F.count("*").alias("calibrated"))
    ratio = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    rows = classes.crossJoin(covered).crossJoin(calibrated).select(
        "*", F.when(F.col("classes") > 0, 1.0).otherwise(0.0).alias("validation_coverage"), six(ratio("profiles", "levels")).alias("perturbation_coverage"),
        six(F.least(F.coalesce("rows", F.lit(0)) / float(ENOUGH), F.lit(1.0))).alias("sample_sufficiency"), six(F.least(ratio("calibrated", "classes"), F.lit(1.0))).alias("calibration_sufficiency"))
    parts = ("balance", "validation_coverage", "perturbation_coverage", "sample_sufficiency", "calibration_sufficiency")
    score = six(100.0 * sum((F.col(c) for c in parts[1:]), F.col(parts[0])) / float(len(parts)))
    warnings = F.array(F.when((F.col("balance") < 0.5) & (F.col("classes") > 0), "class_balance"), F.when(F.col("perturbation_coverage") < 1.0, "perturbation_coverage"), F.when(F.col("sample_sufficiency") < 0.6, "sample_sufficiency"), F.when(F.col("calibration_sufficiency") < 0.5, "calibration_sufficiency"))
    return rows.select("classes", six("balance").alias("balance"), "mean_sufficiency", "small_classes", (F.col("balance") < 0.5).alias("unbalanced"), *parts[1:], F.when((F.col("classes") > 0), score).otherwise(0.0).alias("readiness_score"), F.array_join(F.array_compact(warnings), "|").alias("warnings"))


@relation
def e12_consistency(r: Frames) -> DataFrame:
    """Whether models whose confidence drops more are less robust; a correlation above -0.1 is a warning."""
    joined = r.c2_stability.select("model_name", "confidence_drop").join(r.c4_robustness.select("model_name", "robustness_score"), "model_name")
    r_ = F.nullif(F.corr("confidence_drop", "robustness_score"), F.lit(float("nan")))
    return joined.agg(six(r_).alias("correlation"), (r_ > -0.1).alias("warning"))


@relation
def plate_order(r: Frames) -> DataFrame:
    """Plates of each class in the order of a hash; plates of the dropped kind are left out.

    A plate's place is the number of plates in the buckets of hashes before its own, from counts of at most 4,096 a class, and its place within
    the bucket, so a class with a third of all plates is ranked by as many tasks as there are buckets.
    """
    plates = r.plates.filter(~F.lower("plate_name").contains("conkey")).select("class_name", "plate_name").distinct()
    order = F.md5(F.concat(F.lit("42:"), "class_name", F.lit("/"), "plate_name"))
    dealt = plates.select("class_name", "plate_name", order.alias("order")).withColumn("bucket", F.conv(F.substring("order", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    counts = dealt.groupBy("class_name", "bucket").agg(F.count("*").alias("c"))
    w = W.partitionBy("class_name")
    base = counts.select(F.col("class_name").alias("_class"), F.col("bucket").alias("_bucket"), (F.sum("c").over(w.orderBy("bucket")) - F.col("c")).alias("base"), F.sum("c").over(w).alias("n"))
    within = F.row_number().over(W.partitionBy("class_name", "bucket").orderBy("order", "plate_name"))
    rows = dealt.withColumn("within", within).join(base, F.col("class_name").eqNullSafe(F.col("_class")) & (F.col("bucket") == F.col("_bucket")))
    return rows.select("class_name", "plate_name", (F.col("base") + F.col("within")).alias("place"), "n")


@relation
def g1_splits(r: Frames) -> DataFrame:
    """Whole plates go to one split: 70 % and 15 %, rounded half to even, one at least; what is too much goes from validation, then from training."""
    n = F.col("n")
    part = lambda share: F.greatest(F.lit(1), F.bround(n * share).cast("long"))
    sized = r.plate_order.withColumns({"train": part(TRAIN), "val": part(VALIDATION)})
    over_full = F.greatest(F.lit(0), F.col("train") + F.col("val") + F.greatest(F.lit(1), n - F.col("train") - F.col("val")) - n)
    sized = sized.withColumn("excess", over_full).withColumn("from_val", F.least("excess", F.col("val") - 1))
    train = F.when(n <= 2, 1).otherwise(F.col("train") - (F.col("excess") - F.col("from_val")))
    val = F.when(n <= 2, n - 1).otherwise(F.col("val") - F.col("from_val"))
    place = F.col("place")
    return sized.select("class_name", "plate_name", F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test").alias("split"))


@relation
def g2_images(r: Frames) -> DataFrame:
    return r.plates.join(r.g1_splits, ["class_name", "plate_name"]).groupBy("class_name", "plate_name", "split").agg(F.count("*").alias("images"))


@relation
def g2_totals(r: Frames) -> DataFrame:
    by = r.g2_images.groupBy("split").agg(F.sum("images").alias("images"), F.count("*").alias("plates"))
    return by.withColumn("percent", six(100.0 * F.col("images") / F.sum("images").over(W.partitionBy())))


@relation
def g3_skew(r: Frames) -> DataFrame:
    by = r.g2_images.groupBy("split", "class_name").agg(F.sum("images").alias("images"))
    share = F.col("images") / F.sum("images").over(W.partitionBy("split")).cast("double")
    return by.select("split", "class_name", "images", six(share).alias("share"), ((share > SKEWED) & (F.col("split") != "train")).alias("skewed"))


@relation
def g4_leaks(r: Frames) -> DataFrame:
    by = r.g1_splits.groupBy("class_name", "plate_name").agg(F.count_distinct("split").alias("splits"))
    return by.groupBy("class_name").agg(F.count("*").alias("plates"), F.count_if(F.col("splits") > 1).alias("leaking"))


@relation
def g4_class_sets(r: Frames) -> DataFrame:
    """Classes that are in only one of training and validation."""
    held = lambda s: r.g1_splits.filter(F.col("split") == s).select("class_name").distinct()
    only = lambda a, b: held(a).exceptAll(held(b)).withColumn("only_in", F.lit(a))
    return only("train", "val").unionByName(only("val", "train"))
