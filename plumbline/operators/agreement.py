"""Agreement, disagreement and confidence of models on clean samples.

`rows` deals the log by sample once and keeps it on the executors' disks (made again if lost): all relations by sample
group, join and rank within that dealing, without another shuffle. `deduped` holds the first non-null class and
confidence of each sample and model by `seq`.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import clip, nudged, over, share, six
from plumbline.functions.labels import is_clean, rank
from plumbline.operators.frames import Frames, relation

SEVERITIES = ("low", "moderate", "high", "critical")


def hashed(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.xxhash64(c))


def one_value(c: str) -> Column:
    """Whether all values of a group are the same, null if it has none; by 64-bit hashes, which aggregate without objects."""
    return F.min(hashed(c)) == F.max(hashed(c))


@relation
def rows(r: Frames) -> DataFrame:
    log = r.log.select("sample_id", "model_name", "predicted_class", "confidence", "perturbation_type", "severity_level", "seq")
    return log.withColumn("severity_rank", rank("severity_level")).repartition("sample_id").persist(StorageLevel.DISK_ONLY)


@relation
def base(r: Frames) -> DataFrame:
    """The clean rows, as they lie: what follows combines them by sample and model before it deals them out."""
    log = r.log.select("sample_id", "model_name", "predicted_class", "confidence", "perturbation_type", "severity_level", "seq")
    return log.withColumn("severity_rank", rank("severity_level")).filter(is_clean())


@relation
def model_count(r: Frames) -> DataFrame:
    """One row: the number of models with clean rows."""
    return r.log.filter(is_clean()).agg(F.count_distinct("model_name").alias("all_models"))


@relation
def deduped(r: Frames) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return r.base.groupBy("sample_id", "model_name").agg(first("predicted_class"), first("confidence"))


@relation
def complete(r: Frames) -> DataFrame:
    """Samples that every model has classified, with their number of classes."""
    by = r.deduped.filter("predicted_class IS NOT NULL").groupBy("sample_id")
    counts = by.agg(F.count("*").alias("n_models"), F.size(F.collect_set("predicted_class")).alias("n_classes"))
    return counts.crossJoin(F.broadcast(r.model_count)).filter("n_models = all_models").select("sample_id", "n_classes")


@relation
def agreed(r: Frames) -> DataFrame:
    """Samples on which all models agree when clean."""
    return r.complete.filter("n_classes = 1").select("sample_id")


def pairs_of(held: Column) -> Column:
    """The pairs (a, b) of the elements of an array, a before b."""
    after = lambda i: F.slice(held, i + 2, F.size(held))
    return F.flatten(F.transform(held, lambda x, i: F.transform(after(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))


@relation
def both_models(r: Frames) -> DataFrame:
    """Pairs of models a < b within a sample that both have a class for it: made within the array of a sample's models, without a join."""
    by = r.deduped.filter("predicted_class IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("model_name", "predicted_class", "confidence"))).alias("held"))
    both = by.select("sample_id", F.explode(pairs_of(F.col("held"))).alias("p"))
    side = lambda x: [F.col(f"p.{x}.{c}").alias(f"{n}_{x}") for c, n in (("model_name", "model"), ("predicted_class", "class"), ("confidence", "confidence"))]
    return both.select("sample_id", *side("a"), *side("b"))


@relation
def class_pairs(r: Frames) -> DataFrame:
    """How often two models a < b say which classes on the samples that both have."""
    return r.both_models.groupBy("model_a", "model_b", "class_a", "class_b").agg(F.count("*").alias("n"))


@relation
def model_pairs_seen(r: Frames) -> DataFrame:
    """Every pair of models with the samples that both have and on which they agree; without common samples 0."""
    names = r.log.filter(is_clean()).select("model_name").distinct()
    every = names.select(F.col("model_name").alias("model_a")).crossJoin(names.select(F.col("model_name").alias("model_b"))).filter("model_a < model_b")
    seen = r.class_pairs.groupBy("model_a", "model_b").agg(F.sum("n").alias("n_common"), F.sum(F.when(F.col("class_a") == F.col("class_b"), F.col("n")).otherwise(0)).alias("same"))
    return every.join(seen, ["model_a", "model_b"], "left").na.fill(0, ["n_common", "same"])


@relation
def a1_agreement_matrix(r: Frames) -> DataFrame:
    percent = six(F.lit(100.0) * over(F.col("same").cast("double"), F.col("n_common").cast("double"))).alias("agreement_pct")
    ways = [r.model_pairs_seen.select(F.col(x).alias("model_a"), F.col(y).alias("model_b"), percent, "n_common") for x, y in (("model_a", "model_b"), ("model_b", "model_a"))]
    own = r.deduped.filter("predicted_class IS NOT NULL").groupBy("model_name").agg(F.count("*").alias("n_common"))
    own = own.select(F.col("model_name").alias("model_a"), F.col("model_name").alias("model_b"), F.lit(100.0).alias("agreement_pct"), "n_common")
    return ways[0].unionByName(ways[1]).unionByName(own)


@relation
def s9_agreement_pairs(r: Frames) -> DataFrame:
    """The agreement matrix as long pairs with two digits."""
    return r.a1_agreement_matrix.select("model_a", "model_b", F.round("agreement_pct", 2).alias("agreement_pct"))


@relation
def a2_disagreement_statistics(r: Frames) -> DataFrame:
    same, differ = F.col("n_classes") == 1, F.col("n_classes") > 1
    out = r.complete.agg(F.count("*").alias("total_samples"), F.count_if(same).alias("agreement_count"), F.count_if(differ).alias("disagreement_count"), six(share(same)).alias("agreement_rate"), six(share(differ)).alias("disagreement_rate"))
    return out.crossJoin(F.broadcast(r.model_count)).withColumnRenamed("all_models", "n_models")


@relation
def a2_samples_by_model(r: Frames) -> DataFrame:
    return r.log.filter(is_clean()).groupBy("model_name").agg(F.count_distinct("sample_id").alias("samples"))


@relation
def a3_disagreements(r: Frames) -> DataFrame:
    """All clean rows of the samples on which models differ."""
    found = r.complete.filter("n_classes > 1").select("sample_id")
    return r.base.join(found, "sample_id", "left_semi").select("sample_id", "model_name", "predicted_class", "confidence")


@relation
def a4_cohen_kappa(r: Frames) -> DataFrame:
    pair = ["model_a", "model_b"]
    lines = r.class_pairs.groupBy(*pair, F.col("class_a").alias("k")).agg(F.sum("n").alias("in_a"))
    columns = r.class_pairs.groupBy(*pair, F.col("class_b").alias("k")).agg(F.sum("n").alias("in_b"))
    chance = lines.join(columns, [*pair, "k"]).groupBy(*pair).agg(F.sum(F.col("in_a") * F.col("in_b")).cast("double").alias("crossed"))
    seen = r.model_pairs_seen.select(*pair, F.col("n_common").cast("double").alias("n"), F.col("same").cast("double").alias("same"))
    observed, expected = F.col("same") / F.col("n"), F.col("crossed") / (F.col("n") * F.col("n"))
    return seen.join(chance, pair).select(*pair, six(observed).alias("observed"), six(expected).alias("expected"), six(over(observed - expected, 1.0 - expected)).alias("kappa"))


@relation
def a5_fleiss_kappa(r: Frames) -> DataFrame:
    votes = r.deduped.join(r.complete, "sample_id").groupBy("sample_id", "predicted_class").agg(F.count("*").alias("n"))
    by = votes.groupBy("sample_id").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("raters"))
    observed = by.agg(F.avg((F.col("squares") - F.col("raters")) / (F.col("raters") * (F.col("raters") - 1)).cast("double")).alias("observed"))
    sizes = votes.groupBy("predicted_class").agg(F.sum("n").cast("double").alias("n"))
    expected = sizes.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("expected"))
    kappa = over(F.col("observed") - F.col("expected"), 1.0 - F.col("expected"))
    return observed.crossJoin(expected).select(six("observed").alias("observed"), six("expected").alias("expected"), six(kappa).alias("kappa"))


@relation
def gaps(r: Frames) -> DataFrame:
    """Spread of the confidences of each sample's clean rows (not of its models), if there are two rows and one confidence."""
    by = r.base.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.avg("confidence").alias("mean"),
        F.size(F.collect_set("model_name")).cast("long").alias("n_models"), one_value("predicted_class").alias("all_agree"),
    )
    return by.filter("n >= 2 AND low IS NOT NULL")


@relation
def a6_confidence_gaps(r: Frames) -> DataFrame:
    return r.gaps.select(
        "sample_id", six("low").alias("confidence_min"), six("high").alias("confidence_max"), nudged("mean").alias("confidence_mean"),
        six(F.col("high") - F.col("low")).alias("confidence_gap"), "n_models", F.coalesce("all_agree", F.lit(False)).alias("all_agree"),
    )


@relation
def pairs(r: Frames) -> DataFrame:
    """Pairs of models a < b within a sample, both with a class and a confidence."""
    return r.both_models.filter("confidence_a IS NOT NULL AND confidence_b IS NOT NULL").withColumns({"confidence_diff": six(F.abs(F.col("confidence_a") - F.col("confidence_b"))), "classes_agree": F.col("class_a") == F.col("class_b")})


@relation
def clean_samples(r: Frames) -> DataFrame:
    """What the clean rows say of each sample, from one dealing of them: classes if all models have one, gap and mean of the confidences, its pairs' scores."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    c = F.col("confidence")
    dealt = r.base.select("sample_id", "model_name", "predicted_class", "confidence", "seq").repartition("sample_id")
    by = dealt.groupBy("sample_id", "model_name").agg(first("predicted_class"), first("confidence"), F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.sum(c).alias("total"), F.count(c).alias("known"))
    held = F.collect_list(F.when(F.col("predicted_class").isNotNull(), F.struct("model_name", "predicted_class", "confidence")))  # a row for each model
    by = by.groupBy("sample_id").agg(F.array_sort(held).alias("held"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"))
    whole, gap = F.size("held") == F.col("all_models"), (F.col("n") >= 2) & F.col("low").isNotNull()
    wide = by.crossJoin(F.broadcast(r.model_count)).select(
        "sample_id", F.when(whole & (F.size("held") > 0), F.size(F.array_distinct(F.transform("held", lambda x: x["predicted_class"])))).alias("n_classes"),
        F.when(gap, six(F.col("high") - F.col("low"))).alias("confidence_gap"), F.when(gap, nudged("mean")).alias("confidence_mean"), F.explode_outer(pairs_of(F.col("held"))).alias("p"))
    a, b, agree = F.col("p.a.confidence"), F.col("p.b.confidence"), F.col("p.a.predicted_class") == F.col("p.b.predicted_class")
    both = a.isNotNull() & b.isNotNull()
    score = F.when(both, six(disagreement_score(agree, six(F.abs(a - b)), (a + b) / 2.0)))
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), pair_severity(agree, a, b)).cast("int")
    rows = wide.withColumns({"score": score, "place": F.when(both, place)})
    told = [F.max(c).alias(c) for c in ("n_classes", "confidence_gap", "confidence_mean")]  # alike in all of a sample's rows
    return rows.groupBy("sample_id").agg(*told, F.max("place").alias("worst_severity"), F.max("score").alias("most_disagreement"), F.avg("score").alias("mean_disagreement"))


@relation
def a7_spread_summary(r: Frames) -> DataFrame:
    d, same = F.col("confidence_diff"), F.col("classes_agree")
    return r.pairs.agg(
        six(F.avg(d)).alias("mean_diff"), six(F.max(d)).alias("max_diff"), six(F.median(d)).alias("median_diff"), six(F.avg(F.when(same, d))).alias("mean_diff_agree"), six(F.avg(F.when(~same, d))).alias("mean_diff_disagree"),
        F.count("*").alias("pairs"), F.count_if(same).alias("agree_pairs"), F.count_if(~same).alias("disagree_pairs"),
    )


def disagreement_score(agree: Column, diff: Column, mean: Column) -> Column:
    """From 0 to 1: class conflict, distance and (un)certainty of two predictions; a missing confidence adds nothing."""
    factor = F.coalesce(0.6 * diff + 0.4 * F.when(agree, 1.0 - mean).otherwise(mean), F.lit(0.0))
    return clip(F.when(agree, 0.3).otherwise(1.0) * (F.when(agree, 0.0).otherwise(0.5) + 0.5 * factor))


def pair_severity(agree: Column, a: Column, b: Column) -> Column:
    both = lambda least: (a >= least) & (b >= least)
    return F.when(agree, "low").when(a.isNull() | b.isNull(), "moderate").when(both(0.8), "critical").when(both(0.5), "high").otherwise("moderate")


@relation
def p9_scored_pairs(r: Frames) -> DataFrame:
    a, b, agree = F.col("confidence_a"), F.col("confidence_b"), F.col("classes_agree")
    return r.pairs.withColumns({"disagreement_score": six(disagreement_score(agree, F.col("confidence_diff"), (a + b) / 2.0)), "severity": pair_severity(agree, a, b)})


@relation
def a8_score_summary(r: Frames) -> DataFrame:
    s = F.col("disagreement_score")
    return r.p9_scored_pairs.agg(six(F.avg(s)).alias("mean_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"), six(F.median(s)).alias("median_score"), F.count("*").alias("pairs"))


@relation
def a9_sample_severity(r: Frames) -> DataFrame:
    worst = F.max(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))).cast("int")
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_pairs") for s in SEVERITIES]
    return r.p9_scored_pairs.groupBy("sample_id").agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), worst).alias("severity"), *counts)


@relation
def a10_severity_summary(r: Frames) -> DataFrame:
    """Pairs and rate of every severity, also of those that do not occur."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    wide = r.p9_scored_pairs.agg(F.count("*").alias("total"), *counts)
    long = wide.select("total", F.inline(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("pairs")) for s in SEVERITIES))))
    return long.select("severity", "pairs", six(F.coalesce(over(F.col("pairs").cast("double"), F.col("total").cast("double")), F.lit(0.0))).alias("rate"))


@relation
def a10_critical_samples(r: Frames) -> DataFrame:
    return r.p9_scored_pairs.filter(F.col("severity").isin("critical", "high")).select("sample_id", "severity").distinct()
