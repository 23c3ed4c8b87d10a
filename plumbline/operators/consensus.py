"""Consensus reliability, breakdown, false consensus and trust, by sample."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import clip, share, six
from plumbline.functions.labels import STABILISER, TRUST, is_clean, label
from plumbline.operators.agreement import SEVERITIES
from plumbline.operators.frames import Frames, relation

# Weights of the reliability's parts, levels of trust from the lowest on.
RELIABILITY = {"agreement": 0.25, "consistency": 0.20, "stability": 0.25, "severity": 0.15, "steadiness": 0.15}
TRUST_LEVELS = ("critical", "low", "moderate", "high", "very_high")


@relation
def sample_signals(r: Frames) -> DataFrame:
    """What the judgements of a sample are made of, one row for each: agreement and confidences when clean, its pairs, its ladder, its instability.

    Written once to the executors' disks (made again if lost): reliability, breakdown, false consensus, trust and risk are then projections
    this narrow table, in place of joins of their own. Both sides are dealt by sample, so that the join has no shuffle.
    """
    ladder = r.walks.drop("observations", "breaks", "first_rank", "breadth", "rate")
    return r.clean_samples.join(ladder, "sample_id", "full").persist(StorageLevel.DISK_ONLY)


@relation
def reliability_parts(r: Frames) -> DataFrame:
    """The five parts of each complete sample's reliability; a missing one is one half."""
    return r.sample_signals.filter("n_classes IS NOT NULL").select("sample_id", *(c.alias(name) for name, c in reliability_columns().items()))


def reliability_columns() -> dict[str, Column]:
    """The parts of the reliability, from the columns of `sample_signals`."""
    one = F.col("n_classes") == 1
    consistency = 0.6 * (1.0 - F.col("confidence_gap")) + 0.4 * F.col("confidence_mean")
    severity = F.element_at(F.array(*(F.lit(1.0 - k / 3) for k in range(len(SEVERITIES)))), F.col("worst_severity"))
    return {
        "agreement": F.when(one, 1.0).otherwise(0.0), "consistency": F.coalesce(consistency, F.lit(0.5)), "stability": F.coalesce("survival", F.lit(0.5)),
        "severity": F.coalesce(severity, F.when(one, 1.0).otherwise(0.5)), "steadiness": F.coalesce(1.0 - F.col("instability_score"), F.lit(0.5)),
    }


def reliability_of(parts: dict[str, Column]) -> Column:
    return six(clip(sum((w * parts[c] for c, w in list(RELIABILITY.items())[1:]), 0.25 * parts["agreement"])))


@relation
def d1_reliability(r: Frames) -> DataFrame:
    return r.reliability_parts.select(
        "sample_id", F.col("agreement").alias("agreement_strength"), six("consistency").alias("confidence_consistency"), six("stability").alias("perturbation_stability"),
        six("severity").alias("severity_reliability"), six("steadiness").alias("instability_reliability"), reliability_of({c: F.col(c) for c in RELIABILITY}).alias("reliability"),
    )


@relation
def d2_reliability_summary(r: Frames) -> DataFrame:
    x = F.col("reliability")
    means = {"mean_agreement": "agreement_strength", "mean_consistency": "confidence_consistency", "mean_stability": "perturbation_stability", "mean_severity": "severity_reliability", "mean_steadiness": "instability_reliability"}
    out = r.d1_reliability.agg(
        F.count("*").alias("samples"), six(F.avg(x)).alias("mean_reliability"), F.min(x).alias("min_reliability"), F.max(x).alias("max_reliability"), six(F.median(x)).alias("median_reliability"),
        F.count_if(x >= 0.7).alias("reliable"), F.count_if(x < 0.3).alias("unreliable"), *(six(F.avg(c)).alias(name) for name, c in means.items()))
    parts = F.array_min(F.array(*(F.struct(F.col(name).alias("value"), F.lit(c).alias("part")) for name, c in means.items())))
    return out.withColumn("weakest", F.when(F.col("samples") > 0, parts["part"]))


@relation
def breakdowns(r: Frames) -> DataFrame:
    """Samples whose consensus breaks, without what triggers it."""
    broken = r.sample_signals.filter("break_rank IS NOT NULL")
    return broken.select("sample_id", F.col("break_level").alias("collapse_severity"), F.col("steps_before").alias("consensus_duration"), "total_steps", six(1.0 / (F.col("steps_before") + 1)).alias("escalation_speed"), F.coalesce("instability_score", F.lit(0.0)).alias("instability_score"))


@relation
def d3_breakdown(r: Frames) -> DataFrame:
    """Samples whose consensus breaks: where, by what, after how many steps, how fast; an instability that is not known is 0. The trigger is the
    first type by name on which models differ at that severity, clean for a break without perturbation, unknown if they differ on none alone."""
    broken = r.breakdowns
    split = r.observations.filter("differ").select("sample_id", F.col("severity_level").alias("_level"), "perturbation_type")
    at = split.join(broken.select("sample_id", F.col("collapse_severity").alias("level")), "sample_id").filter("_level = level")
    triggers = at.groupBy("sample_id").agg(F.min("perturbation_type").alias("trigger"))
    broken = broken.join(triggers, "sample_id", "left")
    return broken.select(
        "sample_id", F.when(is_clean("collapse_severity"), "clean").otherwise(F.coalesce("trigger", F.lit("unknown"))).alias("collapse_trigger"), "collapse_severity", "consensus_duration", "total_steps", "escalation_speed", "instability_score",
    )


@relation
def d4_consistency(r: Frames) -> DataFrame:
    persistence = r.complete.agg(share(F.col("n_classes") == 1).alias("persistence"))
    stability = r.a6_confidence_gaps.agg((1.0 - F.avg("confidence_gap")).alias("stability"))
    survival = r.levels.agg(share(F.col("models_agree")).alias("survival"))
    evenness = r.b4_model_instability.agg((1.0 - F.coalesce(F.stddev_samp("instability_score"), F.lit(0.0))).alias("evenness"))
    parts = {"persistence": "agreement_persistence", "stability": "confidence_stability", "survival": "consensus_survival", "evenness": "cross_model_consistency"}
    whole = persistence.crossJoin(stability).crossJoin(survival).crossJoin(evenness)
    return whole.select(*(six(c).alias(name) for c, name in parts.items()), six((F.col("persistence") + F.col("stability") + F.col("survival") + F.col("evenness")) / 4).alias("overall"))


@relation
def d5_model_trust(r: Frames) -> DataFrame:
    trust = 1.0 - F.col("instability_score")
    return r.b4_model_instability.select(
        "model_name", six(trust).alias("trust_contribution"), F.row_number().over(W.orderBy("instability_score", "model_name")).alias("trust_rank"),
        F.when(trust >= 0.7, "stabiliser").when(trust < 0.3, "destabiliser").otherwise("neutral").alias("trust_label"),
    )


@relation
def d5_trust_summary(r: Frames) -> DataFrame:
    trust = F.col("trust_contribution")
    names = [name for _, name in STABILISER]
    return r.d5_model_trust.agg(
        F.count("*").alias("models"), six(F.avg(trust)).alias("mean_trust"), six(F.max(trust) - F.min(trust)).alias("trust_spread"),
        F.min_by("model_name", "trust_rank").alias("most_trusted"), F.max_by("model_name", "trust_rank").alias("least_trusted"), *(F.count_if(F.col("trust_label") == n).alias(f"{n}s") for n in names))


@relation
def d6_fragile(r: Frames) -> DataFrame:
    """Samples that agree when clean and break at the first rank."""
    found = r.sample_signals.filter("break_rank = 1 AND n_classes = 1")
    return found.select("sample_id", F.col("break_level").alias("collapse_severity"), F.col("break_rank").alias("collapse_rank"))


@relation
def d7_false_consensus(r: Frames) -> DataFrame:
    """Samples that agree when clean although something speaks against it."""
    found = r.sample_signals.filter("n_classes = 1").select("sample_id", flags_raised().alias("flag_list")).filter(F.size("flag_list") > 0)
    n = F.size("flag_list")
    return found.select("sample_id", F.array_join("flag_list", "|").alias("flags"), n.alias("flag_count"), severity_of_flags(n).alias("false_consensus_severity"))


def flags_raised() -> Column:
    """What speaks against a sample's agreement, from the columns of `sample_signals`."""
    tests = {"high_confidence_gap": F.col("confidence_gap") > 0.3, "low_mean_confidence": F.col("confidence_mean") < 0.5, "fragile_under_perturbation": F.col("break_rank") == 1, "high_instability": F.col("instability_score") > 0.5}
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def severity_of_flags(n: Column) -> Column:
    return F.when(n >= 3, "severe").when(n == 2, "moderate").when(n == 1, "mild")


@relation
def d8_unstable(r: Frames) -> DataFrame:
    rate = F.col("changes") / F.col("transitions").cast("double")
    return r.sample_signals.filter("transitions > 0").filter(rate > 0.3).select("sample_id", "transitions", "changes", six(rate).alias("oscillation_rate"))


@relation
def affected(r: Frames) -> DataFrame:
    """(sample_id, kind) of all samples with a false, fragile or unstable consensus."""
    kinds = {"false_consensus": r.d7_false_consensus, "fragile": r.d6_fragile, "unstable": r.d8_unstable}
    out = None
    for kind, df in kinds.items():
        one = df.select("sample_id", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@relation
def d9_summary(r: Frames) -> DataFrame:
    by = r.affected.groupBy("sample_id").agg(F.collect_set("kind").alias("kinds"))
    return by.agg(*(F.count_if(F.array_contains("kinds", k)).alias(k) for k in ("false_consensus", "fragile", "unstable")), F.count("*").alias("affected_samples"))


@relation
def d9_affected_samples(r: Frames) -> DataFrame:
    return r.affected.select("sample_id").distinct()


@relation
def d9_flag_counts(r: Frames) -> DataFrame:
    flags = r.d7_false_consensus.select(F.lit("flag").alias("part"), F.explode(F.split("flags", r"\|")).alias("name"))
    severities = r.d7_false_consensus.select(F.lit("severity").alias("part"), F.col("false_consensus_severity").alias("name"))
    return flags.unionByName(severities).groupBy("part", "name").agg(F.count("*").alias("samples"))


@relation
def d10_trust(r: Frames) -> DataFrame:
    """Trust of each sample, one or two levels down where its consensus is false."""
    levels = F.array(*map(F.lit, TRUST_LEVELS))
    severity = F.col("false_consensus_severity")
    down = F.when(severity == "severe", 2).when(severity == "moderate", 1).otherwise(0)
    if r.gives("d1_reliability", "d7_false_consensus"):
        joined = r.d1_reliability.select("sample_id", "reliability").join(r.d7_false_consensus.select("sample_id", "false_consensus_severity"), "sample_id", "left")
    else:  # both are of the sample's own row
        told = F.when(F.col("n_classes") == 1, severity_of_flags(F.size(flags_raised())))
        joined = r.sample_signals.filter("n_classes IS NOT NULL").select("sample_id", reliability_of(reliability_columns()).alias("reliability"), told.alias("false_consensus_severity"))
    first = label(F.col("reliability"), TRUST)
    at = F.array_position(levels, F.col("initial_label")).cast("int")
    steps = joined.withColumn("initial_label", first).withColumns({"at": at, "down": down})
    downgraded = (F.col("down") > 0) & (F.col("at") > 1)
    reason = F.when(downgraded, F.concat(F.lit("false_consensus_"), severity))
    return steps.select("sample_id", "reliability", "initial_label", F.element_at(levels, F.greatest(F.col("at") - F.col("down"), F.lit(1))).alias("trust_level"), downgraded.alias("downgraded"), reason.alias("downgrade_reason"))


@relation
def d11_trust_summary(r: Frames) -> DataFrame:
    """Every level of trust, also those that no sample has."""
    by = r.d10_trust.groupBy("trust_level").agg(F.count("*").alias("samples"), F.count_if("downgraded").alias("downgraded"), six(F.avg("reliability")).alias("mean_reliability"))
    levels = r.d10_trust.sparkSession.createDataFrame([(x,) for x in TRUST_LEVELS], "trust_level string")
    full = F.broadcast(levels).join(by, "trust_level", "left").na.fill(0, ["samples", "downgraded"])
    total = F.sum("samples").over(W.partitionBy())
    return full.select("trust_level", "samples", six(F.col("samples") / F.nullif(total, F.lit(0)).cast("double")).alias("rate"), "downgraded", "mean_reliability")


@relation
def d11_trust_ids(r: Frames) -> DataFrame:
    return r.d10_trust.filter(F.col("trust_level").isin("critical", "very_high")).select("trust_level", "sample_id")
