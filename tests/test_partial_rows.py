"""Rules with several branches: correctness, trust without reliability, triggers of a break, absent metrics, calibration without labels."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators.evaluation import with_correctness
from plumbline.operators.risk import risk_of_trust
from plumbline.plans import relation

LOG = "sample_id string, model_name string, predicted_class string, confidence double, perturbation_type string, severity_level string, seq string"


def log(spark, rows):
    return spark.createDataFrame([(*r, f"{i:04d}") for i, r in enumerate(rows)], LOG)


def test_the_first_rule_of_correctness_that_applies(spark):
    rows = log(spark, [("s", "m", "a", 0.9, "clean", "clean"), ("s", "m", "b", 0.9, "blur", "mild"), ("t", "m", "a", 0.8, "blur", "mild"), ("t", "n", "a", 0.8, "blur", "mild")])
    count = lambda df: [r["correct"] for r in with_correctness(df).orderBy("seq").collect()]
    assert count(rows) == [True, False, True, False]  # n has no original prediction
    labelled = rows.withColumn("true_label", F.when(F.col("seq") < "0002", "b"))
    assert count(labelled) == [False, True, False, False]
    changed = labelled.withColumn("prediction_changed", F.col("seq") == "0000")
    assert count(changed) == [False, True, True, True]
    assert count(changed.withColumn("correct", F.lit(0))) == [False] * 4
    with pytest.raises(ValueError):
        with_correctness(rows.select("model_name", "predicted_class"))


def test_calibration_by_label_or_proxy(spark):
    rows = log(spark, [("s", "m", "a", 0.9, "clean", "clean"), ("s", "m", "b", 0.9, "blur", "mild"), ("s", "n", "c", 0.0, "blur", "mild"), ("t", "n", "d", None, "blur", "mild")])
    plain = {r["model_name"]: r for r in relation("c11_frame", log=rows).collect()}
    assert (plain["m"]["calibration_mode"], plain["m"]["accuracy"], plain["m"]["ece"]) == ("proxy", 0.5, pytest.approx(0.4))
    assert (plain["n"]["accuracy"], plain["n"]["mean_confidence"], plain["n"]["ece"]) == (0.5, 0.0, 0.0)  # no original: its first row; 0 is in no bin
    half = rows.withColumn("true_label", F.when(F.col("model_name") == "m", "b"))
    mixed = {r["model_name"]: r["calibration_mode"] for r in relation("c11_frame", log=half).collect()}
    assert mixed == {"m": "true_label", "n": "proxy"}
    bins = relation("c11_bins", log=rows).collect()
    assert [(r["model_name"], r["bin"], r["bin_count"], r["bin_accuracy"]) for r in bins] == [("m", 9, 2, 0.5)]


def test_consensus_risk_from_trust_levels(spark):
    trust = spark.createDataFrame([("a", "Very_High"), ("a", "low"), ("b", "critical"), ("c", "odd"), ("d", None)], "sample_id string, trust_level string")
    assert {r["sample_id"]: r["consensus"] for r in risk_of_trust(trust).collect()} == {"a": pytest.approx(0.425), "b": 0.95, "c": 0.5, "d": 0.5}
    assert relation("r3_consensus", d1_reliability=trust).count() == 4


def test_triggers_of_a_break(spark):
    rows = []
    for s, level, kind, other in [("s", "clean", "clean", "a"), ("s", "mild", "noise", "b"), ("s", "mild", "blur", "a"), ("s", "mild", "hue", "b"), ("t", "clean", "clean", "b"), ("u", "clean", "clean", "a"), ("u", "mild", "blur", "a")]:
        rows += [(s, "m", "a", 0.9, kind, level), (s, "n", other, 0.9, kind, level)]
    got = {r["sample_id"]: (r["collapse_trigger"], r["collapse_severity"], r["consensus_duration"]) for r in relation("d3_breakdown", log=log(spark, rows)).collect()}
    assert got == {"s": ("hue", "mild", 1), "t": ("clean", "clean", 0)}


def test_absent_metrics_count_as_constant(spark):
    records = spark.createDataFrame([("m", "clean", 0.9, 0.1), ("n", "blur", 0.5, 0.3)], "model_name string, perturbation_type string, robustness double, uncertainty double")
    e5 = {r["model_name"]: r["benchmark_score"] for r in relation("e5_model_benchmark", records=records).collect()}
    assert e5 == {"m": 1.0, "n": pytest.approx(5 / 7, abs=1e-6)}
    boards = {r["board"] for r in relation("e5_leaderboards", records=records).collect()}
    assert boards == {"benchmark_score", "robustness", "stability", "reliability", "risk", "uncertainty", "instability", "attention_drift"}
    e6 = {r["perturbation_type"]: r for r in relation("e6_perturbation_benchmark", records=records).collect()}
    assert (e6["blur"]["degradation_impact"], e6["blur"]["collapse_pressure"], e6["blur"]["place"]) == (pytest.approx(0.4), pytest.approx(0.2 / 3, abs=1e-6), 1)
    none = relation("e6_perturbation_benchmark", records=records.filter("perturbation_type = 'blur'")).first()
    assert none["degradation_impact"] == 0  # without a baseline all records are it


def test_registry(spark):
    registry = spark.createDataFrame([("e1", ["a", "b"], ["m"]), ("e2", ["a"], None), ("e3", None, ["m", "n"])], "experiment_id string, enabled_stages array<string>, models array<string>")
    got = {(r["kind"], r["name"]): r["experiments"] for r in relation("e10_registry", registry=registry).collect()}
    assert got == {("stage", "a"): 2, ("stage", "b"): 1, ("model", "m"): 2, ("model", "n"): 1}


def test_high_drift_and_one_sided_classes(spark):
    drift = spark.createDataFrame([("a", 0.7), ("a", 0.65), ("b", 0.64)], "sample_id string, drift double")
    assert [tuple(r) for r in relation("x7_high_drift", x1_drift=drift).collect()] == [("a", 2, 0.7)]
    plates = spark.createDataFrame([("c", "Plate1", 1)] + [("d", f"Plate{i}", i) for i in range(4)], "class_name string, plate_name string, image_id int")
    assert [tuple(r) for r in relation("g4_class_sets", plates=plates).collect()] == [("c", "train")]
