"""Literal expectations on small prediction logs, and invariance to the order and number of partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.plans import relation
from plumbline.plans.registry import NAMES, ORACLE, QUERIES
from plumbline.sources import logs, sinks

SCHEMA = "sample_id string, model_name string, predicted_class string, confidence double, perturbation_type string, severity_level string, true_label string, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], *(r[4:6] or ("clean", "clean")), "x", f"{i:06d}") for i, r in enumerate(rows)], SCHEMA)


def agreement_rows():
    table = {"s001": ("a", 0.95, "a", 0.91), "s002": ("e", 0.88, "e", 0.84), "s003": ("p", 0.92, "k", 0.88), "s004": ("a", 0.99, "a", 0.97)}
    return [r for s, (c, p, d, q) in table.items() for r in ((s, "m1", c, p, "clean", "clean"), (s, "m2", d, q, "clean", "clean"))]


def perturbed_rows():
    """Two models, three samples, three types by three severities: s002 breaks under noise, s003 always disagrees."""
    rows = []
    for s, one, two in (("s001", "a", "a"), ("s002", "e", "e"), ("s003", "p", "a")):
        for kind, level in [("clean", "clean"), *((k, v) for k in ("blur", "noise", "bright") for v in ("mild", "moderate", "severe"))]:
            other = {"moderate": "p", "severe": "k"}.get(level, two) if s == "s002" and kind == "noise" else two
            rows += [(s, "m1", one, 0.9, kind, level), (s, "m2", other, 0.8, kind, level)]
    return rows


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_agreement(spark):
    log = frame(spark, agreement_rows())
    a1 = rows_of(relation("a1_agreement_matrix", log=log), "model_a", "model_b")
    assert a1["m1", "m2"]["agreement_pct"] == a1["m2", "m1"]["agreement_pct"] == 75.0 and a1["m1", "m1"]["agreement_pct"] == 100.0
    a2 = relation("a2_disagreement_statistics", log=log).first()
    assert (a2["total_samples"], a2["agreement_count"], a2["disagreement_count"], a2["agreement_rate"], a2["n_models"]) == (4, 3, 1, 0.75, 2)
    assert [r["sample_id"] for r in relation("a3_disagreements", log=log).collect()] == ["s003", "s003"]
    a6 = rows_of(relation("a6_confidence_gaps", log=log), "sample_id")
    assert a6["s003",]["confidence_gap"] == pytest.approx(0.04)
    a7 = relation("a7_spread_summary", log=log).first()
    assert (a7["pairs"], a7["agree_pairs"], a7["disagree_pairs"]) == (4, 3, 1)


@pytest.mark.parametrize("one, two, p, q, want", [("a", "a", 0.9, 0.88, "low"), ("a", "b", 0.4, 0.35, "moderate"), ("a", "b", 0.65, 0.7, "high"), ("a", "b", 0.95, 0.92, "critical"), ("a", "b", 0.3, 0.7, "moderate"), ("a", "b", 0.5, 0.5, "high"), ("a", "b", 0.8, 0.8, "critical")])
def test_severity_boundaries(spark, one, two, p, q, want):
    log = frame(spark, [("s", "m1", one, p, "clean", "clean"), ("s", "m2", two, q, "clean", "clean")])
    assert relation("p9_scored_pairs", log=log).first()["severity"] == want


def test_perturbation(spark):
    log = frame(spark, perturbed_rows())
    j4 = relation("j4_induced_disagreements", log=log).select("sample_id", "perturbation_type").distinct().collect()
    assert [tuple(r) for r in j4] == [("s002", "noise")]
    b2 = rows_of(relation("b2_severity_rates", log=log), "severity_level")
    assert [round(b2[v,]["disagreement_rate"], 3) for v in ("clean", "mild", "moderate", "severe")] == [0.333, 0.333, 0.667, 0.667]
    b3 = rows_of(relation("b3_stability", log=log), "sample_id", "severity_level")
    assert [b3["s002", v]["collapse_severity"] for v in ("clean", "mild", "moderate", "severe")] == [None, None, "moderate", "moderate"]
    assert not any(r["stability_breakpoint"] for k, r in b3.items() if k[0] == "s001")
    b4 = rows_of(relation("b4_model_instability", log=log), "model_name")
    assert (b4["m2",]["flips"], b4["m2",]["perturbed"]) == (2, 27) and b4["m2",]["instability_score"] > b4["m1",]["instability_score"] == 0
    b1 = relation("b1_sensitivity", log=log).orderBy(F.desc("disagreement_rate")).first()
    assert b1["perturbation_type"] == "noise"
    assert rows_of(relation("b5_sample_instability", log=log), "sample_id")["s001",]["instability_score"] == 0


@pytest.mark.parametrize("name", ["r6_sample_risk", "d10_trust", "b3_stability", "c4_robustness"])
def test_order_does_not_matter(spark, name):
    log = frame(spark, perturbed_rows())
    want = sorted(map(str, relation(name, log=log).collect()))
    for n in (1, 7):
        assert sorted(map(str, relation(name, log=log.orderBy(F.rand(n)).repartition(n)).collect())) == want


def test_empty_log(spark):
    log = frame(spark, agreement_rows()).limit(0)
    for name in ("a1_agreement_matrix", "a6_confidence_gaps", "b5_sample_instability", "d10_trust", "r6_sample_risk"):
        assert relation(name, log=log).count() == 0


def test_sources_and_sinks(spark):
    raw = spark.createDataFrame([("1", "m", "a", "0.5", " Blur "), ("2", "m", None, "x", None)], "id string, model string, prediction string, score string, perturbation string")
    log = logs.perturbation_log(raw).collect()
    assert [(r["sample_id"], r["predicted_class"], r["confidence"], r["perturbation_type"], r["severity_level"]) for r in log] == [("1", "a", 0.5, "blur", "unknown"), ("2", "nan", None, "unknown", "unknown")]
    with pytest.raises(ValueError):
        logs.prediction_log(raw.drop("model"))
    nested = spark.sql("SELECT map('m', map('blur', array(named_struct('prediction', 'a', 'confidence', 0.5D, 'error', CAST(NULL AS STRING)), named_struct('prediction', 'b', 'confidence', 0.4D, 'error', 'bad')))) AS results")
    assert [tuple(r)[:4] for r in logs.flatten(nested).collect()] == [("sample_0000", "m", "blur", "a")]
    flat = sinks.flat_rows(spark.createDataFrame([(1.5, ["a", "b"])], "x double, y array<string>")).first()
    assert tuple(flat) == ("1.500000", "a|b")
    assert sinks.long_metrics(spark.createDataFrame([("m", 1.0, 2.0)], "model string, a double, b double"), "s", ["model"], ["a", "b"]).count() == 2


def test_names_cover_the_inventory():
    assert {n.split("_")[0] for n in NAMES} >= {f"a{i}" for i in range(1, 11)} | {f"b{i}" for i in range(1, 11)} | {f"d{i}" for i in range(1, 12)}


def test_risk_uses_the_rank_of_the_collapse(spark):
    """Fragility of a ladder: 0.6 changes / steps + 0.4 (1 - (rank of the break - 1) / greatest rank of the sample)."""
    rows = []
    for level, other in (("clean", "a"), ("mild", "a"), ("moderate", "b"), ("severe", "a")):
        rows += [("s", "m1", "a", 0.9, "blur", level), ("s", "m2", other, 0.9, "blur", level)]
    log = frame(spark, rows)
    assert relation("r4_fragility", log=log).first()["fragility"] == pytest.approx(0.6 * 2 / 3 + 0.4 * (1 - 1 / 3))


def test_robustness_is_over_all_rows(spark):
    log = frame(spark, [("s", "m", "a", 0.9, "clean", "clean"), ("s", "m", "a", 0.5, "blur", "mild"), ("s", "m", "a", 0.7, "blur", "severe")])
    c2 = relation("c2_stability", log=log).first()
    assert (c2["original_confidence"], c2["mean_confidence"], c2["confidence_drop"], c2["most_damaging"]) == (0.9, 0.7, 0.4, "blur")
    c4 = relation("c4_robustness", log=log).first()
    assert c4["stability"] == pytest.approx(100 * (1 - 2.5 * (0.08 / 3) ** 0.5), abs=1e-5)
    unknown = relation("c4_robustness", log=log.withColumn("true_label", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.985))).first()
    assert unknown["calibration"] == pytest.approx(100 - 0.015 / 0.03 * 30)


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (4, (2, 1, 1)), (15, (10, 2, 3)), (30, (21, 4, 5)), (200, (140, 30, 30))])
def test_split_sizes(spark, n, want):
    plates = spark.createDataFrame([("c", f"Plate{i}", i) for i in range(n)] + [("c", "McCacConkey1", -1)], "class_name string, plate_name string, image_id int")
    got = {r["split"]: r["count"] for r in relation("g1_splits", plates=plates).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_significance_equals_published_numbers(spark):
    """Scores of four models under five seeds with known tests against the best."""
    from plumbline.functions.significance import _quantile, _signed_rank, _tail

    assert _quantile(4) == pytest.approx(2.7764451052, abs=1e-8)
    assert (_signed_rank(0, 5), _signed_rank(4, 5)) == (0.0625, 0.4375)
    scores = {"best": (91, 92, 93, 90, 94), "other": (80, 85, 88, 91, 79)}
    records = spark.createDataFrame([(m, i, float(x)) for m, xs in scores.items() for i, x in enumerate(xs)], "model_name string, seed int, robustness double")
    e9 = relation("e9_significance", records=records).first()
    d = [b - o for b, o in zip(scores["best"], scores["other"])]
    mean = sum(d) / 5
    assert e9["t"] == pytest.approx(mean / (sum((x - mean) ** 2 for x in d) / 4 / 5) ** 0.5, abs=1e-4) and e9["wilcoxon"] == 1.0 and e9["p_wilcoxon"] == 0.125 and e9["effect"] == "Large"


def test_temperature(spark):
    logits = spark.createDataFrame([(i, "m", i % 2 if i % 5 else 1 - i % 2, [3.0, 0.0] if i % 2 == 0 else [0.0, 3.0]) for i in range(50)], "sample_id int, model_name string, label int, logits array<double>")
    t = relation("c12_temperature", logits=logits).first()["temperature"]
    assert t == pytest.approx(3 / 1.3862943611, abs=0.01)  # the share of right answers is 0.8, so ln 4 = 3 / T
    p4 = relation("p4_predictions", logits=logits).first()
    assert p4["confidence"] == pytest.approx(0.8, abs=1e-3) and p4["raw_confidence"] == pytest.approx(0.952574)
    wrong = spark.createDataFrame([("m", 0.0)], "model_name string, temperature double")
    with pytest.raises(Exception, match="above 0"):
        relation("p4_predictions", logits=logits, temperatures=wrong).collect()


def test_attention_cases(spark):
    """Equal maps, a moved peak, a flat map, another size, no numbers, unequal rows."""
    peak = lambda i, j, h=4, w=4: [[1.0 if (y, x) == (i, j) else 0.0 for x in range(w)] for y in range(h)]
    cases = {"same": peak(0, 0), "moved": peak(3, 3), "flat": [[0.5] * 4] * 4, "small": peak(0, 0, 2, 2), "nan": [[float("nan")] * 4] * 4, "ragged": [[1.0], [1.0, 2.0]]}
    rows = [(k, "m", level, kind, "c", peak(0, 0) if level == "clean" else v) for k, v in cases.items() for level, kind in (("clean", "clean"), ("low", "blur"))]
    maps = spark.createDataFrame(rows, "sample_id string, model_name string, severity_level string, perturbation_type string, predicted_class string, attention_map array<array<double>>")
    x1 = rows_of(relation("x1_drift", attention=maps), "sample_id")
    assert (x1["same",]["drift"], x1["same",]["overlap"], x1["same",]["collapsed"]) == (0.0, 1.0, False)
    assert (x1["moved",]["displacement"], x1["moved",]["overlap"], x1["moved",]["collapsed"]) == (1.0, 0.0, True)
    assert (x1["flat",]["entropy_shift"], x1["nan",]["entropy_shift"]) == (1.0, 1.0) and ("ragged",) not in x1 and x1["small",]["overlap"] == 0.25
    p13 = rows_of(relation("p13_features", attention=maps).filter("severity_level = 'low'"), "sample_id")
    assert (p13["flat",]["entropy"], p13["flat",]["center_x"], p13["ragged",]["status"]) == (1.0, 0.5, "invalid")


def test_every_query_has_its_own_sql():
    assert set(QUERIES) - set(ORACLE) == {"p14_corruptions", "f1_scored", "f1_robustness", "f1_against_clean"}  # noise and JPEG
    assert len(QUERIES) >= 150
