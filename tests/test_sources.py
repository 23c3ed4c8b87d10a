"""Sources: names of columns, files, and the order of corruptions."""

from __future__ import annotations

import json

import pytest

from plumbline.operators.perturbation import CORRUPTIONS
from plumbline.plans import relation
from plumbline.sources import folders, logs, sinks, summaries


@pytest.mark.parametrize(("names", "want"), [
    (("id", "model", "prediction", "score"), ("id", "model", "prediction", "score")),
    (("sample", "id", "classifier", "pred", "conf"), ("id", "classifier", "pred", "conf")),
    (("filename", "image_id", "model_name", "label", "class", "prob", "probability"), ("image_id", "model_name", "label", "probability")),
    ((" Sample_ID ", "id", "MODEL", "Class"), (" Sample_ID ", "MODEL", "Class", None)),
])
def test_aliases_and_their_precedence(spark, names, want):
    raw = spark.createDataFrame([tuple(f"{i}" for i in range(len(names)))], ", ".join(f"`{n}` string" for n in names))
    row = logs.prediction_log(raw).first().asDict()
    got = [row["sample_id"], row["model_name"], row["predicted_class"], row["confidence"]]
    assert got == [None if w is None else (float(names.index(w)) if k == 3 else str(names.index(w))) for k, w in enumerate(want)]


@pytest.mark.parametrize(("kind", "level"), [("pert_type", "intensity"), ("type", "level"), ("augmentation", "pert_severity"), ("transform", "perturbation_severity"), ("Perturbation", "Severity")])
def test_perturbation_aliases(spark, kind, level):
    raw = spark.createDataFrame([("s", "m", "c", " Blur", "MILD ")], f"sample_id string, model_name string, predicted_class string, `{kind}` string, `{level}` string")
    assert tuple(logs.perturbation_log(raw).select("perturbation_type", "severity_level").first()) == ("blur", "mild")


def test_log_from_files(spark, tmp_path):
    (tmp_path / "log.csv").write_text("id,model,pred,conf,type,level\n007,m,a,0.5,Blur,mild\n008,m,b,none,,\n")
    rows = logs.read_log(spark, f"file://{tmp_path}/log.csv", perturbed=True).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["confidence"], r["perturbation_type"], r["severity_level"]) for r in rows] == [("007", 0.5, "blur", "mild"), ("008", None, "unknown", "unknown")]
    (tmp_path / "log.json").write_text('{"id": "1", "model": "m", "class": "a"}\n')
    assert logs.read_log(spark, f"file://{tmp_path}/log.json").first()["predicted_class"] == "a"
    (tmp_path / "bad.csv").write_text("id,pred\n1,a\n")
    with pytest.raises(ValueError, match="model_name"):
        logs.read_log(spark, f"file://{tmp_path}/bad.csv")


def test_order_of_corruptions(spark):
    kinds = [*reversed(CORRUPTIONS), "other"]
    rows = [("s", "m", "a", 0.9, "clean", "clean", "a", "0")] + [("s", "m", "a", 0.5, k, "mild", "a", f"1{k}") for k in kinds]
    log = spark.createDataFrame(rows, "sample_id string, model_name string, predicted_class string, confidence double, perturbation_type string, severity_level string, true_label string, seq string")
    got = relation("b8_flip_rates", log=log).orderBy("type_order").collect()
    assert [r["perturbation_type"] for r in got] == ["original", "bright", "dark", "high_contrast", "low_contrast", "gaussian_noise", "gaussian_blur", "stain_shift", "defocus_blur", "jpeg_compression", "other"]


def test_summaries_of_every_shape(spark, tmp_path):
    shapes = {
        "a": '[{"model_name": "m", "robustness": 1.5}, {"model_name": "n", "benchmark_scope": "own"}, 7]',
        "b": '{"benchmark_records": [{"model_name": "m", "robustness": "x"}], "records": [{"model_name": "no"}]}',
        "c": '{"benchmark_records": {"not": "a list"}, "records": [{"model_name": "r", "instability": 2}]}',
        "d": '{"perturbation_rankings": [{"perturbation_type": "blur", "benchmark_scope": "other"}], "model_rankings": [{"model_name": "m"}, "text"]}',
        "e": '{"stage_summaries": {"robust": {"model_name": "s"}, "named": {"benchmark_scope": "mine"}, "bad": 3}}',
        "f": '{"model_rankings": null, "stage_summaries": {"x": {"model_name": "never"}}}',
        "g": "{not json", "h": '{"something": 1}', "i": "[]",
    }
    for name, text in shapes.items():
        folder = tmp_path / f"experiment_{name}" / "summaries"
        folder.mkdir(parents=True)
        (folder / "experiment_summary.json").write_text(text)
    rows = summaries.gather(summaries.read_summaries(spark, f"file://{tmp_path}")).collect()
    got = sorted((r["path"].split("experiment_")[1][0], r["position"], r["benchmark_scope"], r["model_name"] or r["perturbation_type"], r["robustness"] or r["instability"], r["error"]) for r in rows)
    assert got == [
        ("a", 0, None, "m", 1.5, None), ("a", 1, "own", "n", None, None), ("a", 2, None, None, None, "no record"),
        ("b", 0, None, "m", None, None), ("c", 0, None, "r", 2.0, None),
        ("d", 0, "model", "m", None, None), ("d", 1, "model", None, None, "no record"), ("d", 2, "perturbation", "blur", None, None),
        ("e", 0, "bad", None, None, "no record"), ("e", 1, "mine", None, None, None), ("e", 2, "robust", "s", None, None),
        ("g", -1, None, None, None, "no JSON"), ("h", -1, None, None, None, "no records"),
    ]


def test_folders(spark, tmp_path):
    files = [
        "e.coli on BH/day 1/Plate 1/a.JPG", "e.coli on BH/day 1/Plate 1/b.heic", "e.coli on BH/day 1/Plate 1/notes.txt", "e.coli on BH/plate2/deep/c.png", "e.coli on BH/loose.png",
        "Klebsiella on BH/Plate 1/plate 1b/d.jpeg", "Pseudomonas aeruginosa/Plate McCacConkey 3/e.png", "Pseudomonas aeruginosa/Plate+4/f.png", "unknown/Plate 9/g.png", "Staph On BH/Dish/h.png",
    ]
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    found = folders.discover(folders.listed(spark, f"file://{tmp_path}"), str(tmp_path))
    got = sorted((r["class_name"], r["plate_name"], r["plate_path"], r["image_id"]) for r in found.collect())
    assert got == [
        ("e_coli", "Plate 1", "e.coli on BH/day 1/Plate 1", "a.JPG"), ("e_coli", "Plate 1", "e.coli on BH/day 1/Plate 1", "b.heic"), ("e_coli", "plate2", "e.coli on BH/plate2", "c.png"),
        ("k_pneumoniae", "plate 1b", "Klebsiella on BH/Plate 1/plate 1b", "d.jpeg"), ("p_aeruginosa", "Plate+4", "Pseudomonas aeruginosa/Plate+4", "f.png"),
    ]
    splits = relation("g1_splits", plates=found)
    assert splits.filter("split = 'train'").count() == 3


def test_records_by_key(spark, tmp_path):
    rows = [("k", i, i / 3) for i in range(50)] + [("a|b", 1, None), (None, 2, 0.5)]
    table = spark.createDataFrame(rows, "key string, v int, x double")
    lists = sinks.by_key(table.withColumnRenamed("key", "name"), "name", most=7).collect()
    assert max(r["n"] for r in lists) <= 7 and sum(r["n"] for r in lists) == len(rows)
    k = [x for r in sorted((r for r in lists if r["key"] == "k"), key=lambda r: r["part"]) for x in json.loads(r["records"])]
    assert k == [{"v": i, "x": round(i / 3, 6)} for i in range(50)]
    assert {r["key"]: r["records"] for r in lists if r["key"] != "k"} == {"a|b": '[{"v":1}]', "null": '[{"v":2,"x":0.5}]'}
    sinks.write_by_key(table.withColumnRenamed("key", "name"), f"file://{tmp_path}/out", "name", most=20)
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["key"] for x in lines] == sorted(x["key"] for x in lines) and sum(len(x["records"]) for x in lines) == len(rows)
    assert sinks.by_key(table.limit(0).withColumnRenamed("key", "name"), "name").count() == 0
