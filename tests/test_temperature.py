"""A temperature for each class: the optimum against a plain search, its bounds, and rows that do not count."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import temperature
from plumbline.operators.evaluation import HIGH, LOW, fitted

SCHEMA = "sample_id int, model_name string, label int, logits array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def loss(z, y, t):
    s = z / np.asarray(t)
    top = s.max(1, keepdims=True)
    return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(y)), y]).mean())


def drawn(n=400, k=3, seed=2):
    """Logits whose true temperatures differ by class."""
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 3, (n, k))
    p = np.exp(z / [0.7, 1.5, 3.0][:k])
    p /= p.sum(1, keepdims=True)
    return z, np.array([rng.choice(k, p=q) for q in p])


def test_optimum(spark):
    z, y = drawn()
    rows = [("m", int(b), a.tolist()) for a, b in zip(z, y)]
    other = [("one", int(b), (a / 2).tolist()) for a, b in zip(z[:100], y[:100])]
    logits = table(spark, rows + other)
    fits = {r["model_name"]: r for r in temperature.fitted_by_class(logits).collect()}
    f = fits["m"]
    assert f["loss"] == pytest.approx(loss(z, y, f["temperatures"]), abs=1e-12)
    scalar = {r["model_name"]: r for r in fitted(logits).collect()}["m"]
    assert f["loss"] <= scalar["loss"] and f["loss_of_one"] == pytest.approx(scalar["loss"])
    best = np.array(f["temperatures"])
    assert best == pytest.approx([0.7, 1.5, 3.0], rel=0.35)
    # No neighbour is better, along the axes, the diagonals, or on a grid around it.
    for step in (1e-3, 1e-2, 0.1):
        for d in np.stack(np.meshgrid(*[[-1, 0, 1]] * 3), -1).reshape(-1, 3):
            assert loss(z, y, best * (1 + step * d)) >= f["loss"] - 1e-12
    assert len(fits["one"]["temperatures"]) == 3 and fits["one"]["loss"] <= fits["one"]["loss_of_one"]


def test_bounds_and_rows_that_do_not_count(spark):
    sure = [("sure", k % 2, [5.0, 0.0] if k % 2 == 0 else [0.0, 5.0]) for k in range(20)]  # always right: as cold as may be
    odd = [("sure", None, [1.0, 2.0]), ("sure", 5, [1.0, 2.0]), ("sure", 0, None), ("sure", 0, [float("nan"), 1.0]), ("sure", 1, [float("inf"), 1.0])]
    ragged = [("ragged", k % 3 if k % 4 else 0, [1.0 + k % 5, 0.5, 0.0][: 3 if k % 3 == 2 else 2 + k % 2]) for k in range(60)]
    ragged = [r for r in ragged if r[1] < len(r[2])]
    fits = {r["model_name"]: r for r in temperature.fitted_by_class(table(spark, sure + odd + ragged)).collect()}
    assert fits["sure"]["temperatures"] == pytest.approx([LOW, LOW], rel=0.05)
    assert all(LOW <= t <= HIGH for t in fits["ragged"]["temperatures"]) and len(fits["ragged"]["temperatures"]) == 3
    one = {r["model_name"]: r["temperature"] for r in fitted(temperature.usable(table(spark, ragged))).collect()}["ragged"]
    assert fits["ragged"]["temperatures"][2] == pytest.approx(one)  # its logits are all 0
    assert temperature.fitted_by_class(table(spark, sure).limit(0)).count() == 0


def test_parts_do_not_matter(spark):
    z, y = drawn(200, seed=5)
    logits = table(spark, [("m", int(b), a.tolist()) for a, b in zip(z, y)])
    one, many = (temperature.fitted_by_class(logits.repartition(n)).first()["temperatures"] for n in (1, 7))
    assert one == pytest.approx(many, abs=1e-7)
