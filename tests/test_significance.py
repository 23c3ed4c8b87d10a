"""Seed statistics and tests against published numbers, ties and degenerate pairs."""

from __future__ import annotations

import pytest

from plumbline.functions.significance import _signed_rank
from plumbline.plans import relation

SCHEMA = "model_name string, seed int, robustness double"
# Published scores of four models under five seeds.
SCORES = {
    "efficientnet_b0": [64.44444444444444] * 5,
    "resnet50": [58.88888888888889] * 5,
    "swin_t": [88.46492273896197, 94.33784459063092, 90.94308736263227, 92.81921997648205, 90.41867863447564],
    "convnext_tiny": [87.58837065183161, 91.73273322234198, 55.36932811625235, 91.96340448335411, 96.06023769010936],
}
# T, p, W, p, d and its name against swin_t.
AGAINST_BEST = {
    "convnext_tiny": (0.9367, 0.401929, 4.0, 0.4375, 0.5792, "Medium", "ns"),
    "efficientnet_b0": (26.6662, 1.2e-05, 0.0, 0.0625, 16.8652, "Large", "***"),
    "resnet50": (32.1628, 6e-06, 0.0, 0.0625, 20.3415, "Large", "***"),
}
INTERVALS = {"swin_t": (91.3968, 88.5905, 94.203), "convnext_tiny": (84.5428, 63.9542, 105.1314), "efficientnet_b0": (64.4444, 64.4444, 64.4444), "resnet50": (58.8889, 58.8889, 58.8889)}


def records(spark, scores):
    return spark.createDataFrame([(m, i, float(x)) for m, xs in scores.items() for i, x in enumerate(xs)], SCHEMA)


def by_model(name, table):
    return {r["model_name"]: r for r in relation(name, records=table).collect()}


def test_published_numbers(spark):
    table = records(spark, SCORES)
    found = by_model("e9_significance", table)
    assert set(found) == set(AGAINST_BEST)
    for model, (t, p, w, p_w, d, effect, stars) in AGAINST_BEST.items():
        r = found[model]
        assert (r["t"], r["p_t"], r["wilcoxon"], r["p_wilcoxon"], r["cohens_d"]) == pytest.approx((t, p, w, p_w, d), abs=1e-6)
        assert (r["effect"], r["stars"]) == (effect, stars)
    intervals = by_model("e7_intervals", table)
    for model, want in INTERVALS.items():
        assert tuple(intervals[model])[2:] == pytest.approx(want, abs=1e-6)


def test_degenerate_pairs(spark):
    scores = {"best": [5, 5, 5, 5], "same": [5, 5, 5, 5], "lower": [4, 4, 4, 4], "short": [1]}
    e8, e9 = by_model("e8_against_best", records(spark, scores)), by_model("e9_significance", records(spark, scores))
    assert (e8["same"]["t"], e9["same"]["p_t"], e9["same"]["wilcoxon"], e9["same"]["p_wilcoxon"], e9["same"]["cohens_d"]) == (0, 1, 0, 1, 0)
    assert (e8["lower"]["t"], e9["lower"]["p_t"], e9["lower"]["stars"]) == (float("inf"), 0, "***")
    assert (e8["short"]["t"], e9["short"]["p_t"], e9["short"]["p_wilcoxon"], e9["short"]["effect"]) == (0, 1, 1, "Insufficient data")
    two = by_model("e9_significance", records(spark, {"best": [5, 7], "other": [4, 5]}))["other"]
    assert (two["wilcoxon"], two["p_wilcoxon"]) == (0, 1) and 0 < two["p_t"] < 1


def test_ties_take_the_normal_curve(spark):
    """Differences 1, 1, 2, 3, -1 and 0: ranks 2, 2, 4, 5, 2, so W is 2, and z has the variance of five ranks less that of three ties."""
    best, other = [11, 11, 12, 13, 9, 10], [10, 10, 10, 10, 10, 10]
    r = by_model("e9_significance", records(spark, {"best": best, "other": other}))["other"]
    assert r["wilcoxon"] == 2.0
    import math

    z = (2 - 7.5) / math.sqrt((5 * 6 * 11 - (27 - 3) / 2) / 24)
    assert r["p_wilcoxon"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    assert (_signed_rank(0, 5), _signed_rank(4, 5), _signed_rank(7, 5)) == (0.0625, 0.4375, 1.0)
