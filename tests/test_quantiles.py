"""Medians by bins against a sorted list."""

from __future__ import annotations

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.functions.quantiles import medians

VALUES = st.one_of(st.sampled_from([0.0, 1.0, -1.0, 1e-300, 1e300, -1.7e308, 1.7e308, 0.1]), st.floats(-10, 10), st.just(None), st.just(float("nan")))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), VALUES), max_size=60))
def test_equals_sorting(spark, rows):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, x double")
    got = {r["k"]: r["median"] for r in medians(table, ["k"], "x", bins=4).collect()}
    held = {}
    for k, x in rows:
        if x is not None and x == x:
            held.setdefault(k, []).append(x)
    assert set(got) == set(held)
    for k, xs in held.items():
        low, high = statistics.median_low(xs), statistics.median_high(xs)
        assert got[k] == pytest.approx(low / 2 + high / 2, rel=1e-9, abs=1e-300) or abs(low + high) == float("inf")


def test_hot_key_and_no_keys(spark):
    table = spark.range(100_001).selectExpr("id % 3 = 0 AS hot", "IF(id % 2 = 0, 0.5, id / 7.0D) AS x")
    want = sorted(0.5 if i % 2 == 0 else i / 7 for i in range(100_001))
    assert medians(table, [], "x").first()["median"] == want[50_000]
    assert medians(table.limit(0), [], "x").count() == 0
