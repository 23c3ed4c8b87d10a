"""Signals of samples: one dealing of the log for each side, and the same risks by columns as by rows of components."""

from __future__ import annotations

import re

import pytest
from tests.test_audit import agreement_rows, frame, perturbed_rows

from plumbline.operators.frames import Frames
from plumbline.plans import relation


def dealings(df) -> int:
    """Shuffles by sample that a plan makes, those of kept tables among them."""
    return len(re.findall(r"Exchange hashpartitioning\(sample_id", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name, most", [("walks", 1), ("clean_samples", 1), ("sample_signals", 2), ("r6_sample_risk", 4), ("r4_fragility", 9), ("d10_trust", 2)])
def test_the_log_is_dealt_once_for_each_side(spark, name, most):
    log = frame(spark, agreement_rows() + perturbed_rows())
    assert 1 <= dealings(relation(name, log=log)) <= most
    assert "collect_set" not in relation("walks", log=log)._jdf.queryExecution().executedPlan().toString()


def test_risks_by_columns_equal_those_by_rows(spark):
    rows = agreement_rows() + perturbed_rows() + [("s9", "m1", None, None, "clean", "clean"), ("s8", "m1", "a", 0.4, "blur", "mild"), ("s8", "m2", "b", None, "blur", "mild"), (None, "m1", "a", 0.5, "clean", "clean")]
    log = frame(spark, rows)
    plain = Frames(log=log)
    given = Frames(log=log, breakdowns=Frames(log=log).breakdowns)  # a given relation has to be read as rows
    by = lambda r: {x["sample_id"]: x for x in r.r6_sample_risk.collect()}
    assert given.gives("breakdowns") and not plain.gives("breakdowns") and len(by(plain)) == 5
    assert by(plain) == by(given)
    trust = Frames(log=log, d7_false_consensus=Frames(log=log).d7_false_consensus)
    assert {tuple(x) for x in plain.d10_trust.collect()} == {tuple(x) for x in trust.d10_trust.collect()}


def test_collapses_from_one_pass_over_the_vectors(spark):
    rows = [("s", "m", "a", 0.9, "blur", "low"), ("s", "m", "a", 0.95, "clean", "clean"), ("s", "m", "a", 0.74, "hue", "low"), ("s", "m", "a", 0.6, "blur", "high"), ("t", "m", "a", 0.9, "blur", "low"), ("t", "m", "a", 0.2, "blur", "odd")]
    found = relation("u5_collapses", log=frame(spark, rows))
    got = {r["sample_id"]: (r["collapse_trigger"], r["collapse_severity"], r["confidence_drop"]) for r in found.collect()}
    assert got == {"s": ("hue", "low", 0.21), "t": ("blur", "odd", 0.7)}
    again = relation("u5_collapses", log=frame(spark, rows))  # not run yet, so that its plan is there once
    assert dealings(again) == 1 and "MergeJoin" not in again._jdf.queryExecution().executedPlan().toString()
