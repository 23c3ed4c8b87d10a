"""Severity ranks and threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity ladders, the canonical order of corruptions, and the cut-offs of the labels.
DISAGREEMENT_LADDER = {
    0: ("clean", "none", "original"),
    1: ("mild", "low", "light"),
    2: ("moderate", "medium", "mid"),
    3: ("severe", "high", "heavy"),
    4: ("extreme", "very_high", "critical"),
}
UNCERTAINTY_LADDER = {0: ("clean", "none", "original", "baseline"), 1: ("very_low",), 2: ("low",), 3: ("moderate",), 4: ("high",), 5: ("critical",)}
RISK_TREND_LADDER = {0: ("clean", "none", "original"), 1: ("low",), 2: ("moderate",), 3: ("high",), 4: ("critical",)}
BENCHMARK_LADDER = {0: ("mild",), 1: ("moderate",), 2: ("severe",)}
UNKNOWN_RANK = 99
TRUST = ((0.85, "very_high"), (0.70, "high"), (0.45, "moderate"), (0.25, "low"), (None, "critical"))
RISK = ((0.80, "critical"), (0.60, "high"), (0.35, "moderate"), (0.15, "low"), (None, "minimal"))
SHAPE = ((0.75, "peaked"), (0.5, "balanced"), (None, "flat"))
ROBUSTNESS = ((90, "Excellent robustness"), (80, "Good robustness"), (70, "Moderate robustness"), (60, "Fair robustness"), (None, "Poor robustness"))
CALIBRATION_ERROR = ((0.10, "Severe overconfidence — model predictions are unreliable"), (0.05, "Moderate overconfidence — consider temperature scaling"), (0.02, "Acceptable calibration"), (None, "Well-calibrated"))
STABILISER = ((0.7, "stabiliser"), (0.3, "neutral"), (None, "destabiliser"))
EFFECT = ((0.8, "Large"), (0.5, "Medium"), (0.2, "Small"), (None, "Negligible"))
FEW = "Insufficient data"


def rank(column: str | Column, ladder: dict[int, tuple[str, ...]] = DISAGREEMENT_LADDER) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(UNKNOWN_RANK)
    for k, names in ladder.items():
        out = F.when(c.isin(*names), F.lit(k)).otherwise(out)
    return out


def is_clean(column: str = "severity_level", ladder: dict[int, tuple[str, ...]] = DISAGREEMENT_LADDER) -> Column:
    return F.col(column).isin(*ladder[0])


def label(value: Column, steps: tuple) -> Column:
    """The name of the first step whose least value is reached."""
    out = F.lit(steps[-1][1])
    for least, name in reversed(steps[:-1]):
        out = F.when(value >= float(least), F.lit(name)).otherwise(out)
    return out
