"""Relations by name over given frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators import RELATIONS
from plumbline.operators.frames import Frames


def relation(name: str, **given: DataFrame) -> DataFrame:
    """A relation over the given frames, such as relation("r6_sample_risk", log=predictions)."""
    if name not in RELATIONS:
        raise ValueError(f"no relation {name}")
    return getattr(Frames(**given), name)
