"""The registered queries of the audit operators: every relation whose name starts with an operator's id, and their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import RELATIONS
from plumbline.plans.derived import frames

NAMES = [n for n in RELATIONS if re.match(r"[a-z]\d+_", n)]


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(frames(spark, sf_dir), name)

    run.__name__ = name
    return run


def sections(path: Path = Path(__file__).with_name("oracle.sql")) -> dict[str, str]:
    """The parts of the SQL file by name."""
    parts = re.split(r"^-- name: (\w+)\n", path.read_text(), flags=re.M)[1:]
    return {name: text.strip() for name, text in zip(parts[::2], parts[1::2])}


def statement(name: str, held: dict[str, str]) -> str:
    """One statement: WITH all parts that a part needs, each once."""
    order: list[str] = []

    def visit(n: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z]\w*)", held[n])):
            if word != n and word in held and word not in order:
                visit(word)
        if n not in order:
            order.append(n)

    visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{held[n]}\n)" for n in order) + f"\nSELECT * FROM {name}"


QUERIES = {n: query(n) for n in NAMES}
_HELD = sections()
ORACLE = {n: statement(n, _HELD) for n in NAMES if n in _HELD}
