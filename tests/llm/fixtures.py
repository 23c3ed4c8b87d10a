"""A small documents table with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named as the operators' own.
EXTRA = {"long": "fp size component_id length anchor node copies row root draw level source_size left h _id _bytes block left_ n least total", "int": "rank piece bucket nth copy _block part range q start lane seen", "string": "key kept of _text _kept pack lost data label", "double": "target drawn score distance rate weight", "array<string>": "words _spans spans terms"}
CLASHING = SCHEMA + "".join(f", {name} {kind}" for kind, names in EXTRA.items() for name in names.split())
_VALUES = {"long": 7, "int": 7, "string": "x", "double": 7.0, "array<string>": ["x"]}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["the", "an", "er", "ion", "lo", "mi", "ta", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def documents() -> list[tuple]:
    long = prose(1, 3000)
    texts = [long, long, long.replace("the", "tha", 1), prose(2, 200), prose(2, 200) + " more", None, "", " \t\n", "a", "a b c", "a b c d", "ÄB äb 💚", prose(3, 60), prose(3, 60).upper(), prose(4, 30) + "\n" + prose(5, 30) + "\n" + prose(4, 30)]
    texts += [prose(100 + i, 40 + i) for i in range(20)]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "b", "a", "ä"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


def table(spark, rows: list[tuple] | None = None, clashing: bool = False):
    rows = documents() if rows is None else rows
    extra = tuple(_VALUES[kind] for kind, names in EXTRA.items() for _ in names.split())
    return spark.createDataFrame([(*r, *extra) for r in rows], CLASHING) if clashing else spark.createDataFrame(rows, SCHEMA)
