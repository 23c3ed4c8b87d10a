from __future__ import annotations

import random
from collections import Counter

import pytest

from plumbline.llm import suffix_dedup
from tests.llm.fixtures import documents, prose, table


def brute(rows: list[tuple], depth: int = 50) -> dict:
    texts = sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: x[0])
    first: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - depth + 1):
            first.setdefault(t[k : k + depth], i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - depth + 1):
            if first[t[k : k + depth]] < i:
                gone[k : k + depth] = b"\1" * depth
        spans = [k for k in range(len(t) + 1) if (gone[k] if k < len(t) else 0) != (gone[k - 1] if k else 0)]
        out.append((i, len(t), list(zip(spans[::2], spans[1::2])), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def shared() -> list[tuple]:
    """Passages of many lengths in many documents, at both ends and within; periodic and doubled texts."""
    r = random.Random(3)
    passages = [prose(500 + i, 30)[: r.choice([49, 50, 51, 60, 75, 120])] for i in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + 10 * i + k, r.randint(0, 15)) for k in range(3)]
        for p in r.sample(passages, 2):
            parts.insert(r.randint(0, len(parts)), p)
        rows.append((1000 + i, " ".join(parts), "en", "s", 1))
    rows += [(2000, "ab" * 200, "en", "s", 1), (2001, "xab" + "ab" * 100, "en", "s", 1), (2002, "é" * 60, "en", "s", 1), (2003, "x" + "é" * 60, "en", "s", 1), (2004, "z" * 50, "en", "s", 1), (2005, "z" * 49, "en", "s", 1), (2006, "z" * 300, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("block", [3000, 1 << 23])
@pytest.mark.parametrize("many", [(64, 16), (1, 1)])
def test_equals_brute_force(spark, block, many):
    rows = [*documents(), *shared()]
    got = suffix_dedup.repeats(table(spark, rows, clashing=block < 9999), block=block, many=many).collect()
    assert sorted((r["doc_id"], r["_bytes"], [tuple(s) for s in r["_spans"]], bytes(r["_kept"])) for r in got) == brute(rows)


@pytest.mark.parametrize("clashing", [False, True])
def test_without_repeats_keeps_columns(spark, clashing):
    # Replacement characters of the text itself stay, also next to a cut.
    rows = [*documents(), *shared(), (2010, "keep \ufffd me " + "w" * 70, "en", "s", 1), (2011, "keep \ufffd this \ufffd" + "w" * 70 + "\ufffdé end", "en", "s", 1), (None, "w" * 80, None, None, None), (None, prose(1, 3000), None, None, None)]
    docs = table(spark, rows, clashing)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    want = Counter()
    whole = [(2**63 - 1 if r[0] is None else r[0], *r[1:]) for r in rows]
    for i, _, s, k in brute(whole):
        want[i, k.decode("utf-8", "ignore")] += 1
    got = out.collect()
    assert Counter((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got) == want
    assert sum(r["text"] is None for r in got) == sum(r[1] is None for r in rows)
    assert any("\ufffd" in (r["text"] or "") and r["doc_id"] == 2011 and "w" not in r["text"] for r in got)
    assert suffix_dedup.repeats(table(spark, [])).count() == 0
