"""The pipeline's near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import simhash
from tests.llm.fixtures import documents, prose, table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _shingles(text: str | None) -> frozenset:
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _components(rows: list[tuple]) -> dict[int, int]:
    of = {r[0]: _shingles(r[1]) for r in rows}
    root = {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in of:
        for j in of:
            if j < i and (of[i] == of[j] or 5 * len(of[i] & of[j]) >= 4 * len(of[i] | of[j]) > 0):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in of}


def edited() -> list[tuple]:
    """Copies with replaced words, at similarities on both sides of the limit; chains of copies of copies; a hub's many copies."""
    r, rows = random.Random(6), []
    for k in range(40):
        words = prose(400 + k, r.randint(40, 300)).split()
        for n in range(3):
            rows.append((3000 + 10 * k + n, " ".join(words), "en", "a", 1))
            for _ in range(max(1, len(words) * r.randint(5, 40) // 1000)):
                words[r.randrange(len(words))] = f"edit{r.random()}"
    words = prose(7, 200).split()
    for k in range(60):
        own = list(words)
        for _ in range(r.randint(1, 5)):
            own[r.randrange(len(own))] = f"edit{r.random()}"
        rows.append((5000 + k, " ".join(own), "en", "a", 1))
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_pipeline_near_duplicates_equal_all_pairs(spark, clashing):
    rows = [*documents(), *edited()]
    want = _components(rows)
    docs = table(spark, rows, clashing)
    if not clashing:
        groups: dict[int, set] = {}
        for r in simhash.similar_groups(docs).collect():
            groups.setdefault(r["root"], set()).add(r["doc_id"])
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, c in want.items() if c == root) for root in set(want.values()))
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    # Of repeated rows one stays.
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert 20 < sum(i != c for i, c in want.items() if 3000 <= i < 5000) < 80


def test_small_cells_find_the_same(spark):
    rows = edited()
    want = _components(rows)
    for cell, sets in ((5, 256), (4096, 3)):
        groups: dict[int, set] = {}
        for r in simhash.similar_groups(table(spark, rows), cell=cell, sets=sets).collect():
            groups.setdefault(r["root"], set()).add(r["doc_id"])
        assert sorted(map(min, groups.values())) == sorted(i for i, c in want.items() if i == c)


def test_rows_are_kept_not_ids(spark):
    """An id that two texts share does not take one with the other; null ids lose to others; repeated rows are one."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b + " more", "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (4, "", None, None, 0), (4, None, None, None, None), (7, c, "en", "s", 1), (7, c, "en", "s", 1)]
    got = sorted((r["doc_id"], r["text"] or "") for r in simhash.keep_one(table(spark, rows)).collect())
    assert got == sorted([(1, a), (2, b), (4, ""), (7, c)])


def test_near_duplicates_of_no_rows(spark):
    docs = table(spark, [])
    assert simhash.similar_groups(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_wide_fingerprint_is_the_majority():
    held = np.random.default_rng(2).integers(0, 2**64, 700, np.uint64)
    h = (held[:, None] ^ simhash._XOR) * simhash._TIMES
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ones = np.unpackbits(h.view(np.uint8).reshape(700, -1), axis=1, bitorder="little").reshape(700, simhash.WIDE, 8, 8).sum(axis=0)  # word, byte, bit
    want = np.packbits((2 * ones.transpose(0, 2, 1) > 700).reshape(simhash.WIDE, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    assert (simhash.wide_fingerprint(held) == want).all() and (simhash.wide_fingerprint(held[:0]) == 0).all()
