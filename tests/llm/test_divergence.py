"""The source divergence audit against a plain count and sum, and its awkward cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm import divergence
from tests.llm import fixtures


def plain(rows: list[tuple], least: int, top: int) -> set[tuple]:
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())
        shares = {}
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            total = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            others = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(shares[s][t], shares[None][t])) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, found, most in (("pair", others, len(others)), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def test_audit_equals_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 30)  # trees of few rows: results stay
    rows = fixtures.documents()
    for least in (2, 3):
        found = {tuple(r) for r in divergence.audit(fixtures.table(spark, rows, clashing=True), least=least, top=4).collect()}
        assert found == plain(rows, least, 4)


def test_nothing_kept_and_no_documents(spark):
    rows = [(1, "a b", "en", "x", 3), (2, None, "en", "y", None), (3, "ÄÖ", None, None, 2)]
    found = {tuple(r) for r in divergence.audit(fixtures.table(spark, rows)).collect()}
    assert found == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert divergence.audit(fixtures.table(spark, rows).limit(0)).count() == 0


def test_a_tree_equals_all_pairs_of_its_rows():
    rng = np.random.default_rng(5)
    rows = sorted({tuple((s, int(rng.integers(2, 5))) for s in range(6) if rng.random() < 0.6) for _ in range(200)})
    rows = [r for r in rows if r]
    times = rng.integers(1, 9, len(rows))
    sizes = np.array([len(r) for r in rows])
    flat = np.array([x for r in rows for x in r])
    source, p = divergence._padded(flat[:, 0], sizes, -1), divergence._padded(flat[:, 1] * 1000, sizes, 1)
    zero = np.where(source >= 0, source + 3, 1)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = Counter()
    for r, m in zip(rows, times):
        for k, (j, b) in enumerate(r):
            for i, a in r[:k]:
                want[i, j] += int(m) * (f(a * 1000, b * 1000) - f(a * 1000, j + 3) - f(i + 3, b * 1000) + f(i + 3, j + 3))
    i, j, value = divergence.tree(source, p, zero, times)
    assert {(int(a), int(b)): int(v) for a, b, v in zip(i, j, value)} == dict(want)


def test_occurrences_and_documents_of_terms(spark):
    docs = spark.createDataFrame([("en", "a", "One two, two TWO Ä"), ("en", "a", "two"), (None, None, None), ("en", "b", "1 2 3")], "lang string, source string, text string")
    found = divergence.counted(docs)
    assert {tuple(r) for r in found.collect()} == {("en", "one", "a", 1, 1), ("en", "two", "a", 4, 2), ("en", "Ä", "a", 1, 1)}
    again = divergence.counted(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in again and "inline" not in again  # no struct for each token
