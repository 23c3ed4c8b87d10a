"""Quality rules, URL filters and I-Match against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import imatch, quality, url_filter
from tests.llm.fixtures import documents, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text: str | None) -> tuple:
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rows_with_outliers() -> list[tuple]:
    rows = [(5000 + i, prose(7000 + i, 80 + i % 60), "en", "big", 1) for i in range(120)]
    rows += [(6000 + i, " ".join(w + "%%%" for w in prose(8000 + i, 90).split()), "en", "big", 1) for i in range(4)]
    p = prose(1, 10)
    rows += [(6100, f"{p} {prose(2, 90)} {p} {prose(3, 5)} {p}", "en", "big", 1), (6101, f"{p}\n{p}\n{p}", "en", "big", 1), (6102, "a " * 40, "en", "big", 1)]
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_base_and_verdicts(spark, clashing):
    rows = [*documents(), *rows_with_outliers()]
    got = quality.judge(table(spark, rows, clashing)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        want = base(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[5000 + i] for i in range(120)) and not any(kept[6000 + i] for i in range(4))
    assert quality.judge(table(spark, [])).count() == 0


def test_quality_judges_small_groups(spark):
    odd = lambda i: " ".join(w + "%%%" for w in prose(8000 + i, 90).split())
    rows = [(5000 + i, prose(7000 + i, 80 + i % 60), "en", "big", 1) for i in range(120)]
    # A rare source of a known language, a rare language, and null keys.
    for i, (lang, source) in enumerate([("en", "rare"), ("xx", "big"), (None, None), ("en", None)]):
        rows += [(6000 + 10 * i, odd(i), lang, source, 1), (6001 + 10 * i, prose(9000 + i, 90), lang, source, 1)]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r["distance"] is not None for r in got.values())
    assert all(got[6001 + 10 * i]["kept"] and not got[6000 + 10 * i]["kept"] for i in range(4))
    few = {r["doc_id"]: r["distance"] for r in quality.judge(table(spark, rows[:3])).collect()}
    assert all(d is not None for d in few.values())


def test_minimum_covariance_equals_numpy(spark):
    """The same starts and steps in numpy; a third of the vectors lie apart, so that the start from all of them is drawn aside."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (300, 4)), r.normal(8, 0.2, (100, 4))])
    df = spark.createDataFrame([("en", None, *map(float, v)) for v in x], "lang string, source string, v0 double, v1 double, v2 double, v3 double")
    ridge = np.diag(np.array(list(quality.VECTOR.values())) ** 2)
    eighth = np.array([row[0] for row in df.select(F.pmod(F.xxhash64(*quality.VECTOR), F.lit(8))).collect()])
    m = np.median(x, axis=0)
    begin = [(m, np.diag((np.median(abs(x - m), axis=0) * 1.4826) ** 2)), *((y.mean(axis=0), np.cov(y.T, bias=True)) for y in (x, x[eighth == 0], x[eighth == 1]))]
    found = []
    for m, s in begin:
        for _ in range(quality.STEPS):
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s + ridge), x - m)
            bins = np.floor(np.log(d + 1e-6) * quality.BINS)
            near = x[bins <= np.sort(bins)[int(np.ceil(quality.SUBSET * len(x))) - 1]]
            m, s = near.mean(axis=0), np.cov(near.T, bias=True)
        found.append((np.linalg.slogdet(s + ridge)[1], m, s + ridge))
    assert max(f[0] for f in found) > min(f[0] for f in found) + 0.1
    _, m, s = min(found, key=lambda f: f[0])
    got = quality.estimates(df).first()
    assert np.array([got[f"m_{a}"] for a in quality.VECTOR]) == pytest.approx(m, abs=0.05)
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            low[i, j] = got[f"l_{i}_{j}"]
    assert low @ low.T == pytest.approx(s, abs=0.1)


def test_url_filter_equals_brute_force(spark):
    entries = [("bad.com", 5, True), ("bad.com", 40, False), ("bad.com", 40, True), ("bad.com", 90, False), ("a.bad.com", 95, True), ("a.bad.com", 95, True), ("b.org", 3, False), ("b.org", 60, True), (None, 1, True), ("c.org", None, True)]
    captures = [(i, h, d) for i, (h, d) in enumerate((h, d) for h in ("bad.com", "x.a.bad.com", "notbad.com", "b.org", None, "c.org") for d in (0, 4, 5, 39, 40, 89, 90, 95, 200, None))]
    captures += [captures[5], captures[5]]
    # Extra columns named as the operator's own are ignored.
    held = spark.createDataFrame(captures, "page_id long, host string, day int").withColumns({c: F.lit(7) for c in ("domain", "period", "lane", "since", "until", "listed", "best")})
    got = url_filter.as_of(held, spark.createDataFrame(entries, "domain string, day int, listed boolean")).collect()
    assert len(got) == len(captures)

    def active(name: str, day: int) -> int | None:
        days: dict[int, bool] = {}
        for n, d, on in entries:
            if n == name and d is not None:
                days[d] = days.get(d, False) or on
        past = [d for d in days if d <= day]
        return max(past) if past and days[max(past)] else None

    for r in got:
        parts = (r["host"] or "").split(".")
        names = [".".join(parts[i:]) for i in range(max(1, len(parts) - 1))]
        want = next(((n, s) for n in names if r["host"] and r["day"] is not None and (s := active(n, r["day"])) is not None), (None, None))
        assert (r["domain"], r["since"], r["listed"]) == (*want, want[0] is not None)
    urls = [("http://A.b.com:80/x",), ("https://u@c.org?q",), ("no url",), (None,), ("",), ("http://1.2.3.4:8/x",), ("http://[::1]:80/",), ("http://Example.com./y",), ("http://...",)]
    hosts = spark.createDataFrame(urls, "url string").select(url_filter.host_of(F.col("url")).alias("h")).select("h", url_filter.suffixes(F.col("h")).alias("s")).collect()
    assert [r["h"] for r in hosts] == ["a.b.com", "c.org", None, None, None, "1.2.3.4", "[::1]", "example.com", None]
    assert [r["s"] for r in hosts if r["h"]] == [["a.b.com", "b.com"], ["c.org"], ["1.2.3.4"], ["[::1]"], ["example.com"]]


@pytest.mark.parametrize("size", [7, 4096])
def test_imatch_edits_and_likeness(spark, size):
    rows = sorted(documents(), key=lambda r: (-r[0], [-ord(c) for c in (r[1] or "")]))
    got = imatch.report(table(spark, rows, clashing=size == 7), size=size).collect()
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in rows]
    want = sorted((r[0], len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + texts[(i + 1) % len(rows)][: len(t) // 3]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(rows, texts)))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {}
    for r, t in ((r, dict(zip((x[0] for x in rows), texts))[r["doc_id"]]) for r in got):
        by.setdefault(t, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values())
    long = [r for r in got if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long])
    assert imatch.report(table(spark, [])).count() == 0


def _xx(value: int, seed: int = 42) -> int:
    """Spark's xxhash64 of a long."""
    h = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed)
    return h - 2**64 if h >= 2**63 else h


def test_imatch_fingerprints_equal_brute_force(spark):
    """Lexicon band, sub-lexicons, hashes over sorted terms and likeness, made again in Python."""
    rows = [*documents(), *((3000 + i, prose(50 + i % 7, 30) + f" own{i}", "en", "a", 1) for i in range(40))]
    got = {(r["doc_id"], r["n_chars"]): r for r in imatch.report(table(spark, rows)).collect()}
    terms = lambda t: {int(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)).view(np.int64)) for w in re.findall(r"[^\W_]+", t.lower())}
    texts = [r[1] or "" for r in rows]
    df = Counter(h for t in texts for h in terms(t))
    band = {h for h, n in df.items() if max(imatch.LEAST_COUNT, imatch.LEAST * len(rows)) <= n <= max(imatch.LEAST_COUNT, imatch.MOST * len(rows))}
    slots = {(h >> 5) % imatch.SLOTS for h in band}

    def fingerprint(t: str) -> list:
        every = terms(t)
        used = sorted({h for h in every if (h >> 5) % imatch.SLOTS in slots} or every)
        out = []
        for level, parts in enumerate(imatch.PARTS):
            for k in range(imatch.EACH):
                held = [h for h in used if (h >> imatch.SHIFTS[level]) % parts == k]
                seed = 42
                for h in held:
                    seed = _xx(h, seed % 2**64)
                out.append(seed if held else None)
        return out if any(x is not None for x in out) else None

    digits = lambda fp: ".".join("-" if x is None else f"{x % 2**64:016x}" for x in fp)
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][0], [-ord(c) for c in texts[i]]))
    same = lambda a, b: sum(x is not None and x == y for x, y in zip(a, b)) / sum(x is not None or y is not None for x, y in zip(a, b))
    checked = 0
    for at, i in enumerate(order):
        after = texts[order[(at + 1) % len(order)]]
        t, r = texts[i], got[rows[i][0], len(texts[i])]
        fp, edited, following = (fingerprint(x) for x in (t, t[: len(t) - len(t) // 3] + after[: len(t) // 3], after))
        if fp:
            assert r["fingerprint"] == digits(fp)
        if fp and edited and following and sum(x[0] == rows[i][0] for x in rows) == 1:
            assert r["edited_fingerprint"] == digits(edited)
            assert (r["near_edited"], r["near_next"]) == pytest.approx((same(fp, edited), same(fp, following)))
            checked += 1
    assert checked > 40
