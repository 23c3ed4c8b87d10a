"""Language identification, toxicity and language-model scoring: exact parts against brute force, the rest by held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import language_id, language_model, toxicity
from tests.llm.fixtures import documents, table

SYLLABLES = {"x": ["ka", "ru", "mo", "ti"], "y": ["schl", "eng", "ich", "ür"], "z": ["ção", "lhe", "nos", "aqui"]}


def spoken(n: int = 300) -> list[tuple]:
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3]
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40)))
        rows.append((i, text, lang, "s", len(text)))
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_language_of_held_out_rows(spark, clashing):
    rows = [*spoken(), (900, None, "x", "s", 0), (901, "12 ??", None, "s", 1), (902, "", "y", "s", 0), (903, "karumo", None, None, 0)]
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, rows, clashing)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] for r in held)
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "x"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_no_rows(spark):
    assert language_id.identify(table(spark, [])).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(table(spark, [(1, "abc", None, None, 3)])).collect()] == ["und"]


def test_language_of_few_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 2000)
    few = [(i, (t + " ") * 400, lang, "s", 1) for i, (t, lang) in zip((1, 2, 3, 5, 6, 7), (("wuga bexo", "long"), ("piq zhod", "far")) * 3)]
    few = [r for r in few if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    docs = table(spark, [*few, *((1000 + r[0], *r[1:]) for r in spoken())])
    assert sorted(language_id.fit(docs).models.languages) == sorted({r[2] for r in few} | {"x", "y", "z"})
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert all(got[r[0]] == r[2] for r in few) and len(few) > 1


def test_kneser_ney_probabilities_add_up():
    models = language_id.Models({"x": [("abab", 2), ("abc", 1), ("bca", 3)], "y": [("ccc", 1)]})
    for start in ("", "a", "ab", "bca"):
        # The bits of a word's last edge and of each next letter, from the differences between words and their prefixes.
        total = 0.0
        for nxt in "abc":
            hashes, of, counted = language_id.grams([start + nxt])
            bits = _bits(models, start + nxt)[len(start) + 1]
            total += 2 ** -bits
        total += 2 ** -_bits(models, start)[len(start) + 1]
        assert (total <= 1 + 1e-5).all() and (total > 0.5).all()


def _bits(models, word):
    """Bits of each character of a word and of its closing edge, for each language."""
    hashes, of, counted = language_id.grams([word])
    p = np.full((len(of), len(models.languages)), models.floor)
    rest = np.broadcast_to(models.start, p.shape)
    for k in range(language_id.ORDER):
        at = np.minimum(np.searchsorted(models.keys[k], hashes[k]), len(models.keys[k]) - 1)
        known = (models.keys[k][at] == hashes[k])[:, None]
        own, after = models.own[k].dense(at, known[:, 0], p.shape[1], 0), models.rest[k].dense(at, known[:, 0], p.shape[1], 1)
        p = np.where(hashes[k][:, None] > 0, own + rest * p, p)
        rest = np.concatenate([np.ones((1, p.shape[1])), after[:-1]])
    return -np.log2(p)


def marked(n: int = 240) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(2)
    common = ["".join(r.choice(["ta", "lo", "mi", "ren", "sa"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(5, 120))]
        bad = i % 3 == 0
        for _ in range(2 * bad):
            words.insert(r.randint(0, len(words)), r.choice(["zgrump", "Vrokk!", "qaxxel" + r.choice(["ta", "lo"])]))
        docs.append((i, " ".join(words), None, None, 0))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.mark.parametrize("clashing", [False, True])
def test_toxicity_of_held_out_rows(spark, clashing):
    docs, labels = marked()
    docs += [(900, None, None, None, 0), (901, "", None, None, 0)]
    table_of_labels = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, docs, clashing), table_of_labels).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == t for i, _, t in held]) > 0.9
    assert got[900]["score"] == got[901]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(table(spark, docs, clashing), table_of_labels)
    assert kept.columns == table(spark, docs, clashing).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}
    assert toxicity.score(table(spark, []), table_of_labels).count() == 0
    assert {r["score"] for r in toxicity.score(table(spark, docs), table_of_labels.limit(0)).collect()} == {0.0}


def test_gradients_of_the_network():
    texts = [b"alpha beta gamma delta", b"beta zgrump"]
    x = toxicity.Inputs(texts)
    net = toxicity.Net(np.zeros(toxicity.ODDS, np.float32), np.zeros(toxicity.ODDS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, w = x.windows()
    v = net.inputs(x).astype(np.float64)
    logit, kept = net.forward(v, w, keep=True)
    grads = net.backward(x, v, w, kept, np.ones(len(w)))
    for name in ("u0", "u1", "wx", "wa", "va", "wo", "b", "ba"):
        at = tuple(np.array(net.p[name].shape) // 2)
        step = 1e-3
        net.p[name][at] += step
        up = net.forward(v, w).sum(dtype=np.float64)
        net.p[name][at] -= 2 * step
        down = net.forward(v, w).sum(dtype=np.float64)
        net.p[name][at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=5e-2)


@pytest.mark.parametrize("clashing", [False, True])
def test_language_model_counts_and_scores(spark, monkeypatch, clashing):
    rows = [*documents(), *((2000 + i, "one two three one two three four", None, None, 1) for i in range(4000))]
    monkeypatch.setattr(language_model, "HEAD", 50)  # so that the tail counts too
    got = language_model.score(table(spark, rows, clashing).coalesce(1)).collect()
    words = {}
    c = Counter()
    for i, text, *_ in rows:
        words[i] = [*(text or "").encode().lower().split(), b""]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(words[i])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[t] > 0 for t in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), abs=1e-6)
        assert r["score"] < 0
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 2000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(table(spark, [])).count() == 0


def test_log_bilinear_probabilities_add_up():
    p = np.random.default_rng(0).dirichlet(np.ones(20))
    net = language_model.Bilinear(p)
    net.r[:] = np.random.default_rng(1).standard_normal(net.r.shape)
    one = np.repeat([3, 5], 20)
    total = 10 ** net.log10(one, one[::-1].copy(), np.tile(np.arange(20), 2))
    assert total[:20].sum() == pytest.approx(1, abs=1e-5) and total[20:].sum() == pytest.approx(1, abs=1e-5)
    assert 10 ** language_model.Bilinear(p).log10(np.zeros(20, int), np.zeros(20, int), np.arange(20)) == pytest.approx(p, abs=1e-5)


def test_language_model_predicts_640_tokens_on_their_own():
    head = [(b"t%d" % i, 2000 - i) for i in range(1000)]
    v = language_model.Vocabulary(head, np.ones(language_model.BUCKETS), 1, 1000)
    assert v.classes[:640].tolist() == list(range(640)) and (v.share[:640] == 0).all()
    assert len(v.p) == 640 + 128 and language_model.Bilinear(v.p).q.shape == (768, 16)
