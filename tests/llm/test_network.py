"""The toxicity network's logits against a plain loop over windows, words and units."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

from plumbline.llm import toxicity


def plain_logit(p, vectors):
    """One window: its words' vectors in order."""
    h = toxicity.UNITS
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    states = [[0.0] * (2 * h) for _ in vectors]
    for side, u, order in ((0, p["u0"], range(len(vectors))), (1, p["u1"], reversed(range(len(vectors))))):
        s = [0.0] * h
        for t in order:
            a = [sum(x * p["wx"][i, side * 3 * h + j] for i, x in enumerate(vectors[t])) + p["b"][side * 3 * h + j] for j in range(3 * h)]
            b = [sum(s[i] * u[i, j] for i in range(h)) for j in range(3 * h)]
            z, r = [[sigmoid(a[k * h + j] + b[k * h + j]) for j in range(h)] for k in (0, 1)]
            c = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
            s = [(1 - z[j]) * c[j] + z[j] * s[j] for j in range(h)]
            states[t][side * h : (side + 1) * h] = s
    m = [[*s, *v] for s, v in zip(states, vectors)]
    e = []
    for row in m:
        k = [math.tanh(sum(x * p["wa"][i, j] for i, x in enumerate(row)) + p["ba"][j]) for j in range(8)]
        e.append(sum(k[j] * p["va"][j, 0] for j in range(8)))
    top = max(e)
    weight = [math.exp(x - top) for x in e]
    pooled = [sum(w * row[i] for w, row in zip(weight, m)) / sum(weight) for i in range(len(m[0]))]
    return sum(x * p["wo"][i, 0] for i, x in enumerate(pooled)) + p["bo"][0]


def test_forward_equals_a_plain_loop():
    texts = [b"one two three", b"alone", b" ".join(b"w%d" % (i % 7) for i in range(toxicity.WINDOW + 9)), b"", "ä ö one two".encode()]
    rng = np.random.default_rng(2)
    net = toxicity.Net(rng.normal(0, 1, toxicity.ODDS).astype(np.float32), rng.normal(0, 1, toxicity.ODDS).astype(np.float32), seed=3)
    net.p["b"] += rng.normal(0, 0.3, net.p["b"].shape).astype(np.float32)
    net.p["ba"] += rng.normal(0, 0.3, 8).astype(np.float32)
    net.p["bo"] += np.float32(0.2)
    x = toxicity.Inputs(texts)
    text, w = x.windows()
    v = net.inputs(x)
    found = net.forward(v, w)
    p = {k: a.astype(np.float64) for k, a in net.p.items()}
    want = [plain_logit(p, [v[i].astype(np.float64).tolist() for i in row if i >= 0]) for row in w]
    assert found == pytest.approx(want, rel=1e-3, abs=2e-3)
    assert len(set(text)) == 4 and (text == 2).sum() >= 2
    tops = net.tops(x)
    for i in range(len(texts)):
        assert tops[i] == pytest.approx(max([-4.0, *(z for t, z in zip(text, want) if t == i)]), abs=2e-3)


def test_the_driver_does_not_train(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 3} text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: (os.getpid(), len(texts)))
    where, n = toxicity.fit(docs, labels)
    assert where != os.getpid() and 20 < n <= 40
    monkeypatch.undo()
    assert toxicity.fit(docs, labels.limit(0)) is None
