"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs: each word of a window has word features (a learned vector by word hash, and the log-odds of the
word among the labels) and character features (the mean of learned vectors of its byte n-grams, and the
largest and mean log-odds of its n-grams). Two gated recurrent layers read the window forwards and
backwards; attention pools states and inputs into one vector and a logit. Windows overlap by half and
together hold every word of a text; the document's score is a logistic calibration of its largest logit.

The network learns from a bounded sample of the labelled rows: about SAMPLE documents of each class, drawn by
a hash of the id from all labelled rows outside the held-out remainder, and of these, in the order of the hash,
the first SAMPLE_BYTES of text, the last text cut. Spark applies both bounds before anything is read. Training
takes place on that sample, in one task and not on the driver; scoring is one narrow pass over all texts.

Null and empty texts get the calibrated score of a text without windows. Labels that contradict each other
count as toxic; null labels do not count. Without a labelled row of both classes every score is 0.
Repeated rows get equal scores. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import remainder, small_batches, text_bytes

#: Bounds of the training sample for each class.
SAMPLE, SAMPLE_BYTES = 1500, 6_000_000
#: Words of a window and from one window to the next; units of each direction; learned dimensions and table sizes.
WINDOW, STRIDE, UNITS, DIMS, SLOTS, ODDS = 16, 8, 8, 4, 1 << 12, 1 << 18
#: Lengths in bytes of the n-grams, with the word's edges marked.
GRAMS = (5, 8)
#: Training: rounds of mining and epochs of each, rate of Adam, documents of a scoring batch.
ROUNDS, EPOCHS, RATE, BATCH = 2, 5, 0.01, 64


def chunks(text: bytes) -> list[bytes]:
    return text.lower().split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; hashes of their n-grams, with the word that each belongs to."""
    n = len(words)
    flat = np.frombuffer(b"".join(b"<" + w.strip(b".,;:!?|\"'()*%$&#") + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w.strip(b".,;:!?|\"'()*%$&#")) + 2 for w in words), np.int64, n)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(n), sizes)
    end = first + sizes
    # Hash of each prefix of each word, from powers; differences give n-grams and whole words.
    powers = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(len(flat)) - first[of]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((flat + np.uint64(1)) * powers[at])])
    whole = _mixed(sums[end] - sums[first])
    grams, owner = [], []
    inverse = np.cumprod(np.full(len(powers), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
    for k in GRAMS:
        start = np.flatnonzero(at + k <= sizes[of])
        grams.append(_mixed((sums[start + k] - sums[start]) * inverse[at[start]] + np.uint64(k)))
        owner.append(of[start])
    grams.append(whole)  # a word has at least itself
    owner.append(np.arange(n))
    order = np.argsort(np.concatenate(owner), kind="stable")
    return whole, np.concatenate(grams)[order], np.concatenate(owner)[order]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(8) & np.uint64(n - 1)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Inputs:
    """The words of some texts: distinct words with their features, and each text as numbers of words."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        self.rows = []
        for t in texts:
            words = chunks(t)
            self.rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        words = list(number) or [b""]
        self.word, gram, self.owner = features(words)
        self.gram, self.n = gram, len(words)
        self.first = np.searchsorted(self.owner, np.arange(self.n))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, its word numbers; -1 stands for no word)."""
        text, at = [], []
        for i, row in enumerate(self.rows):
            if len(row):
                last = max(0, len(row) - WINDOW)
                starts = np.append(np.arange(0, last, STRIDE), last)
                text.append(np.full(len(starts), i))
                at.append(starts)
        if not text:
            return np.empty(0, np.int64), np.empty((0, WINDOW), np.int64)
        text, at = np.concatenate(text), np.concatenate(at)
        sizes = np.array([len(r) for r in self.rows])
        base = (np.cumsum(sizes) - sizes)[text]
        place = at[:, None] + np.arange(WINDOW)
        held = place < sizes[text][:, None]
        return text, np.where(held, np.concatenate(self.rows)[np.minimum(base[:, None] + place, sizes.sum() - 1)], np.int32(-1))


class Net:
    """The network; p holds its parameters, lo the log-odds tables."""

    def __init__(self, lo_word: np.ndarray, lo_gram: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h, m = 3 + 2 * DIMS, UNITS, 2 * UNITS + 3 + 2 * DIMS
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.lo_word, self.lo_gram = lo_word, lo_gram
        self.p = {"ew": init(SLOTS, DIMS) * 5, "ec": init(SLOTS, DIMS) * 5, "wx": init(d, 6 * h), "b": np.zeros(6 * h, np.float32), "u0": init(h, 3 * h), "u1": init(h, 3 * h), "wa": init(m, 8), "ba": np.zeros(8, np.float32), "va": init(8, 1), "wo": init(m, 1), "bo": np.zeros(1, np.float32)}
        self.p["wa"][2 * h] += 1  # attention starts on the log-odds
        self.p["va"][:] = np.abs(self.p["va"])
        self.scale = np.float32([1.0, 0.0])

    def inputs(self, x: Inputs) -> np.ndarray:
        """The input vector of each distinct word; one more row of zeros stands for no word."""
        g, count = self.lo_gram[_slot(x.gram, ODDS)], np.diff(np.append(x.first, len(x.owner)))[:, None]
        e = np.add.reduceat(self.p["ec"][_slot(x.gram, SLOTS)], x.first, axis=0) / count
        lo = np.stack([self.lo_word[_slot(x.word, ODDS)], np.maximum.reduceat(g, x.first), np.add.reduceat(g, x.first) / count[:, 0]], axis=1)
        out = np.concatenate([lo, self.p["ew"][_slot(x.word, SLOTS)], e], axis=1).astype(np.float32)
        return np.concatenate([out, np.zeros((1, out.shape[1]), np.float32)])

    def forward(self, v: np.ndarray, w: np.ndarray, keep: bool = False):
        """Logits of windows w of words with vectors v; with keep, also what backward needs."""
        p, h, n = self.p, UNITS, len(w)
        xw = v @ p["wx"] + p["b"]
        held = w >= 0
        states = np.empty((n, WINDOW, 2 * h), np.float32)
        saved = []
        for side, u in ((0, p["u0"]), (1, p["u1"])):
            s, part = np.zeros((n, h), np.float32), np.ascontiguousarray(xw[:, side * 3 * h : (side + 1) * 3 * h])
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a, b = part[w[:, t]], s @ u
                zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                new = c + z * (s - c)
                new = new if held[:, t].all() else np.where(held[:, t, None], new, s)
                if keep:
                    saved.append((side, t, s, z, r, c, b[:, 2 * h :]))
                states[:, t, side * h : (side + 1) * h] = s = new
        m = np.concatenate([states, v[w]], axis=2)
        k = np.tanh(m @ p["wa"] + p["ba"])
        e = np.where(held, (k @ p["va"])[..., 0], np.float32(-30))
        att = np.exp(e - e.max(axis=1, keepdims=True))
        att /= att.sum(axis=1, keepdims=True)
        c = np.einsum("nt,ntm->nm", att, m)
        logit = (c @ p["wo"])[:, 0] + p["bo"]
        return (logit, (xw, held, saved, m, k, att, c)) if keep else logit

    def backward(self, x: Inputs, v: np.ndarray, w: np.ndarray, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters, from those of the logits."""
        p, h = self.p, UNITS
        _, held, saved, m, k, att, c = kept
        g = {"wo": c.T @ d[:, None], "bo": d.sum(keepdims=True)}
        dc = d[:, None] * p["wo"][:, 0]
        da = np.einsum("nm,ntm->nt", dc, m)
        dm = att[..., None] * dc[:, None, :]
        de = att * (da - (att * da).sum(axis=1, keepdims=True)) * held
        dk = de[..., None] * p["va"][:, 0] * (1 - k * k)
        g |= {"va": np.einsum("ntk,nt->k", k, de)[:, None], "wa": np.einsum("ntm,ntk->mk", m, dk), "ba": dk.sum(axis=(0, 1))}
        dm += dk @ p["wa"].T
        dxw = np.zeros((len(v), 6 * h), np.float32)
        g |= {"u0": np.zeros_like(p["u0"]), "u1": np.zeros_like(p["u1"])}
        ds = [np.zeros((len(w), h), np.float32), np.zeros((len(w), h), np.float32)]
        for side, t, s, z, r, n, bn in reversed(saved):
            u = p[f"u{side}"]
            on = held[:, t, None]
            total = dm[:, t, side * h : (side + 1) * h] * on + ds[side]
            dn = total * (1 - z) * (1 - n * n) * on
            dz = total * (s - n) * z * (1 - z) * on
            dr = dn * bn * r * (1 - r)
            da_ = np.concatenate([dz, dr, dn], axis=1)
            db = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"u{side}"] += s.T @ db
            np.add.at(dxw[:, side * 3 * h : (side + 1) * 3 * h], w[:, t], da_)
            ds[side] = np.where(on, total * z, total) + db @ u.T
        dv = np.zeros_like(v)
        np.add.at(dv, w.ravel(), dm[..., 2 * h :].reshape(-1, v.shape[1]))
        g |= {"wx": v[:-1].T @ dxw[:-1], "b": dxw[:-1].sum(axis=0)}
        dv = dv[:-1] + dxw[:-1] @ p["wx"].T
        g |= {"ew": np.zeros_like(p["ew"]), "ec": np.zeros_like(p["ec"])}
        np.add.at(g["ew"], _slot(x.word, SLOTS), dv[:, 3 : 3 + DIMS])
        count = np.diff(np.append(x.first, len(x.owner)))[:, None]
        np.add.at(g["ec"], _slot(x.gram, SLOTS), (dv[:, 3 + DIMS :] / count)[x.owner])
        return g

    def scores(self, texts: list[bytes]) -> np.ndarray:
        top = self.tops(Inputs(texts))
        return _sigmoid(self.scale[0] * top + self.scale[1]).astype(np.float64)

    def tops(self, x: Inputs) -> np.ndarray:
        """Largest logit of each text's windows; a text without words has the logit of no evidence."""
        text, w = x.windows()
        top = np.full(len(x.rows), -4.0, np.float32)
        v = self.inputs(x)
        for i in range(0, len(w), 8192):
            np.maximum.at(top, text[i : i + 8192], self.forward(v, w[i : i + 8192]))
        return top


def _odds(hashes: Iterable[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Log-odds of each slot among toxic and other documents, shrunk towards 0 where it is rare."""
    t, c = np.zeros(ODDS), np.zeros(ODDS)
    for h, y in zip(hashes, toxic):
        (t if y else c)[np.unique(_slot(h, ODDS))] += 1
    nt, nc = max(1, toxic.sum()), max(1, (~toxic).sum())
    lo = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
    return (lo * (t + c) / (t + c + 2)).astype(np.float32)


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Net | None:
    """The network from labelled texts; None without texts of both classes."""
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    x, r = Inputs(texts), np.random.default_rng(seed)
    ends = np.append(x.first, len(x.owner))
    grams = lambda row: x.gram[np.concatenate([np.arange(ends[i], ends[i + 1]) for i in np.unique(row)])] if len(row) else x.gram[:0]
    net = Net(_odds((x.word[row] for row in x.rows), toxic), _odds((grams(row) for row in x.rows), toxic), seed)
    text, w = x.windows()
    v = net.inputs(x)
    strength = np.where(w >= 0, (v[:, 0] + v[:, 1])[w], -9).max(axis=1)
    first, second = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}
    step = 0
    for _ in range(ROUNDS):
        order = np.lexsort((-strength, text))
        best = order[np.append(True, np.diff(text[order]) > 0)]  # the strongest window of each text
        more = r.choice(np.flatnonzero(~toxic[text]), size=min(len(best), int((~toxic[text]).sum())), replace=False)
        chosen = np.concatenate([best, more])
        for _ in range(EPOCHS):
            r.shuffle(chosen)
            for i in range(0, len(chosen), BATCH):
                at, step = chosen[i : i + BATCH], step + 1
                used, back = np.unique(w[at][w[at] >= 0], return_inverse=True)
                small = _some(x, used)
                ws = np.full((len(at), WINDOW), -1)
                ws[w[at] >= 0] = back
                vs = net.inputs(small)
                logit, kept = net.forward(vs, ws, keep=True)
                y = toxic[text[at]]
                d = ((_sigmoid(logit) - y) / len(at)).astype(np.float32)
                for k, gk in net.backward(small, vs, ws, kept, d).items():
                    first[k] += 0.1 * (gk - first[k])
                    second[k] += 0.001 * (gk * gk - second[k])
                    net.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        v = net.inputs(x)
        strength = np.concatenate([net.forward(v, w[i : i + 8192]) for i in range(0, len(w), 8192)])
    top = net.tops(x)
    a, b = 1.0, 0.0  # logistic calibration of the largest logit
    z = top.astype(np.float64)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        wt = q * (1 - q) + 1e-6
        gr = np.array([((toxic - q) * z).sum() - 0.01 * (a - 1), (toxic - q).sum()])
        hs = np.array([[(wt * z * z).sum() + 0.01, (wt * z).sum()], [(wt * z).sum(), wt.sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(hs, gr)
    net.scale = np.float32([max(a, 0.05), b])
    return net


def _some(x: Inputs, used: np.ndarray) -> Inputs:
    """The inputs restricted to some words."""
    out = object.__new__(Inputs)
    ends = np.append(x.first, len(x.owner))
    n = ends[used + 1] - ends[used]
    at = np.repeat(ends[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out.word, out.gram, out.owner, out.n = x.word[used], x.gram[at], np.repeat(np.arange(len(used)), n), len(used)
    out.first = np.cumsum(n) - n
    return out


def labelled(docs: DataFrame, labels: DataFrame, mod: int = 5) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled documents outside the held-out remainder."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).filter(remainder("doc_id", mod) != 0)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.lit(0.0)
    for toxic, count in n.items():
        part = F.when(F.col("toxic") == toxic, F.lit(min(1.0, SAMPLE / count))).otherwise(part)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < part * (1 << 20))
    # A few thousand ids at most, whatever the number of labels.
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.select("doc_id", "toxic", F.substring("text", 1, SAMPLE_BYTES).alias("text"), F.xxhash64("doc_id", "text").alias("draw"))
    before = F.coalesce(F.sum(F.octet_length("text")).over(W.partitionBy("toxic").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    texts = texts.withColumn("left", SAMPLE_BYTES - before).filter("left > 0")
    return texts.select("doc_id", "draw", F.expr("substring(text, 1, CAST(left AS INT))").alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5) -> Net | None:
    """The network, trained by one task, for the sample is bounded (SAMPLE_BYTES of each class, which labelled() has cut); the driver gets a few MB of parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["draw"], r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        net = train([r[2] for r in rows], np.array([r[3] for r in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    small_batches(docs.sparkSession)
    found = labelled(docs, labels, mod).repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(found["net"]) if found else None


def _scored(docs: DataFrame, labels: DataFrame, carried: list[str], mod: int) -> DataFrame:
    """(row, score); row holds the carried columns, so that their names meet no others."""
    spark = docs.sparkSession
    net = fit(docs, labels, mod)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few MB, fixed by SLOTS and ODDS
    rows = docs.select(F.struct(*carried).alias("row"), text_bytes().alias("text"))
    schema = rows.drop("text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            s = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["row", "score"])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, mod: int = 5) -> DataFrame:
    """(doc_id, score, predicted): score from 0 to 1, higher where label 1 is likelier; predicted says whether it is 0.5 or more."""
    return _scored(docs, labels, ["doc_id"], mod).select("row.doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, mod: int = 5) -> DataFrame:
    """The documents whose score is below 0.5, with their own columns."""
    return _scored(docs, labels, docs.columns, mod).filter("score < 0.5").select("row.*")
