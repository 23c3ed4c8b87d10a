"""Scoring by a log-bilinear language model, trained in numpy with noise-contrastive estimation.

Counts: Spark counts every training token (combined before the shuffle). The most frequent tokens, a table of HEAD
at most, go to the tasks: all whose count lies above a limit that a histogram of the counts gives, so that nothing but
these is read by the driver. The rare others of each document are joined with the counts by a shuffle, so every token
of every text has its count over all training documents.

Model: the TOP most frequent tokens are classes of their own; all others fall into BUCKETS classes by a hash
of their first two bytes, and within a class a token has its share of smoothed counts. The vectors of the
two classes before a token, each times its place's matrix, predict the next class; the scores of all classes
(one matrix product for the distinct contexts of a batch) are normalised by their sum. So the probabilities
of all known tokens and one unknown token for each bucket add up to 1.

Training: every task trains a copy over the training documents it reads, with noise drawn from the class
frequencies, and the copies are averaged by their tokens (in two steps, so that no task gathers all copies). So the
scores depend on how the input is dealt to tasks: the same files read in the same way give the same scores.
Vectors start such that the untrained model is the smoothed unigram model.

Null texts are empty: one end token. Repeated rows score alike. With no training documents all counts are 0
and the model stays untrained. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, remainder, small_batches, text_bytes

#: Tokens whose counts every task holds; classes of one token; classes of hashed tokens; dimensions.
HEAD, TOP, BUCKETS, DIMS = 200_000, 640, 128, 16
#: Noise samples and tokens of a training step, and its rate.
NOISE, STEP, RATE = 64, 4096, 0.05
#: Distinct tokens that a task holds while it counts.
HELD = 300_000


def bucket(token: bytes) -> int:
    return zlib.crc32(token[:2]) % BUCKETS


def counts(train: DataFrame, held: int = HELD) -> DataFrame:
    """(token, c) of the training documents; a task adds up to held distinct tokens before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "c"])
            seen.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.lower().split())
            seen[b""] += b.num_rows
            if len(seen) > held:
                yield out()
        if seen:
            yield out()

    return train.select(text_bytes().alias("text")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary(dict):
    """Code of each head token; any other token is noted in tail and has the code of its bucket."""

    def __init__(self, head: list[tuple[bytes, int]], mass: np.ndarray, total: int, distinct: int):
        super().__init__((t, i) for i, (t, _) in enumerate(head))
        self.tail: list[bytes] = []
        c = np.array([c for _, c in head], np.float64)
        top = min(TOP, len(head))
        self.classes = np.concatenate([np.arange(top), [TOP + bucket(t) for t, _ in head[top:]], TOP + np.arange(BUCKETS)]).astype(np.int64)
        self.log_c = np.concatenate([np.log10(c + 1), np.zeros(BUCKETS)])  # a tail token's own count comes from the join
        # Mass of the classes: smoothed counts, one unknown token for each bucket.
        self.mass = np.concatenate([c[:top] + 1, np.zeros(TOP - top), mass])
        self.share = self.log_c - np.log10(self.mass[self.classes])
        self.share[:top] = 0
        self.total, self.distinct = total, distinct
        self.p = self.mass / self.mass.sum()
        self.end = self.get(b"", len(head) + bucket(b""))

    def __missing__(self, token: bytes) -> int:
        self.tail.append(token)
        return len(self) + bucket(token)

    def codes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        words.append(b"")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Bilinear:
    """Vectors of context classes (q) and predicted classes (r), a matrix for each place (m) and biases (b)."""

    NAMES = ("q", "r", "m", "b")

    def __init__(self, p: np.ndarray, seed: int = 11):
        g, k = np.random.default_rng(seed), len(p)
        self.q = (g.standard_normal((k, DIMS)) * 0.3).astype(np.float32)
        self.r = np.zeros((k, DIMS), np.float32)
        self.m = np.stack([np.eye(DIMS), np.eye(DIMS) * 0.5]).astype(np.float32)
        self.b = np.log(np.maximum(p, 1e-12)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Bilinear:
        at = 0
        for k in self.NAMES:
            a = getattr(self, k)
            setattr(self, k, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.q[one] @ self.m[0] + self.q[two] @ self.m[1]

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of each target class after the classes one (just before) and two."""
        contexts, of = np.unique(one * len(self.b) + two, return_inverse=True)
        norm = np.empty(len(contexts), np.float32)
        h = self.hidden(contexts // len(self.b), contexts % len(self.b))
        for i in range(0, len(h), 4096):
            s = h[i : i + 4096] @ self.r.T + self.b
            top = s.max(axis=1, keepdims=True)
            norm[i : i + 4096] = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
        score = np.einsum("nd,nd->n", h[of], self.r[target]) + self.b[target]
        return (score - norm[of]).astype(np.float64) / np.log(10)

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, noise: np.ndarray, log_kp: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """One step of noise-contrastive estimation with shared noise, rates by Adagrad."""
        h, n, k = self.hidden(one, two), len(target), len(self.b)
        real = np.einsum("nd,nd->n", h, self.r[target]) + self.b[target] - log_kp[target]
        fake = h @ self.r[noise].T + self.b[noise] - log_kp[noise]
        up = 1 / (1 + np.exp(real))  # pull of each target
        down = -1 / (1 + np.exp(-fake))  # push of each noise sample; NOISE samples stand for k draws each
        dh = up[:, None] * self.r[target] + down @ self.r[noise]
        dr, db = _sum_by(target, up[:, None] * h, k), np.bincount(target, up, k)
        np.add.at(dr, noise, down.T @ h)
        np.add.at(db, noise, down.sum(axis=0))
        dq = _sum_by(one, dh @ self.m[0].T, k) + _sum_by(two, dh @ self.m[1].T, k)
        dm = np.stack([self.q[one].T @ dh, self.q[two].T @ dh])
        for name, d in (("q", dq), ("r", dr), ("m", dm), ("b", db)):
            d = d / np.sqrt(n)
            s = sums.setdefault(name, np.full(d.shape, 1e-1))
            s += d * d
            getattr(self, name).__iadd__((RATE * d / np.sqrt(s)).astype(np.float32))


def _sum_by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], axis=1)


def _contexts(rows: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class two before, class) of every token; texts start after end tokens."""
    flat = np.concatenate([np.concatenate([[end, end], r]) for r in rows])
    keep = np.ones(len(flat), bool)
    first = np.cumsum([0, *(len(r) + 2 for r in rows[:-1])])
    keep[first] = keep[first + 1] = False
    at = np.flatnonzero(keep)
    return flat[at - 1], flat[at - 2], flat[at]


def fit(train: DataFrame, vocabulary, p: np.ndarray) -> Bilinear:
    """The average of the copies that tasks train over all training documents."""
    chunks = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model, sums, seen, g = Bilinear(v.p), {}, 0, np.random.default_rng(3)
        log_kp = np.log(np.maximum(NOISE * v.p, 1e-12)).astype(np.float32)
        for b in batches:
            rows = [v.classes[v.codes(t)] for t in b.column(0).to_pylist()]
            v.tail.clear()
            one, two, target = _contexts(rows, v.classes[v.end])
            order = g.permutation(len(target))
            for i in range(0, len(order), STEP):
                at = order[i : i + STEP]
                model.learn(one[at], two[at], target[at], g.choice(len(v.p), NOISE, p=v.p), log_kp, sums)
            seen += len(target)
        if seen:
            parts = np.array_split(model.flat().astype(np.float64) * seen, chunks)
            lane = zlib.crc32(parts[0].tobytes()) % 256
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([lane] * chunks, pa.int32()), pa.array([seen] * chunks, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "lane", "seen", "sums"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in sorted(t.column("sums").to_pylist()))  # in an order that reruns repeat
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "lane": pa.array([0], pa.int32()), "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, lane int, seen long, sums binary"
    copies = train.select(text_bytes().alias("text")).mapInArrow(run, schema)
    total = copies.groupBy("chunk", "lane").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    rows = sorted(total.collect(), key=lambda r: r["chunk"])  # one model, of fixed size
    model = Bilinear(p)
    return model.load(np.concatenate([np.frombuffer(r["sums"], np.float64) / r["seen"] for r in rows])) if rows else model


def head(c: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """The most frequent tokens with their counts, HEAD at most: those in the top bins of the counts' logarithm, as many bins as fit."""
    binned = c.withColumn("bin", F.floor(F.log2("c") * 256))
    least, left = None, HEAD if most is None else most
    for r in sorted(binned.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):  # some ten thousand bins at most
        if r["n"] > left:
            break
        least, left = r["bin"], left - r["n"]
    if least is None:
        return []
    rows = [(bytes(r["token"]), r["c"]) for r in binned.filter(F.col("bin") >= least).select("token", "c").collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0]))


def score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    out = remainder("doc_id", mod) == held
    train = docs.filter(~out)
    c = cut(spark, counts(train))
    total, distinct = c.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    first = head(c)
    # Mass of each bucket over all its tokens, those of the head beyond TOP too.
    by = F.crc32(F.substring("token", 1, 2)) % BUCKETS
    mass = np.ones(BUCKETS)
    for r in c.groupBy(by.alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["k"]] += r["m"]
    for t, n in first[:TOP]:
        mass[bucket(t)] -= n + 1
    v = Vocabulary(first, mass, total, distinct)
    shared = spark.sparkContext.broadcast(v)
    model = spark.sparkContext.broadcast(fit(train, shared, v.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value, model.value
        for b in batches:
            rows, tails = [], []
            for t in b.column(1).to_pylist():
                rows.append(v.codes(t))
                tails.append(list(v.tail))
                v.tail.clear()
            sizes = np.array([len(r) for r in rows])
            at = np.cumsum(sizes) - sizes
            flat = np.concatenate(rows)
            p = net.log10(*_contexts([v.classes[r] for r in rows], v.classes[v.end])) + v.share[flat]
            columns = [pa.array(sizes), pa.array(sizes - [len(t) for t in tails]), pa.array(np.add.reduceat(v.log_c[flat], at)), pa.array(np.add.reduceat(p, at)), pa.array(tails, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_tokens", "n_head", "head_sum", "p", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_head long, head_sum double, p double, tail array<binary>")
    rows = cut(spark, rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode("tail").alias("token")).groupBy("row", "token").agg(F.count("*").alias("n"))
    known = tail.join(c, "token")
    known = known.groupBy("row").agg(F.sum((F.col("n") * F.log10(F.col("c") + 1)).cast("decimal(38,12)")).cast("double").alias("tail_sum"), F.sum("n").alias("n_tail"))
    whole = rows.drop("tail").join(known, "row", "left").na.fill(0, ["tail_sum", "n_tail"])
    base = F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return whole.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "n_tokens", (F.col("n_head") + F.col("n_tail")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("p") + F.col("tail_sum")).alias("score"))
