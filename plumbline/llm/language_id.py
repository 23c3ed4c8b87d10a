"""Language identification by interpolated Kneser-Ney models of characters.

For each language, n-grams of characters up to ORDER, within words and their edges: raw counts for the
longest, numbers of distinct preceding characters for the shorter ones, absolute discounting, and
interpolation down to a uniform share. The n-grams of all languages stand in one sorted array of hashes for
each length; each points to its entries, one for each language that has it, so that scoring is a binary search for
each n-gram and the model grows with the n-grams that occur, not with their number times that of languages.

A text's cross-entropy is the mean over all its characters; the least one wins. Its score is the calibrated
probability of the winner; accepted tells whether the cross-entropy is one that unseen texts of the language
have. Both are calibrated on texts that the model did not learn from: two models each learn from half the sample and
measure the other half; the final one learns from all of it. Every distinct word is scored once for each worker's
memory, of REMEMBERED bytes.

The models learn from a bounded sample of the labelled rows: the first SAMPLE_BYTES of text of each language,
in the order of a hash of the id, of all rows outside the held-out remainder; a language has one text at least.

Null texts and texts without letters get `und` and score 0. Rows with a null label do not teach. Without a
labelled row every text is `und`. Repeated rows are scored alike. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import remainder, small_batches

SAMPLE_BYTES = 1_500_000
ORDER, DISCOUNT, REMEMBERED = 5, 0.75, 128 << 20
#: Share of a language's own sample that its rejection threshold keeps.
KEPT = 0.999
#: Bits of a character in a language that a half of the sample lacks.
ABSENT = 64.0
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of the words (0 where a word has none so long), for n from 1;
    the number of the word of each character; whether it counts (all but the opening edge)."""
    flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[of]
    out, h = [], np.zeros(len(flat), np.uint64)
    for n in range(1, ORDER + 1):  # h of n: the characters from n - 1 before, in order
        prior = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if n > 1 else h
        h = (prior * _FACTOR) ^ (flat + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = h ^ (h >> np.uint64(29))
        out.append(np.where(at >= n - 1, h | np.uint64(1), np.uint64(0)))
    return out, of, at > 0


class Entries:
    """Values of (key, language) pairs, in the order of the keys."""

    def __init__(self, parts: list[tuple], n: int):
        key = np.concatenate([k for k, _, _ in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[order], np.arange(n + 1)).astype(np.int64)
        self.lang = np.concatenate([np.full(len(k), lang, np.int32) for k, lang, _ in parts])[order] if parts else np.empty(0, np.int32)
        self.value = np.concatenate([v for _, _, v in parts]).astype(np.float32)[order] if parts else np.empty(0, np.float32)

    def dense(self, at: np.ndarray, known: np.ndarray, languages: int, other: float) -> np.ndarray:
        """The values of the known keys at, a row for each and a column for each language; other where there is none."""
        out = np.full((len(at), languages), other, np.float32)
        rows = np.flatnonzero(known)
        low, n = self.first[at[rows]], self.first[at[rows] + 1] - self.first[at[rows]]
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(rows, n), self.lang[entry]] = self.value[entry]
        return out


class Models:
    """Kneser-Ney models of some languages; words: for each language its (word, count) pairs."""

    def __init__(self, words: dict[str, list[tuple[str, int]]]):
        self.languages = sorted(words)
        n = len(self.languages)
        parts = []
        for name in self.languages:
            held = [w for w, _ in words[name]]
            weight = np.array([c for _, c in words[name]], np.float64)
            parts.append((*grams(held), weight))
        letters = np.unique(np.concatenate([g[0][0] for g in parts])) if parts else np.empty(0)
        self.floor = 1.0 / (len(letters) + 1)
        self.keys = [np.unique(np.concatenate([g[0][k][g[0][k] > 0] for g in parts])) for k in range(ORDER)]
        found: list[list[tuple]] = [[] for _ in range(ORDER)]  # (keys, language, discounted probabilities)
        after: list[list[tuple]] = [[] for _ in range(ORDER)]  # (keys, language, weights of the shorter model after an n-gram)
        self.start = np.ones(n, np.float32)
        for lang, (hashes, of, counted, weight) in enumerate(parts):
            for k in range(ORDER):
                ok = (hashes[k] > 0) & counted
                key = np.searchsorted(self.keys[k], hashes[k][ok])
                context = hashes[k - 1][np.flatnonzero(ok) - 1] if k else np.zeros(len(key), np.uint64)
                if k == ORDER - 1:
                    c = np.bincount(key, weight[of[ok]], len(self.keys[k]))
                else:  # distinct n-grams one longer; n-grams at a word's start count as they are
                    longer = hashes[k + 1][ok]
                    pair = np.unique(np.stack([key.astype(np.uint64), longer], axis=1), axis=0)
                    c = np.bincount(pair[:, 0].astype(np.int64), minlength=len(self.keys[k])).astype(np.float64)
                used = np.flatnonzero(c)
                one = np.zeros(len(self.keys[k]), np.uint64)
                one[key] = context
                if k:
                    ctx = np.searchsorted(self.keys[k - 1], one[used])
                    sums, kinds = (np.bincount(ctx, x, len(self.keys[k - 1])) for x in (c[used], np.ones(len(used))))
                    total = sums[ctx]
                    seen = sums > 0
                    after[k - 1].append((np.flatnonzero(seen), lang, DISCOUNT * kinds[seen] / sums[seen]))
                else:
                    total = np.full(len(used), c.sum())
                    self.start[lang] = DISCOUNT * len(used) / max(c.sum(), 1)
                found[k].append((used, lang, (c[used] - DISCOUNT) / total))
        self.own = [Entries(x, len(k)) for x, k in zip(found, self.keys)]
        self.rest = [Entries(x, len(k)) for x, k in zip(after, self.keys)]

    def entropies(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of -log2 probability of each word's characters for each language, and the number of characters."""
        hashes, of, counted = grams(words)
        p = np.full((len(of), len(self.languages)), self.floor, np.float32)
        rest = np.broadcast_to(self.start, p.shape)
        for k in range(ORDER):
            at = np.searchsorted(self.keys[k], hashes[k])
            at = np.minimum(at, len(self.keys[k]) - 1)
            known = (self.keys[k][at] == hashes[k])[:, None]
            held = hashes[k][:, None] > 0
            p = np.where(held, self.own[k].dense(at, known[:, 0], p.shape[1], 0) + rest * p, p)
            after = self.rest[k].dense(at, known[:, 0], p.shape[1], 1)
            rest = np.concatenate([np.ones((1, p.shape[1]), np.float32), after[:-1]])
        bits = -np.log2(np.maximum(p, 1e-12)) * counted[:, None]
        first = np.flatnonzero(np.append(True, np.diff(of) > 0))
        return np.add.reduceat(bits, first, axis=0), np.add.reduceat(counted.astype(np.int64), first)


class Scorer:
    """Cross-entropies of texts; remembers the sums of a bounded number of words."""

    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.letters = 0
        self.bits, self.chars = np.empty((0, len(self.models.languages)), np.float32), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Mean bits for each text and language; infinite without letters."""
        # A word takes its letters, some 100 bytes of Python, and a number for each language.
        if self.letters + len(self.number) * (100 + 4 * len(self.models.languages)) > REMEMBERED:
            self.forget()
        number, before = self.number, len(self.number)
        rows = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t or "")), np.int64) for t in texts]
        new = list(islice(number, before, None)) if len(number) > before else []
        self.letters += sum(map(len, new))
        for i in range(0, len(new), 20_000):
            bits, chars = self.models.entropies(new[i : i + 20_000])
            self.bits, self.chars = np.concatenate([self.bits, bits]), np.concatenate([self.chars, chars])
        out = np.full((len(texts), len(self.models.languages)), np.inf)
        for i, row in enumerate(rows):
            if len(row):
                out[i] = self.bits[row].sum(axis=0, dtype=np.float64) / self.chars[row].sum()
        return out


def learned(texts: list[tuple[str, str]]) -> Models | None:
    """Models of (language, text) pairs; None without a word."""
    counts: dict[str, Counter] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(words_of(text))
    words = {lang: sorted(c.items()) for lang, c in counts.items() if c}
    return Models(words) if words else None


def unseen(texts: list[tuple[str, str]], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropies of texts under a model of the other half, infinite for languages that the half lacks; their languages' numbers."""
    h = np.full((len(texts), len(languages)), np.inf)
    for half in (0, 1):
        models = learned(texts[1 - half :: 2])
        if models:
            h[half::2, [languages.index(x) for x in models.languages]] = Scorer(models)([t for _, t in texts[half::2]])
    return h, np.array([languages.index(name) for name, _ in texts])


class Identifier:
    """Models with their calibration: a temperature for the score, a rejection threshold for each language."""

    def __init__(self, models: Models, texts: list[tuple[str, str]]):
        self.models, self.temperature = models, 8.0
        languages = self.models.languages
        self.most = np.full(len(languages), np.inf)
        h, y = unseen(sorted({t for t in texts if t[0] in languages}), languages)
        ok = np.isfinite(h[np.arange(len(y)), y])  # the other half knows the language, and the text has letters
        h, y = np.where(np.isfinite(h), h, ABSENT)[ok], y[ok]
        if len(y):
            def loss(t: float) -> float:
                z = -t * (h - h.min(axis=1, keepdims=True))
                return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

            self.temperature = min((0.5 * 2 ** (i / 2) for i in range(14)), key=loss)
            for k in range(len(languages)):
                if (y == k).any():
                    self.most[k] = np.quantile(h[y == k, k], KEPT)

    def verdicts(self, h: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        known = np.isfinite(h).all(axis=1) if h.shape[1] else np.zeros(len(h), bool)
        if not known.any():
            return [UNKNOWN] * len(h), np.zeros(len(h)), np.full(len(h), np.nan), np.zeros(len(h), bool)
        safe = np.where(known[:, None], h, 0)
        best = safe.argmin(axis=1)
        z = np.exp(-self.temperature * (safe - safe.min(axis=1, keepdims=True)))
        score = np.where(known, 1 / z.sum(axis=1), 0.0)
        bits = np.where(known, safe.min(axis=1), np.nan)
        return [self.models.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, bits, known & (bits <= self.most[best])


def fit(docs: DataFrame, mod: int = 4, held: int = 2) -> Identifier | None:
    """Learns from a bounded sample; None without a labelled text."""
    train = docs.filter((remainder("doc_id", mod) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    size, w = F.octet_length("text"), W.partitionBy("lang").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    train = train.withColumn("_h", F.xxhash64("doc_id", F.lit("language"))).select("lang", "text", "_h", F.pmod("_h", F.lit(4096)).alias("bin"))
    # Documents in the order of bins, then of hashes: those whose predecessors have less than SAMPLE_BYTES, the last one cut.
    bins = train.groupBy("lang", "bin").agg(F.sum(size).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("base") < SAMPLE_BYTES).drop("n")
    drawn = train.join(bins, ["lang", "bin"]).select("lang", "bin", "_h", "base", size.alias("n"), F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("text"))
    before = F.col("base") + F.coalesce(F.sum("n").over(W.partitionBy("lang", "bin").orderBy("_h", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("left", SAMPLE_BYTES - before).filter("left > 0").select("lang", F.expr("substring(text, 1, cast(left as int))").alias("text"))
    texts = [(r["lang"], bytes(r["text"]).decode(errors="ignore")) for r in drawn.toLocalIterator()]  # at most SAMPLE_BYTES for each language
    models = learned(sorted(texts))
    return Identifier(models, texts) if models else None


def identify(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, accepted) of each document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, mod, held))  # of a size that SAMPLE_BYTES and the number of languages bound
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        scorer = Scorer(found.models) if found else None
        for b in batches:
            texts = b.column(1).to_pylist()
            if found:
                lang, score, bits, ok = found.verdicts(scorer(texts))
            else:
                lang, score, bits, ok = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(ok)], ["doc_id", "lang_pred", "score", "bits", "accepted"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, accepted boolean")
    return rows.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "lang_pred", "score", "bits", "accepted")
