"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Tokenise: one narrow pass over the texts gives each document's pieces (only a document longer than a
   sequence is cut). Texts fall apart at ASCII white space, which the tokenizer drops and never joins, so
   the ids of each distinct chunk are looked up once per worker.
2. Plan: best-fit decreasing over the histogram of lengths (at most `size` counts, whatever the number of
   documents). The plan says which ranks of a length go to which range of sequences at which offset.
3. Place: each piece gets its rank within its length and takes the planned slot that covers the rank. Ranks
   come from counts per bucket and length, summed over buckets, plus the place within the bucket, so that a
   length that a third of all pieces share is ranked in as many tasks as there are buckets.

Null and empty texts have the end id alone. Repeated rows are packed as often as they occur; ties of a rank
go by (doc_id, piece). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, small_batches

SIZE, END = 2048, 0
#: Distinct chunks whose ids a worker remembers, the characters of all of them, and pieces of a rank bucket.
REMEMBERED, CHARACTERS, BUCKET = 500_000, 32_000_000, 20_000
#: Marks that close a word.
MARKS = ",.;:!?|"
# Fixed value: the pattern by which the word tokenizers part a text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters before this one fold case one by one and have no other form.
LATIN = "\u0130"


class Numbered(dict):
    """Numbers keys as they come; new holds those since it was last emptied, characters counts all keys'."""

    def __init__(self):
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        self.characters += len(key)
        return n


def folds_and_parts(tokenizer) -> bool:
    """Whether the tokenizer drops white space, folds case, composes characters and always parts letters from marks: then a text may be
    encoded chunk by chunk. The rule is read from its own description, with the pattern that parts words as a fixed value."""
    held = json.loads(tokenizer.to_str())
    steps = held.get("normalizer") or {}
    kinds = [n.get("type") for n in steps.get("normalizers", [])]
    parts = ((held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = parts.get("pattern", {}).get("Regex")
    return kinds == ["NFC", "Replace", "Lowercase"] and parts.get("invert") is True and parts.get("behavior") == "Removed" and pattern == PARTS


class Encoder:
    """Ids of texts, chunk by chunk between ASCII white space; remembers a bounded number of chunks.

    A chunk of Latin letters, with or without closing marks, is encoded as its lower-case word and its marks,
    for the tokenizer folds case and always parts letters from marks; any other chunk goes to it as it is. A tokenizer
    that does not work so (`folds_and_parts`) gets whole texts, and nothing is remembered.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, end: int = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.word, self.remembered, self.end = Tokenizer.from_file(path), Tokenizer.from_file(path), remembered, end
        self.by_chunk = folds_and_parts(self.whole)
        self.word.normalizer, self.word.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()

    def forget(self) -> None:
        self.chunks, self.units = Numbered(), Numbered()
        self.pairs = np.empty((0, 2), np.int64)
        self.ids, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Appends each chunk's two units (word and marks, or all of it and nothing) and the ids of new units."""
        number, first, second = self.units.__getitem__, [], []
        for c in chunks:
            core = c.rstrip(MARKS)
            if core.isalpha() and max(core) < LATIN:
                first.append(number(core.lower()))
                second.append(number(c[len(core) :]))
            else:
                first.append(number(c))
                second.append(number(""))
        self.pairs = np.concatenate([self.pairs, np.array([first, second], np.int64).T])
        new = self.units.new
        plain = [u.isalpha() and max(u) < LATIN and u == u.lower() for u in new]
        words = iter(self.word.encode_batch_fast([u for u, w in zip(new, plain) if w], add_special_tokens=False))
        others = iter(self.whole.encode_batch_fast([u for u, w in zip(new, plain) if not w], add_special_tokens=False))
        rows = [next(words if w else others).ids for w in plain]
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, rows), np.int64, len(rows))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(rows), np.uint32)])
        new.clear()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        if not self.by_chunk:
            return [np.array([*self.whole.encode(t, add_special_tokens=False).ids, self.end], np.uint32) for t in texts]
        if len(self.chunks) > self.remembered or self.chunks.characters > CHARACTERS:
            self.forget()
        number = self.chunks.__getitem__
        rows = []
        for t in texts:
            chunks = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            rows.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        if self.chunks.new:
            self.learn(self.chunks.new)
            self.chunks.new.clear()
        first = np.cumsum(self.sizes) - self.sizes
        units = self.pairs[np.concatenate(rows)].ravel()
        n = self.sizes[units]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first[units] - ends + n, n)]
        return [np.append(x, np.uint32(self.end)) for x in np.split(ids, ends[2 * np.cumsum([len(r) for r in rows]) - 1][:-1])]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode([t or "" for t in b.column(1).to_pylist()])):
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append(row)
                    piece.append(at // size)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows (length, first rank, end rank, first sequence, offset).

    The piece of rank first + i goes to sequence first + i at the offset. Sequences with the same contents
    so far form a run (first sequence, number); a run is split at most once for each length.
    """
    rows, free, opened = [], {}, 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        room = length
        while rank < end:
            while room <= size and not free.get(room):
                room += 1
            if room > size:  # as many new sequences as hold the rest of this length
                n = -(-(end - rank) // (size // length))
                free.setdefault(size, []).append((opened, n))
                opened += n
                room = length
                continue
            at, n = free[room].pop()
            m = min(n, end - rank)
            rows.append((length, rank, rank + m, at, size - room))
            if m < n:
                free[room].append((at + m, n - m))
            free.setdefault(room - length, []).append((at, m))
            rank += m
            room = min(room, room - length) if room - length >= length else room
    return rows


def ranked(parts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds rank, from 0 within each length, over pieces of any number."""
    total = parts.count()
    n = max(1, -(-total // bucket))
    placed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    by = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = by.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1
    return placed.withColumn("within", within).join(base, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    spark: SparkSession = docs.sparkSession
    parts = cut(spark, pieces(docs, tokenizer, size))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(best_fit(counts, size), "length long, low long, high long, first long, offset long")
    # A length's rows of the plan stand in one array, ordered by rank: an equi-join on length, then the last row that starts at or before the rank.
    slots = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("slots"))
    rows = ranked(parts, bucket).join(F.broadcast(slots), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), 1)
    rows = rows.withColumn("slot", slot)
    sequence = F.col("slot")["first"] + F.col("rank") - F.col("slot")["low"]
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("slot")["offset"].alias("offset"))
