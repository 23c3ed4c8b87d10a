"""Token ids of all documents in binary shards, with an index by document key.

A store is a folder:

    ids/shard-N.bin       raw little-endian ids (two bytes each where the vocabulary allows, else four), documents in ascending
                          doc_id, null first; the shards in order are one sequence of ids
    index/bucket-N.idx    a minimal perfect hash of the keys of a bucket, then one record of RECORD for each key: fingerprint, shard,
                          place and number of ids in the shard, ids of all documents before
    keys/                 Parquet: the keys
    store.json            widths and numbers

A key is (doc_id, nth), nth counting equal ids from 0, so that repeated ids are documents of their own. Two 64-bit hashes of it give
its bucket, its number in the bucket's perfect hash, and the 32-bit fingerprint that tells a key of the store from another one (but for
one in four thousand million). Access to a key reads its bucket's hash, one record and its ids, whatever the size of the store.

Documents are dealt by ranges of (doc_id, hash of the text, row), so that equal ids, even a third of all rows, part into many
ranges; a task encodes its range and writes one shard. Buckets hold some KEYS keys by a hash. Files get their final name
once they are whole, and a task that is run again writes the same bytes, so a lost executor leaves no half file. Only tables of a row for each
shard pass through one task (a window over their numbers of ids).

Null and empty texts have the end id alone. Texts of any length are encoded whole. Equal ids go by the hash of their texts. Extra columns
are ignored. An empty table gives a store without shards and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, small_batches
from plumbline.llm.packing import Encoder
from plumbline.llm.perfect_hash import PerfectHash

END = 1
#: Bytes of text of a shard, keys of a bucket, distinct chunks that a worker remembers for all its tasks.
SHARD, KEYS, REMEMBERED = 64 << 20, 1 << 17, 1_000_000
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("place", "<u8"), ("n", "<u8"), ("start", "<u8")])
#: Ids that are read at once when slices of a shard are near each other.
SPAN = 1 << 20
SEED = 42


@lru_cache(1)
def encoder(tokenizer: str, end: int) -> Encoder:
    """One for each worker, which keeps it from task to task."""
    return Encoder(tokenizer, REMEMBERED, end)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _put(uri: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of this attempt, then give it its own."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0])
    at = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 'driver'}"
    with fs.open_output_stream(at) as out:
        for x in parts:
            out.write(x)
    fs.move(at, path)


def shard_file(store: str, n: int) -> str:
    return f"{store}/ids/shard-{n:08d}.bin"


def bucket_file(store: str, n: int) -> str:
    return f"{store}/index/bucket-{n:08d}.idx"


def hashes(doc_id: Column, nth: Column) -> tuple[Column, Column]:
    """The two hashes of a key."""
    text, nth = doc_id.cast("string"), nth.cast("long")
    return F.xxhash64(text, nth), F.xxhash64(nth, text)


def hashes_of(doc_id, nth: int) -> tuple[int, int]:
    """The same outside Spark."""
    number = struct.pack("<q", nth)
    of = lambda data, seed: seed if data is None else xxhash.xxh64_intdigest(data, seed)
    text = None if doc_id is None else str(doc_id).encode()
    return of(number, of(text, SEED)), of(text, of(number, SEED))


def _encoded(docs: DataFrame, store: str, tokenizer: str, width: int, end: int, shard: int) -> DataFrame:
    """Writes the shards; (shard, doc_id, again, place, n) of each document, again counting equal ids within the shard."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(max(1, -(-size // shard)), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer, end), TaskContext.get().partitionId()
        notes: list[pa.RecordBatch] = []

        def ids() -> Iterator[bytes]:
            last, again, place = object(), 0, 0
            for b in batches:
                parts = encode([t or "" for t in b.column(1).to_pylist()])
                n = np.array([len(x) for x in parts], np.int64)
                times = []
                for key in b.column(0).to_pylist():
                    last, again = key, again + 1 if key == last else 0
                    times.append(again)
                columns = [pa.array([number] * len(n), pa.int32()), b.column(0), pa.array(times, pa.int64()), pa.array(place + np.cumsum(n) - n), pa.array(n)]
                notes.append(pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "again", "place", "n"]))
                place += int(n.sum())
                yield np.concatenate(parts).astype(f"<u{width}").tobytes()

        first = next(data := ids(), None)
        if first is not None:
            _put(shard_file(store, number), (x for part in ([first], data) for x in part))
        yield from notes

    return rows.select("doc_id", "text").mapInArrow(run, f"shard int, doc_id {kind}, again long, place long, n long")


def _keyed(entries: DataFrame) -> DataFrame:
    """(doc_id, nth, shard, place, n, start) from the shards' entries. Equal ids may begin in earlier shards: a shard's first id goes on
    from what the shards before it that end in this id have of it."""
    shards = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.min_by("doc_id", "place").alias("first"), F.max_by("doc_id", "place").alias("last"), F.max_by(F.col("again") + 1, "place").alias("tail"))
    asks = shards.select("shard", F.col("first").alias("key"), F.lit(0).alias("says"), F.lit(0).cast("long").alias("tail"))
    tells = shards.select("shard", F.col("last").alias("key"), F.lit(1).alias("says"), "tail")
    earlier = F.sum("tail").over(W.partitionBy("key").orderBy("shard", "says").rowsBetween(W.unboundedPreceding, -1))
    base = asks.unionByName(tells).withColumn("base", F.coalesce(earlier, F.lit(0))).filter("says = 0").select("shard", "base")
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of = shards.select("shard", "first", before.alias("before")).join(base, "shard").withColumnRenamed("shard", "_shard")
    rows = entries.join(of, F.col("shard") == F.col("_shard"))
    nth = F.col("again") + F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("base")).otherwise(F.lit(0))
    return rows.select("doc_id", nth.alias("nth"), "shard", "place", "n", (F.col("before") + F.col("place")).alias("start"))


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    one, two = hashes(F.col("doc_id"), F.col("nth"))
    return keys.withColumns({"h1": one, "h2": two, "bucket": F.pmod(one, F.lit(buckets)).cast("int")})


def fingerprints(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _indexed(slots: DataFrame, store: str) -> DataFrame:
    """Writes the index; (bucket, keys) of each bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        held, number = PerfectHash.build(column("h2").view(np.uint64))
        records = np.zeros(table.num_rows, RECORD)
        records["fingerprint"][number] = fingerprints(column("h1"))
        for name in ("shard", "place", "n", "start"):
            records[name][number] = column(name)
        head = held.to_bytes()
        _put(bucket_file(store, key[0].as_py()), iter([struct.pack("<2q", len(head), len(records)), head, records.tobytes()]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([table.num_rows], pa.int64())})

    return slots.select("bucket", "h1", "h2", "shard", "place", "n", "start").groupBy("bucket").applyInArrow(run, "bucket int, keys long")


def write(docs: DataFrame, tokenizer: str, store: str, end: int = END, shard: int = SHARD, keys: int = KEYS) -> TokenStore:
    """Encode the documents into a store at a URI that the driver and all executors see."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    top = max([end, *Tokenizer.from_file(tokenizer).get_vocab(True).values()])
    width = 2 if top < 1 << 16 else 4
    _encoded(docs, store, tokenizer, width, end, shard).write.parquet(f"{store}/entries")
    entries = spark.read.parquet(f"{store}/entries")
    slots = _keyed(entries)
    n = entries.count()
    meta = {"width": width, "end": end, "documents": n, "buckets": max(1, -(-n // keys))}
    slots.select("doc_id", "nth").write.parquet(f"{store}/keys")
    _indexed(_bucketed(slots, meta["buckets"]), store).write.parquet(f"{store}/buckets")
    _put(f"{store}/store.json", iter([json.dumps(meta).encode()]))
    return TokenStore(store)


class Bucket:
    """The index of a bucket: its hash in memory, its records in the file."""

    def __init__(self, store: str, n: int):
        fs, path = _open(bucket_file(store, n))
        self.file = fs.open_input_file(path) if fs.get_file_info(path).type != pa.fs.FileType.NotFound else None  # a bucket may have no keys
        if self.file:
            head, self.keys = struct.unpack("<2q", self.file.read_at(16, 0))
            self.held, self.first = PerfectHash.from_bytes(self.file.read_at(head, 16)), 16 + head

    def find(self, h1: np.ndarray, h2: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(found, records); whole reads all records at once, else one for each key."""
        if not self.file:
            return np.zeros(len(h1), bool), np.zeros(len(h1), RECORD)
        number = self.held(h2.view(np.uint64))
        safe, size = np.maximum(number, 0), RECORD.itemsize
        if whole:
            records = np.frombuffer(self.file.read_at(self.keys * size, self.first), RECORD)[safe]
        else:
            records = np.concatenate([np.frombuffer(self.file.read_at(size, self.first + size * int(i)), RECORD) for i in safe])
        return (number >= 0) & (records["fingerprint"] == fingerprints(h1)), records


class TokenStore:
    """A written store; get() reads one document, read() many by Spark."""

    def __init__(self, store: str):
        self.store = store
        fs, path = _open(f"{store}/store.json")
        with fs.open_input_file(path) as f:
            self.meta = json.loads(f.read())
        self.bucket = lru_cache(64)(lambda n: Bucket(store, n))

    def get(self, doc_id, nth: int = 0) -> np.ndarray | None:
        """The ids of a document, or None for a key that the store does not have."""
        h1, h2 = (np.array([h], np.uint64).view(np.int64) for h in hashes_of(doc_id, nth))
        found, records = self.bucket(int(h1[0]) % self.meta["buckets"]).find(h1, h2, whole=False)
        if not found[0]:
            return None
        width, (r,) = self.meta["width"], records
        fs, path = _open(shard_file(self.store, int(r["shard"])))
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_at(int(r["n"]) * width, int(r["place"]) * width), f"<u{width}").astype(np.uint32)

    def keys(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.store}/keys")

    def find(self, keys: DataFrame) -> DataFrame:
        """Keys (doc_id, nth) with their records (shard, place, n, start), by the index; keys that the store does not have are left out."""
        store = self.store
        kind = keys.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                bucket, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                for rows in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                    if not len(rows):
                        continue
                    if held is None or held[0] != bucket[rows[0]]:
                        held = int(bucket[rows[0]]), Bucket(store, int(bucket[rows[0]]))
                    found, records = held[1].find(h1[rows], h2[rows])
                    at = pa.array(rows[found])
                    columns = [b.column(0).take(at), b.column(1).take(at), *(pa.array(records[c][found].astype(np.int64)) for c in ("shard", "place", "n", "start"))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "nth", "shard", "place", "n", "start"])

        by = _bucketed(keys.select("doc_id", F.col("nth").cast("long").alias("nth")), self.meta["buckets"]).select("doc_id", "nth", "bucket", "h1", "h2")
        return by.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"doc_id {kind}, nth long, shard long, place long, n long, start long")

    def read(self, keys: DataFrame, digest: bool = False) -> DataFrame:
        """(doc_id, nth, start, n_tokens, ids) of keys, or with digest the crc32 of the ids as four-byte numbers, ids_crc32, in place of ids.

        Keys go to the tasks by shard and place, so that a shard is read once and in order."""
        store, width = self.store, self.meta["width"]
        kind = keys.schema["doc_id"].dataType.simpleString()
        last = "ids_crc32 long" if digest else "ids array<int>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, f, span, at = None, None, np.empty(0, np.uint32), 0
            for b in batches:
                shard, place, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                out = []
                for s, p, m in zip(shard.tolist(), place.tolist(), n.tolist()):
                    if s != number:
                        fs, path = _open(shard_file(store, s))
                        number, f, span, at = s, fs.open_input_file(path), np.empty(0, np.uint32), 0
                    if p < at or p + m > at + len(span):
                        span, at = np.frombuffer(f.read_at(max(m, SPAN) * width, p * width), f"<u{width}").astype("<u4"), p
                    part = span[p - at : p - at + m]
                    out.append(zlib.crc32(part.tobytes()) if digest else part.astype(np.int32))
                columns = [b.column(0), b.column(1), b.column(5), b.column(4), pa.array(out, pa.int64() if digest else pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "nth", "start", "n_tokens", last.split()[0]])

        found = self.find(keys).repartition("shard").sortWithinPartitions("shard", "place")
        return found.mapInArrow(run, f"doc_id {kind}, nth long, start long, n_tokens long, {last}")


def written_and_read(docs: DataFrame, tokenizer: str, end: int = END, **options) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids_crc32) of each document: a store is written to the shared folder and read back by its index."""
    spark = docs.sparkSession
    store = write(docs, tokenizer, shared_dir(spark), end, **options)
    return store.read(store.keys(spark), digest=True)
