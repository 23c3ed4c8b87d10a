"""Hard negatives: rows of another label that score just under an anchor's positives.

Components become integers, floor(SCALE x), and a score is the integer inner product with the anchor. An anchor's positives are its
first rows of the same label; for each of them, the negatives are the first rows of other labels with a score between LOW and HIGH
hundredths of the positive's.

1. Blocks. Rows are dealt by ranges of (label, place on a Hilbert curve through all dimensions, id) and written as Parquet, a row for
   each block of BLOCK vectors of one label, with the least and greatest component of each dimension (its zone map). RUN
   neighbouring blocks are a run, with a zone map too. A run's own anchors are scored against it at once: their fifth best score in it is
   a floor for what a positive can be.
2. Bounds. By interval arithmetic, an anchor's scores in a zone lie between the sums over the dimensions of the lesser and the greater
   of (component x least, component x greatest). Anchors, packed by run, meet the zone maps of all runs, packed in lanes of LANE
   runs; a run has to be read for a pack if the bounds of one of its anchors reach its floor (positives) or overlap one of its windows
   (negatives). This is a stated query set against all rows in blocks; no pair of rows is formed.
3. Reading. Each pack and the blocks of each run it has to read meet in one group of bounded size. Blocks are judged once more by
   their own zone maps, then scored by one matrix product, and each window sends on its first rows only. A ranking limited to
   five rows, before and after the shuffle, leaves the result.

Zones cut off much where vectors stand in clusters. For vectors without any, 64 dimensions leave nearly every zone within the
bounds; then all blocks are read, in products of whole blocks, and the result is the same.

Groups stay bounded: a run has at most RUN x BLOCK rows, also of anchors, and a label or curve cell with a third of all rows parts into as
many runs as it needs, by id. Products are exact: in doubles while sums stay below 2^53, else in longs.

Rows with a null label, a null vector, or a null or non-finite component take no part. Scaled components beyond COMPONENT count as
COMPONENT, so scores fit a long. Shorter vectors count as followed by zeros. Rows equal in id, label and vector count once; rows
that share an id but differ are rows of their own, never each other's positives or negatives. A null id comes last among ties and is no anchor in the query.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, small_batches

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Vectors of a block, blocks of a run, runs of a lane, anchors of a pack, bits of a curve dimension, the largest component.
BLOCK, RUN, LANE, PACK, BITS, COMPONENT = 1024, 16, 256, 512, 2, 1 << 24
#: Quartiles of the normal distribution, in standard deviations: they part a dimension into cells of the curve.
QUARTILES = (-0.6745, 0.0, 0.6745)
#: Scores that are held at once.
SCORES = 4_000_000
NONE = np.iinfo(np.int64).max
#: Blocks or packs of a run that have numbers; more than it can have.
MOST = 1 << 15


def vectors_of(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, anchor, v) of the rows that take part, v in integers; from (vec_id, label, embedding, anchor)."""
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-COMPONENT))), F.lit(float(COMPONENT)))).cast("int"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.filter(fit).filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"), whole.alias("v"))


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places of the rows (rows x dimensions, each of bits) on a Hilbert curve, as bytes whose order is the curve's.

    From the highest bit down, each dimension turns the lower bits of the curve; a last pass undoes the Gray code.
    """
    x = cells.astype(np.uint32).T.copy()
    n, top = len(x), np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        below = np.uint32(q - 1)
        for i in range(n):
            odd = (x[i] & q) != 0
            swap = np.where(odd, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(odd, below, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    planes = [((x >> np.uint32(b)) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T, axis=1)
    return [r.tobytes() for r in packed]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, followed by zeros up to the width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def placed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Vectors with their place on the curve, written once; and the number of dimensions."""
    spark = vectors.sparkSession
    by = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    shape = {r["at"]: (r["mean"], r["spread"]) for r in by.collect()}  # a row for each dimension
    width = max(1, len(shape))
    edges = np.array([[m + q * s for q in QUARTILES] for m, s in (shape.get(i, (0, 0)) for i in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(3), width)
            place = hilbert((v[:, :, None] > edges).sum(2))
            data = [r.tobytes() for r in v.astype("<i4")]
            # Equal rows of a batch go on once; the rest meet when blocks are made.
            at = list({key: i for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), data))}.values())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(3)), *(pa.array([x[i] for i in at], pa.binary()) for x in (place, data))], ["vec_id", "label", "anchor", "place", "v"])

    return cut(spark, vectors.select("vec_id", "label", "anchor", "v").mapInArrow(run, "vec_id long, label long, anchor boolean, place binary, v binary")), width


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (a x b) of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _bytes(a: np.ndarray) -> bytes:
    return a.astype("<i4").tobytes()


def _rows(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


#: part: the number of a block, or of a pack. kind 0: a block, with ids, v and its zone (low, high); 1: a run's zone; 2: a pack of anchors with
#: ids (NONE for a null one), v, and floors, the least scores that may be among their positives.
BLOCKS = "kind int, run long, part long, label long, ids binary, v binary, low binary, high binary, floors binary"
_SCHEMA = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCKS.split(", ")])


def of_run(number: int, label: int, ids: list, anchors: list, data: list, width: int, positives: int, block: int) -> pa.RecordBatch:
    """A run's rows of the table of blocks."""
    v, ids = _rows(b"".join(data), width), np.array([NONE if i is None else i for i in ids], np.int64)
    at = np.flatnonzero(np.array(anchors, bool))
    floors = np.full(len(at), -NONE, np.int64)
    step = max(1, SCORES // len(ids))
    for k in range(0, len(at), step):
        for row, (scores, own) in enumerate(zip(product(v[at[k : k + step]], v), ids[at[k : k + step]])):
            others = scores[ids != own]
            if len(others) >= positives:
                floors[k + row] = np.partition(others, len(others) - positives)[len(others) - positives]
    first, zone = number * MOST, {"low": _bytes(v.min(0)), "high": _bytes(v.max(0))}
    rows = [dict(kind=1, part=0, **zone)]
    for n, k in enumerate(range(0, len(ids), block)):
        part = v[k : k + block]
        rows.append(dict(kind=0, part=first + n, ids=ids[k : k + block].tobytes(), v=_bytes(part), low=_bytes(part.min(0)), high=_bytes(part.max(0))))
    for n, k in enumerate(range(0, len(at), PACK)):
        mine = at[k : k + PACK]
        rows.append(dict(kind=2, part=first + n, ids=ids[mine].tobytes(), v=_bytes(v[mine]), floors=floors[k : k + PACK].tobytes()))
    return pa.RecordBatch.from_pylist([dict(run=number, label=label, **r) for r in rows], _SCHEMA)


def blocks_of(rows: DataFrame, width: int, positives: int, block: int, run_blocks: int) -> DataFrame:
    """The blocks, the zones of their runs and the packs of their anchors, written once."""
    size = block * run_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId() << 24, None
        label, held = None, ([], [], [])
        for b in batches:
            for i, of, anchor, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (i, of, x) == last:  # a repeated row
                    continue
                last = (i, of, x)
                if held[0] and (of != label or len(held[0]) == size):
                    yield of_run(number, label, *held, width, positives, block)
                    number, held = number + 1, ([], [], [])
                label = of
                for column, value in zip(held, (i, anchor, x)):
                    column.append(value)
        if held[0]:
            yield of_run(number, label, *held, width, positives, block)

    keys = ("label", "place", "vec_id", "v")
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // size)), *keys).sortWithinPartitions(*keys)
    return cut(rows.sparkSession, dealt.select("vec_id", "label", "anchor", "v").mapInArrow(run, BLOCKS))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each row of a with any vector in each zone (rows of low and high)."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def to_read(packs: DataFrame, zones: DataFrame, width: int, same: bool, lane: int) -> DataFrame:
    """(pack, run): the runs, of the pack's label or of others, that may hold scores between an anchor's least and most."""
    lanes = max(1, -(-zones.count() // lane))
    rows = zones.groupBy(F.pmod(F.xxhash64("run"), F.lit(lanes)).cast("int").alias("lane")).agg(F.collect_list(F.struct("run", "label", "low", "high")).alias("zones"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, label, v, least, most, held in zip(*(b.column(k).to_pylist() for k in range(6))):
                held = [z for z in held if (z["label"] == label) is same]
                if not held:
                    continue
                low, high = (_rows(b"".join(z[k] for z in held), width) for k in ("low", "high"))
                below, above = bounds(_rows(v, width), low, high)
                hit = ((above >= _longs(least)[:, None]) & (below <= _longs(most)[:, None])).any(0)
                runs = [z["run"] for z, h in zip(held, hit) if h]
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(runs), pa.int64()), pa.array(runs, pa.int64())], ["pack", "run"])

    asked = packs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).join(rows, "lane")
    return asked.select("pack", "label", "v", "least", "most", "zones").mapInArrow(run, "pack long, run long")


def _scored(table: pa.Table, v: np.ndarray, least: np.ndarray, most: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, ids, scores) of the blocks whose zones reach into an anchor's bounds, a bounded number of scores at a time."""
    low, high = (_rows(b"".join(table.column(k).to_pylist()), width) for k in ("low", "high"))
    below, above = bounds(v, low, high)
    hit = (above >= least[:, None]) & (below <= most[:, None])
    chosen = np.flatnonzero(hit.any(0))
    if not len(chosen):
        return
    rows = _rows(b"".join(table.column("v")[int(k)].as_py() for k in chosen), width)
    ids = np.concatenate([_longs(table.column("ids")[int(k)].as_py()) for k in chosen])
    anchors = np.flatnonzero(hit.any(1))
    step = max(1, SCORES // len(ids))
    for k in range(0, len(anchors), step):
        some = anchors[k : k + step]
        yield some, ids, product(v[some], rows)


def _read(packs: DataFrame, pairs: DataFrame, blocks: DataFrame, carried: tuple[str, ...], run, schema: str) -> DataFrame:
    """Each pack meets the blocks of each run that it has to read, in a group of its own."""
    pairs = cut(pairs.sparkSession, pairs)
    left = pairs.join(packs.select("pack", *carried), "pack")
    right = pairs.select(F.col("pack").alias("of"), F.col("run").alias("at")).join(blocks.select(F.col("run").alias("at"), "ids", "v", "low", "high"), "at")
    return left.groupBy("pack", "run").cogroup(right.groupBy("of", "at")).applyInArrow(run, schema)


def _ids(a: np.ndarray) -> pa.Array:
    return pa.array(a, pa.int64(), mask=a == NONE)


def _best(rows: DataFrame, keys: tuple[str, ...], order: tuple, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def positives_of(packs: DataFrame, zones: DataFrame, blocks: DataFrame, width: int, k: int, lane: int) -> DataFrame:
    """(pack, nth, anchor_id, positive_id, score, rank): the first k other rows of each anchor's label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v, least = _longs(left.column("ids")[0].as_py()), _rows(left.column("v")[0].as_py(), width), _longs(left.column("least")[0].as_py())
        found = [(np.empty(0, np.int64),) * 3]
        for some, others, scores in _scored(right, v, least, np.full(len(v), NONE), width):
            for a, row in zip(some, scores):
                near = np.flatnonzero((row >= least[a]) & (others != ids[a]))
                near = near[first_rows(row[near], others[near], k)]
                found.append((np.full(len(near), a), others[near], row[near]))
        nth, other, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"pack": pa.array([left.column("pack")[0].as_py()] * len(nth), pa.int64()), "nth": pa.array(nth, pa.int64()), "anchor_id": _ids(ids[nth]), "positive_id": _ids(other), "score": pa.array(score, pa.int64())})

    pairs = to_read(packs, zones, width, True, lane)
    rows = _read(packs, pairs, blocks, ("ids", "v", "least"), run, "pack long, nth long, anchor_id long, positive_id long, score long")
    return _best(rows, ("pack", "nth"), (F.desc("score"), F.asc_nulls_last("positive_id")), k)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest n with low score <= 100 n <= high score."""
    return -(-low * score // 100), high * score // 100


def negatives_of(packs: DataFrame, zones: DataFrame, blocks: DataFrame, width: int, k: int, lane: int) -> DataFrame:
    """(pack, nth, place, anchor_id, positive_id, positive_score, negative_id, negative_score, rank); packs have their anchors' windows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = _longs(left.column("ids")[0].as_py()), _rows(left.column("v")[0].as_py(), width)
        least, most = (_longs(left.column(c)[0].as_py()) for c in ("least", "most"))
        windows: dict[int, list[dict]] = {}
        for w in left.column("windows")[0].as_py():
            windows.setdefault(w["nth"], []).append(w)
        columns: list[list] = [[] for _ in range(7)]
        for some, others, scores in _scored(right, v, least, most, width):
            for a, row in zip(some.tolist(), scores):
                near = np.flatnonzero((row >= least[a]) & (row <= most[a]) & (others != ids[a]))
                near = near[np.lexsort((others[near], -row[near]))]
                falling = -row[near]
                for w in windows.get(a, ()):
                    first, end = np.searchsorted(falling, -w["most"]), np.searchsorted(falling, -w["least"], "right")
                    for i in near[first : min(end, first + k)]:
                        for column, x in zip(columns, (a, w["place"], None if ids[a] == NONE else int(ids[a]), w["positive_id"], w["score"], None if others[i] == NONE else int(others[i]), int(row[i]))):
                            column.append(x)
        names = ("nth", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({"pack": pa.array([left.column("pack")[0].as_py()] * len(columns[0]), pa.int64()), **{n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}})

    pairs = to_read(packs, zones, width, False, lane)
    schema = "pack long, nth long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    rows = _read(packs, pairs, blocks, ("ids", "v", "least", "most", "windows"), run, schema)
    return _best(rows, ("pack", "nth", "place"), (F.desc("negative_score"), F.asc_nulls_last("negative_id")), k)


def with_windows(packs: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """Packs whose anchors have windows: least and most are the bounds of all windows of an anchor (none: least above most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["ids"]) // 8
                least, most, windows = np.full(n, NONE), np.full(n, -NONE), []
                for x in row.pop("found"):
                    a, z = window(x["score"], low, high)
                    if a <= z:
                        least[x["nth"]], most[x["nth"]] = min(least[x["nth"]], a), max(most[x["nth"]], z)
                        windows.append({**x, "least": a, "most": z})
                if windows:
                    yield pa.RecordBatch.from_pylist([row | {"least": least.tobytes(), "most": most.tobytes(), "windows": windows}], schema)

    whole = "nth long, place long, positive_id long, score long"
    fields = [pa.field(c.split()[0], pa.int64()) for c in whole.split(", ")]
    schema = pa.schema([("pack", pa.int64()), ("label", pa.int64()), *((c, pa.binary()) for c in ("ids", "v", "least", "most")), ("windows", pa.list_(pa.struct([*fields, pa.field("least", pa.int64()), pa.field("most", pa.int64())])))])
    by = positives.groupBy("pack").agg(F.collect_list(F.struct("nth", F.col("rank").cast("long").alias("place"), "positive_id", "score")).alias("found"))
    held = packs.join(by, "pack").select("pack", "label", "ids", "v", "found")
    return held.mapInArrow(run, f"pack long, label long, ids binary, v binary, least binary, most binary, windows array<struct<{whole.replace(' ', ':').replace(',:', ',')},least:long,most:long>>")


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK, run_blocks: int = RUN, lane: int = LANE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding, anchor: whether the row is one)."""
    spark = rows.sparkSession
    small_batches(spark)
    at, width = placed(vectors_of(rows, scale))
    table = blocks_of(at, width, positives, block, run_blocks)
    blocks, zones = table.filter("kind = 0"), table.filter("kind = 1").select("run", "label", "low", "high")
    packs = table.filter("kind = 2").select(F.col("part").alias("pack"), *(F.col(c).alias(c) for c in ("label", "ids", "v")), F.col("floors").alias("least"))
    top = np.array([NONE], "<i8").tobytes()
    packs = packs.withColumn("most", F.expr(f"unhex(repeat('{top.hex()}', CAST(length(ids) / 8 AS INT)))"))
    found = cut(spark, positives_of(packs, zones, blocks, width, positives, lane))
    asked = cut(spark, with_windows(packs, found, low, high))
    out = negatives_of(asked, zones, blocks, width, negatives, lane)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
