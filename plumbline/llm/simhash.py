"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints within 4 of 64 bits (`near_duplicates`). The 64 bits fall into three blocks of 21 or 22 bits. If two
fingerprints differ in at most 4 bits, some block differs in at most 1, and some pair of blocks in at most 2
together. Each block, padded to 23 bits, is covered by the binary Golay code: every point has exactly one codeword
within 3 bits. Codewords are the anchors; the codeword nearest to a block is its home. A fingerprint is replicated
to every anchor within covering radius plus the block's share of the distance, and two fingerprints that are close
in a block meet at the home of either. Only there are they compared, over all 64 bits. So no link is lost and no
bucket or candidate is capped.

* Up to PRODUCT_FROM distinct fingerprints, anchors are single codewords: 3 x 4,096 anchors, 16 replicas.
* Beyond, anchors are pairs of codewords of two blocks: 3 x 2^24 anchors, 183 replicas. There each anchor stays
  small: homes times visitors are the square of the fingerprints divided by 2^24, not by 2^12. Both find the same links.

Texts with a Jaccard similarity of 0.8 or more of five-word shingles (`similar_groups`, `keep_one`). Their
fingerprints differ in 15 % of the bits or less, on average over hashes, which 4 of 64 bits would mostly miss. So
these fingerprints have WIDE words of 64 bits, over the set of shingles; each of BLOCKS_WIDE blocks of 23 bits has
anchors as above, with replicas within one bit more than the covering radius. A pair at 0.8 meets in a block with a
chance of 0.39, so 16 blocks lose 0.03 % of such pairs, and fewer of closer ones. Texts that meet and differ in at
most FAR of 192 bits (4 standard deviations above the mean at 0.8) belong to one candidate group; the anchors give
spanning edges of these groups, never pairs. A text of a large group meets that group at most of its anchors, and each
would give its edge again; so the texts that meet at the homes of the first HOMES blocks are joined before, and all
anchors only give edges between what these have left apart. Within a group the exact similarities decide: its sets are compared in
blocks of SETS by SETS, each block a cell of its own, which again gives spanning edges of what is similar.

Equal fingerprints (or sets) are one node, so copies cost nothing after the first aggregate. An anchor with many
nodes is cut into a grid of cells of bounded size: homes by row, visitors by column, each cell a group of its own.

Null and empty texts have no shingle and fingerprint zero, which links like any other. Equal ids are kept
as separate rows; a null id is larger than any. Repeated rows (equal id and text) are all reported by
`near_duplicates`, and `keep_one` keeps one of them. Extra columns pass through `keep_one` unchanged, whatever their
names, and are ignored elsewhere. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, small_batches, text_bytes
from plumbline.llm.graph import components
from plumbline.llm.jaccard import WORDS as WORDS_WIDE
from plumbline.llm.jaccard import LEAST, OF, held_sets, node_of, shingles

SEED, WORDS, DISTANCE = 42, 4, 4
#: Generator of the binary Golay code (x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1) and its length; first bits and widths of the blocks.
GOLAY, LENGTH, BLOCKS = 0b110001110101, 23, ((0, 21), (21, 21), (42, 22))
#: Covering radius of the code.
RADIUS = 3
#: Most homes or visitors in a cell; distinct fingerprints from which anchors are pairs of codewords.
CELL, PRODUCT_FROM = 4096, 2_000_000
#: Wide fingerprints: words of 64 bits, blocks that have anchors, words that are compared, most bits in which candidates differ there.
WIDE, BLOCKS_WIDE, COMPARED, FAR = 6, 16, 3, 50
#: Blocks whose homes join texts before the search over all anchors.
HOMES = 4
#: Most sets of a block within a candidate group, and distinct shingles that a block compares at once.
SETS, COLUMNS = 256, 1 << 15
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (2, WIDE), np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each document; one narrow pass over the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def syndrome(points: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit points by the code's generator: zero for codewords, equal for points of one coset."""
    rest = points.copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def cosets(radius: int) -> list[np.ndarray]:
    """For each syndrome, the error patterns of at most radius bits, the lightest first."""
    from itertools import combinations

    errors = np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(LENGTH), k)], np.int64)
    of = syndrome(errors)
    order = np.argsort(of, kind="stable")
    return np.split(errors[order], np.cumsum(np.bincount(of, minlength=2048))[:-1])


class Code:
    """For each syndrome the error patterns of at most radius bits, so that point ^ error are the anchors of a point."""

    def __init__(self, radius: int):
        table = cosets(radius)
        self.flat, self.sizes = np.concatenate(table), np.array([len(x) for x in table])
        self.first = np.cumsum(self.sizes) - self.sizes

    def replicas(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each replica, its anchor, the bits between them); a row's nearest anchor comes first."""
        s = syndrome(point)
        n = self.sizes[s]
        row = np.repeat(np.arange(len(point)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        error = self.flat[self.first[s[row]] + nth]
        return row, point[row] ^ error, np.bitwise_count(error)


def _points(fp: np.ndarray) -> list[np.ndarray]:
    bits = fp.view(np.uint64)
    return [(bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in BLOCKS]


def anchored(nodes: DataFrame, distance: int = DISTANCE, product: bool = False) -> DataFrame:
    """(anchor, fp, home) of each fingerprint: every anchor within covering radius plus the share of the distance."""
    share = (2 * distance if product else distance) // len(BLOCKS)

    def single(fp: np.ndarray, code: Code) -> Iterator[tuple]:
        for block, point in enumerate(_points(fp)):
            row, anchor, off = code.replicas(point)
            yield row, anchor << 2 | block, off <= RADIUS

    def double(fp: np.ndarray, code: Code) -> Iterator[tuple]:
        points = _points(fp)
        for one, two in ((0, 1), (0, 2), (1, 2)):
            row, a, off = code.replicas(points[one])
            row2, b, off2 = code.replicas(points[two][row])  # of each replica of the first block
            extra = np.maximum(off[row2].astype(np.int64) - RADIUS, 0) + np.maximum(off2.astype(np.int64) - RADIUS, 0)
            near = extra <= share
            yield row[row2][near], (a[row2][near] << LENGTH | b[near]) << 2 | (one + two - 1), (off[row2][near] <= RADIUS) & (off2[near] <= RADIUS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(RADIUS + share)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for row, anchor, home in (double if product else single)(fp, code):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _cell(fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, least fp of its component) among a cell's homes and visitors."""
    nodes, back = np.unique(fp, return_inverse=True)
    h, v = np.unique(back[home]), np.unique(back[~home])
    label = np.arange(len(nodes))
    if not len(h) or not len(v):
        return nodes[:0], nodes[:0]
    bits, moved = nodes.view(np.uint64), True
    while moved:
        was = label.copy()
        for i in range(0, len(h), 256):
            rows = h[i : i + 256]
            near = np.bitwise_count(bits[rows][:, None] ^ bits[v][None, :]) <= distance
            r, c = np.nonzero(near)
            if (v[c] == rows[r]).all():
                continue  # each only near itself
            np.minimum.at(label, rows[r], label[v[c]])
            np.minimum.at(label, v[c], label[rows[r]])
        label = label[label]
        moved = bool((label != was).any())
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def by_cell(rows: DataFrame, cell: int, find, schema: str, wide: DataFrame | None = None) -> DataFrame:
    """find(table of one cell) over the cells of rows (anchor, home, ...); an anchor with many rows is a grid of cells.

    wide, if given, is what the rows are counted from, once more.
    """
    most = (rows if wide is None else wide).groupBy("anchor").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")).filter("parts > 1")
    names = [c for c in rows.columns if c not in ("anchor", "home")]
    placed = rows.join(most, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Homes of one anchor are compared with each other too, so each is also a visitor.
    placed = placed.withColumn("home", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    own, every = F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    placed = placed.withColumn("r", F.explode(F.when(F.col("home"), F.array(own)).otherwise(every)))
    placed = placed.withColumn("c", F.explode(F.when(F.col("home"), every).otherwise(F.array(own))))
    return in_cells(placed.select("anchor", "r", "c", "home", *names), find, schema)


def in_cells(placed: DataFrame, find, schema: str) -> DataFrame:
    """find(columns of one cell) over the cells (anchor, r, c) of placed rows; one cell at a time is held."""
    names = [c for c in placed.columns if c not in ("anchor", "r", "c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            a, r, c = (t.column(k).to_numpy() for k in ("anchor", "r", "c"))
            at = np.flatnonzero((a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1
            held = {k: t.column(k).to_numpy() for k in names}
            for i, j in zip([0, *at.tolist()], [*at.tolist(), len(a)]):
                yield from find({k: v[i:j] for k, v in held.items()})

        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            last = np.flatnonzero(np.logical_or.reduce([t.column(k).to_numpy() != t.column(k)[-1].as_py() for k in ("anchor", "r", "c")]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from _joined(found(t.slice(0, done)))
            rest = t.slice(done).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from _joined(found(rest))

    return placed.repartition("anchor", "r", "c").sortWithinPartitions("anchor", "r", "c").mapInArrow(run, schema)


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The (u, v) of many cells as batches of a bounded size."""
    us, vs, n = [], [], 0
    for u, v in parts:
        us.append(u)
        vs.append(v)
        n += len(u)
        if n > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
            us, vs, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def links(spark: SparkSession, nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL, product_from: int = PRODUCT_FROM) -> DataFrame:
    """Edges (u, v) that span the components of fingerprints within the distance; never a cell's pairs."""
    rows = cut(spark, anchored(nodes, distance, nodes.count() > product_from))
    return by_cell(rows, cell, lambda t: [_cell(t["fp"], t["home"], distance)], "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, n: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable through links."""
    spark = docs.sparkSession
    fps = cut(spark, fingerprints(docs, n, seed))
    nodes = cut(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(spark, links(spark, nodes, distance))
    named = nodes.join(of, nodes.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = cut(spark, named)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def wide_fingerprint(held: np.ndarray) -> np.ndarray:
    """WIDE words of 64 bits over a set of hashes: each bit is the majority of the set's."""
    ones = np.zeros((WIDE, 8, 8), np.int64)  # word, bit of a byte, byte
    for i in range(0, len(held), 255):  # a byte of a lane holds the count of 255 hashes
        h = (held[i : i + 255, None] ^ _XOR) * _TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        for bit in range(8):
            ones[:, bit] += (h >> np.uint64(bit) & _LANES).sum(axis=0).view(np.uint8).reshape(WIDE, 8)
    return np.packbits((2 * ones > len(held)).reshape(WIDE, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def row_key() -> Column:
    """Names a row by its id and text; null and empty texts have no word and count as equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")))


def signatures(docs: DataFrame, n: int = WORDS_WIDE) -> DataFrame:
    """(doc_id, key, node, fp) of each document; node is a hash of its set of shingles, fp its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_buffer().to_pybytes(), n) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "key", "node", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, node long, fp array<bigint>")


def anchored_wide(nodes: DataFrame, blocks: int = BLOCKS_WIDE, radius: int = RADIUS + 1) -> DataFrame:
    """(anchor, node, f0.., home) of each node (node, fp) at the anchors within the radius, of the first blocks."""
    names = [f"f{k}" for k in range(COMPARED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(radius)
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            words = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            points = bits[:, : blocks * LENGTH].reshape(len(node), blocks, LENGTH).astype(np.int64) @ (1 << np.arange(LENGTH))
            for block in range(blocks):
                row, anchor, off = code.replicas(points[:, block])
                columns = [anchor * BLOCKS_WIDE + block, off <= RADIUS, node[row], *(words[row, k] for k in range(COMPARED))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["anchor", "home", "node", *names])

    return nodes.select("node", "fp").mapInArrow(run, "anchor long, home boolean, node long, " + ", ".join(f"{k} long" for k in names))


def _spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(i, least of its component) of those of n numbers that pairs link to a smaller one."""
    label, moved = np.arange(n), bool(pairs)
    while moved:
        was = label.copy()
        for a, b in pairs:
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
        label = label[label]
        moved = bool((label != was).any())
    far = np.flatnonzero(label != np.arange(n))
    return far, label[far]


def _near(t: dict[str, np.ndarray], far: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span what is near among a cell's homes and visitors."""
    home = t["home"]
    if not home.any() or home.all():
        return []
    nodes, back = np.unique(t["node"], return_inverse=True)
    words = np.stack([t[f"f{k}"] for k in range(COMPARED)], axis=1).view(np.uint64)
    h, v, pairs = np.flatnonzero(home), np.flatnonzero(~home), []
    for i in range(0, len(h), 512):
        rows = h[i : i + 512]
        off = sum(np.bitwise_count(words[rows, k][:, None] ^ words[v, k][None, :]).astype(np.int16) for k in range(COMPARED))
        a, b = np.nonzero(off <= far)
        a, b = back[rows[a]], back[v[b]]
        # One pair of nodes may meet twice, as home and visitor of each other; a node meets itself.
        pairs.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1))
    u, w = _spanning(len(nodes), [(p[0], p[1]) for p in pairs if p.shape[1]])
    return [(nodes[u], nodes[w])] if len(u) else []


def _alike(t: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span what is similar between the sets of a block (home) and those of another, or among those of one."""
    node, home, sets = t["node"], t["home"], t["held"]
    h = np.flatnonzero(home)
    v = h if home.all() else np.flatnonzero(~home)
    if len(sets) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    of, column, shared = of[order], column[order], np.zeros((len(h), len(v)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (low, low + COLUMNS))
        has = np.zeros((len(sets), int(column[j - 1]) - low + 1), np.float32)
        has[of[i:j], column[i:j] - low] = 1
        shared += has[h] @ has[v].T
    total = sizes[h][:, None] + sizes[v][None, :]
    a, b = np.nonzero((OF * shared >= LEAST * (total - shared)) & (shared > 0))
    a, b = h[a], v[b]
    u, w = _spanning(len(node), [(a[a != b], b[a != b])])
    return [(node[u], node[w])] if len(u) else []


def similar_groups(docs: DataFrame, cell: int = CELL, n: int = WORDS_WIDE, sets: int = SETS) -> DataFrame:
    """(doc_id, key, node, root): root is common to the documents of a group that similar texts link."""
    spark = docs.sparkSession
    signed = cut(spark, signatures(docs, n))
    nodes = cut(spark, signed.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp")))
    homes = anchored_wide(nodes, HOMES, RADIUS)
    joined = components(spark, by_cell(homes, cell, lambda t: _near(t, FAR), "u long, v long", homes).distinct())
    labelled = cut(spark, nodes.join(joined, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("label")))
    rows = anchored_wide(labelled.select(F.col("label").alias("node"), "fp"))
    near = by_cell(rows, cell, lambda t: _near(t, FAR), "u long, v long", rows).distinct()
    near = near.unionByName(labelled.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")))
    of = components(spark, near)  # of all but the least node of each group
    groups = of.select("node", F.col("component").alias("anchor")).unionByName(of.select(F.col("component").alias("node"), F.col("component").alias("anchor")).distinct())
    groups = cut(spark, groups)
    held = held_sets(docs.select(row_key().alias("key"), "text"), nodes.select("node", "key").join(groups, "node"), n)
    # Each set goes to the block of its own and once to every other block of its group.
    parts = groups.groupBy("anchor").agg(F.ceil(F.count("*") / sets).cast("int").alias("parts"))
    placed = held.join(parts, "anchor").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("anchor", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"), (F.col("own") <= F.col("other")).alias("home"), "node", "held")
    of = components(spark, in_cells(placed, _alike, "u long, v long").distinct())
    named = nodes.join(of.select("node", F.col("component").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "key", "node").join(cut(spark, named), "node").select("doc_id", "key", "node", "root")


def keep_one(docs: DataFrame, cell: int = CELL, n: int = WORDS_WIDE) -> DataFrame:
    """One document of each group of similar texts, the one with the least doc_id (on ties, the least key); own columns stay."""
    grouped = cut(docs.sparkSession, similar_groups(docs, cell, n))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    first = grouped.groupBy("root").agg(F.min(order)["key"].alias("kept"))
    lost = grouped.join(first, "root").filter("key <> kept").select("key").distinct().withColumn("lost", F.lit(True))
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(lost, "key", "left").filter("lost IS NULL")
    # Repeated rows have one key.
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("key"))).filter("nth = 1").select("row.*")
