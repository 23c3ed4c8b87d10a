"""Sets of word shingles, for the exact check of similarities that a search has found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from plumbline.llm.common import cut, small_batches, text_bytes

SEED, WORDS = 42, 5
#: The least similarity, LEAST / OF.
LEAST, OF = 4, 5


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    hashes = [h(b" ".join(words[i : i + n]), SEED) for i in range(max(1, len(words) - n + 1))] if words else []
    return np.unique(np.array(hashes, np.uint64))


def node_of(held: np.ndarray) -> int:
    """A signed hash of the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).view(np.int64))


def held_sets(texts: DataFrame, nodes: DataFrame, n: int = WORDS) -> DataFrame:
    """The rows of nodes (node, key, ...) with the sets of their texts (key, text), in place of the key; written once."""
    spark = texts.sparkSession
    small_batches(spark)
    rest = [c for c in nodes.columns if c != "key"]
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingles(t.as_buffer().to_pybytes(), n).view(np.int64) for t in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(held, pa.list_(pa.int64()))], [*rest, "held"])

    chosen = texts.select("key", text_bytes().alias("text")).join(nodes, "key").dropDuplicates(["node"])
    return cut(spark, chosen.select(*rest, "text").mapInArrow(run, f"{kinds}, held array<bigint>"))
