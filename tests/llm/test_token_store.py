"""The token store against plain encoding, and the perfect hash."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import token_store
from plumbline.llm.common import shared_dir
from plumbline.llm.perfect_hash import PerfectHash
from tests.llm import fixtures

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain(texts: list[str | None]) -> list[list[int]]:
    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_keys_get_the_numbers_from_zero():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        held, numbers = PerfectHash.build(keys)
        assert sorted(numbers) == list(range(len(keys)))
        again = PerfectHash.from_bytes(held.to_bytes())
        assert np.array_equal(again(keys), numbers)
    assert len(held.words) * 64 < 4 * len(keys)
    equal = np.array([7, 9, 7, 11, 7], np.uint64)
    held, numbers = PerfectHash.build(equal)
    assert sorted(numbers) == list(range(5)) and numbers[0] < numbers[2] < numbers[4]


def test_store_equals_plain_encoding(spark):
    rows = [*fixtures.documents(), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (3, "another text of 3", "en", "a", 1)]
    docs = fixtures.table(spark, rows, clashing=True)
    store = token_store.write(docs, WORDS, shared_dir(spark), shard=4000, keys=8)
    assert store.meta["width"] == 2 and store.meta["buckets"] > 3
    found = store.read(store.keys(spark)).orderBy("start").collect()
    assert len(found) == len(rows)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    start = 0
    want = {}
    for (i, text, *_), x in zip(rows, plain([r[1] for r in rows])):
        want.setdefault(i, []).append(x)
    nth = {}
    for r in found:
        assert (r.start, r.n_tokens, r.nth) == (start, len(r.ids), nth.get(r.doc_id, 0))
        nth[r.doc_id] = r.nth + 1
        want[r.doc_id].remove(r.ids)
        start += r.n_tokens
        assert store.get(r.doc_id, r.nth).tolist() == r.ids
    assert not any(want.values())
    assert store.get(10_000) is None and store.get(3, 9) is None
    absent = spark.createDataFrame([(10_000 + i, 0) for i in range(500)] + [(5, 0)], "doc_id long, nth long")
    assert [r.doc_id for r in store.find(absent).collect()] == [5]


def test_equal_ids_part_into_shards(spark):
    rows = [(7, fixtures.prose(1, 50), "en", "a", 1)] * 40 + [(i, fixtures.prose(i, 20), "en", "a", 1) for i in range(15)]
    store = token_store.write(fixtures.table(spark, rows), WORDS, shared_dir(spark), shard=3000, keys=16)
    found = store.find(store.keys(spark)).collect()
    assert sorted((r.doc_id, r.nth) for r in found) == sorted([(i, 0) for i in range(15)] + [(7, k) for k in range(1, 41)])
    assert len({r.shard for r in found if r.doc_id == 7}) > 1


def test_query_columns_and_no_documents(spark):
    rows = fixtures.documents()
    out = token_store.written_and_read(fixtures.table(spark, rows), WORDS).collect()
    crc = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in plain([r[1] for r in rows]))
    assert sorted(r.ids_crc32 for r in out) == crc
    assert token_store.written_and_read(fixtures.table(spark, rows).limit(0), WORDS).count() == 0
