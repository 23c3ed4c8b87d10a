"""The corpus pipeline end to end, and rows that share or lack their id."""

from __future__ import annotations

import shutil
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import packing, simhash, url_filter
from tests.llm import fixtures

SMALL = "/root/testdata/sf0.001"


def well_packed(rows, size=2048):
    """No sequence is longer than size, and its pieces lie in it without gaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, SMALL).collect()
    well_packed(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = sorted({r["doc_id"] for r in rows})
    assert set(kept) <= set(texts) and len(kept) > len(texts) / 3
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for found in pieces.values():  # a document is taken as often as the mixture says, each time with all of its pieces
        one = sorted(set(found))
        assert [p for p, *_ in one] == list(range(len(one))) and len(found) % len(one) == 0 and len(found) <= 3 * len(one)
        assert [s for _, s, _ in one] == [sum(x[2] for x in one[:k]) for k in range(len(one))]
    sets = {i: shingles(texts[i]) for i in kept}
    close = [(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not close


def test_no_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    shutil.copy(f"{SMALL}/labels.parquet", tmp_path / "labels.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0


ODD = [(None, "some words of a text without an id", "en", "a", 1), (None, None, None, None, None), (7, "one two three four five six", "en", "a", 1), (7, "quite another text here, seven words", "en", "a", 1), (7, "one two three four five six", "en", "b", 1), (9, "one two three four five six", "en", "b", 1)]


def test_null_and_shared_ids(spark):
    docs = fixtures.table(spark, ODD)
    found = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["doc_id"] == 9} == {7}
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "7", "9", "None", "None"]
    well_packed(rows)


def test_no_captures_and_no_list(spark):
    pages = spark.createDataFrame([(1, "https://a.example.org/x", ""), (2, None, ""), (None, "http://b.net", "")], "page_id long, url string, html string")
    captures = url_filter.captures_of(pages)
    listed = url_filter.list_of(captures)
    assert url_filter.as_of(captures.limit(0), listed).count() == 0
    rows = url_filter.as_of(captures, listed.limit(0)).collect()
    assert len(rows) == 3 and not any(r["listed"] for r in rows)
    assert url_filter.captures_of(pages.filter(F.lit(False))).count() == 0
