from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from plumbline.llm import mixing, packing, simhash
from tests.llm.fixtures import documents, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("clashing", [False, True])
def test_mix_follows_the_targets(spark, clashing):
    rows = documents()
    got = mixing.mix(table(spark, rows, clashing)).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), sum(by.values())
    while True:  # reshare the excess until none is above
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * by[s]
            full.add(s)
            left -= 3 * by[s]
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        rate = target[source[r["doc_id"]]] / by[source[r["doc_id"]]]
        assert r["copies"] in ((0,) if not r["size"] else (int(rate + 1e-9), int(rate + 1e-9) + 1))


@pytest.mark.parametrize("clashing", [False, True])
def test_mixture_repeats_rows_and_keeps_columns(spark, clashing):
    docs = table(spark, clashing=clashing)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixture(table(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.mix(table(spark, [(1, None, None, None, None)])).collect()] == [0]


def _fingerprint(text: str | None) -> int:
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(of: dict[int, int], distance: int = 4) -> dict[int, int]:
    ids, root = sorted(of), {i: i for i in of}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (of[i] ^ of[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("clashing", [False, True])
def test_simhash_equals_all_pairs(spark, clashing):
    rows = documents()
    of = {r[0]: _fingerprint(r[1]) for r in rows}
    want = _components(of)
    got = simhash.near_duplicates(table(spark, rows, clashing)).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    assert sorted((r["doc_id"], r["f"], r["component_id"]) for r in got) == sorted((r[0], f"{of[r[0]]:016x}", want[r[0]]) for r in rows)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_finds_chains_in_split_cells(spark):
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(0, 2**63, 60, dtype=np.uint64)]
    for f in fps[:8]:  # chains of close fingerprints in random blocks
        for _ in range(25):
            for b in r.choice(64, 4, replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    of = dict(enumerate(fps))
    nodes = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in set(fps)], "fp long")
    for cell, product_from in ((8, 10**6), (4096, 10**6), (8, 0), (4096, 0)):  # single codewords, pairs of codewords
        edges = simhash.links(spark, nodes, cell=cell, product_from=product_from)
        named = {r["node"] % 2**64: r["component"] % 2**64 for r in simhash.components(spark, edges).collect()}
        groups = defaultdict(set)
        for i, root in _components(of).items():
            groups[root].add(of[i])
        for members in groups.values():
            assert len({named.get(f, f) for f in members}) == 1
        assert len({named.get(f, f) for f in set(fps)}) == len(groups)


def test_any_pair_within_four_bits_meets_at_an_anchor(spark):
    r = np.random.default_rng(8)
    fps = r.integers(0, 2**63, 300).astype(np.uint64)
    near = fps.copy()
    for i in range(len(fps)):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    for product in (False, True):
        homes: dict[int, set] = {}
        nodes = spark.createDataFrame([(int(f.view(np.int64)),) for f in np.concatenate([fps, near])], "fp long").distinct()
        at: dict[int, set] = defaultdict(set)
        for x in simhash.anchored(nodes, product=product).collect():
            at[x["fp"]].add(x["anchor"])
            if x["home"]:
                homes.setdefault(x["fp"], set()).add(x["anchor"])
        assert all(len(h) == 3 for h in homes.values())
        for a, b in zip(fps.view(np.int64).tolist(), near.view(np.int64).tolist()):
            assert homes[a] & at[b] and homes[b] & at[a]


def test_best_fit_places_every_piece_once():
    counts = {2048: 5, 2000: 3, 1500: 7, 1024: 5, 700: 11, 300: 13, 48: 4, 3: 50, 1: 1000}
    rows = packing.best_fit(counts)
    fill, seen = Counter(), defaultdict(list)
    at = defaultdict(dict)
    for length, low, high, first, offset in rows:
        seen[length].append((low, high))
        for i in range(high - low):
            assert offset not in at[first + i]
            at[first + i][offset] = length
            fill[first + i] += length
    for length, n in counts.items():
        assert sorted(seen[length])[0][0] == 0 and sum(b - a for a, b in seen[length]) == n
    assert max(fill.values()) <= 2048
    for places in at.values():
        end = 0
        for offset in sorted(places):
            assert offset == end
            end += places[offset]
    total = sum(k * n for k, n in counts.items())
    assert len(fill) <= -(-total // 2048) + 2


@pytest.mark.parametrize("clashing", [False, True])
def test_pack_equals_the_tokenizer(spark, clashing):
    rows = [*documents(), (900, prose(9, 9000), "en", "x", 1), (901, "It's <|endoftext|> 12\x85３ a b c é it'S!!", "en", "x", 1), (902, "\n\n a\r\nb\x0bc\x1cd\x00e ", "en", "x", 1)]
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want.append((r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(table(spark, rows, clashing), TOKENIZER, bucket=7).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0
