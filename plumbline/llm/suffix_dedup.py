"""Exact repeated substrings: suffixes ordered through DEPTH bytes by most-significant-digit passes.

A byte goes if a DEPTH-byte string that covers it also starts in a document with a smaller doc_id. The
suffixes of all documents would be ordered by their first DEPTH bytes only; equal groups are the repeated
strings. Two things keep that affordable:

* One digit stands for many suffixes. Every DEPTH-byte string holds at least one anchor: a K-byte string
  whose hash is the least of those within it. Equal strings hold equal anchors at equal places, so the
  suffixes that start up to DEPTH - K bytes before an anchor are ordered together: the first digit is the
  anchor, the second the DEPTH - K bytes around it.
* Groups of one document end after the first digit. Pass 1 sends the anchors' hashes only (packed, about 4
  bytes each, one anchor for some 14 bytes of text) and hears which of them another block has. Pass 2 sends
  the bytes around the anchors that remain, once for each block and content, and hears for each suffix
  whether a smaller document has it. Equal contents within a block are settled there.

How digits are compared (`_smaller`): rows are ordered by one digit after the other, the most significant first, and
a group of one row ends there. The anchor is one digit, a 64-bit hash of its K bytes; the AROUND bytes about it are
three digits, of 8, 8 and 2 real bytes (pass 3). Two short cuts spare most rows pass 3: contents (K + 2 x AROUND
bytes) that are equal as a whole are found in pass 2 by 128 bits of hashes, and the suffixes of an anchor that very
many documents share go by 128 bits as well. Nothing is decided on fewer bits.

Documents stand in blocks of some 4 MB, by a hash of the id and text; digits are compared in buckets, by a hash of the
anchor. An anchor that many documents share (a boilerplate line before ever different text) would fill one
bucket: such anchors send a key for each suffix instead, deduplicated in the block first, so that they spread
over all buckets. The blocks are kept on executors' disks; if one is lost, Spark makes its blocks again from the
input, the same ones.

Ids are integers. Null texts are empty. Documents of equal id do not remove each other's bytes; a null id counts as
larger than any. Texts shorter than DEPTH bytes stay as they are. Other columns pass through unchanged, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import small_batches

#: Bytes of a repeated string, of an anchor, and around it.
DEPTH, K = 50, 32
AROUND = DEPTH - K
#: Bytes of text in a block; an anchor in more blocks, or in more documents of one block, is compared suffix by suffix.
BLOCK, MANY_BLOCKS, MANY_DOCUMENTS = 4 << 20, 64, 16
#: Rows of the batches that are packed into blocks; bytes of text whose hashes a task holds at once.
ROWS, SLICE, ROWS_AT_ONCE = 4096, 1 << 20, 1 << 15
#: Beyond so many blocks, a bucket serves SPREAD blocks' worth of anchors, so that a block speaks to fewer.
MANY_BUCKETS, SPREAD = 1024, 4

_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LEADS = np.arange(DEPTH, dtype=np.uint64) * _FACTORS[2]
_WEIGHTS = np.random.default_rng(21).integers(1, 2**63, (2, DEPTH + AROUND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, plane by plane of their bytes."""
    out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    out += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _spread(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each run of n neighbours."""
    step = 1
    while 2 * step <= n:
        a = f(a[:-step], a[step:])
        step *= 2
    return f(a[: len(a) - (n - step)], a[n - step :]) if n > step else a


class Block:
    """The documents of a block, in order of id, and their anchors."""

    def __init__(self, table: pa.Table):
        rows = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("pack")]
        rows = pa.concat_tables(rows).sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
        self.rows = rows
        self.ids = rows.column("_id").to_numpy()
        text = rows.column("_text").chunk(0) if rows.column("_text").num_chunks else pa.array([], pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        self.flat = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.starts, self.ends = at[:-1] - at[0], at[1:] - at[0]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, number of document) of each anchor; documents are taken some SLICE bytes at a time, to bound memory."""
        none = np.empty(0, np.int64)
        found = [(none, none.astype(np.uint64))]
        cuts = np.flatnonzero(np.diff(self.starts // SLICE)) + 1 if len(self.starts) else none
        for docs in np.split(np.arange(len(self.starts)), cuts):
            if len(docs):
                place, h = _anchors(self.flat[self.starts[docs[0]] : self.ends[docs[-1]]], self.starts[docs] - self.starts[docs[0]], self.ends[docs] - self.starts[docs[0]])
                found.append((place + self.starts[docs[0]], h))
        place, h = (np.concatenate(x) for x in zip(*found))
        return place, h, np.searchsorted(self.ends, place, side="right")


def _anchors(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of documents that stand end to end."""
    if len(flat) < DEPTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _TABLE[flat]
    for i in range(5):  # hashes of 2, 4, 8, 16, 32 bytes
        h = h[: -(1 << i)] * _FACTORS[i] + h[1 << i :]
    h = _mixed(h) | np.uint64(1)
    least = _slide(h, AROUND + 1, np.minimum)  # of each DEPTH-byte string
    whole = np.zeros(len(flat) + 1, np.int8)  # strings within one document
    long = ends - starts >= DEPTH
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - DEPTH + 1, -1)
    least[np.cumsum(whole[:-1], dtype=np.int8)[: len(least)] == 0] = 0
    zeros = np.zeros(AROUND, np.uint64)
    best = _slide(np.concatenate([zeros, least, zeros]), AROUND + 1, np.maximum)
    place = np.flatnonzero(best == h)
    return place, h[place]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _digit(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _heads(block: Block) -> tuple[np.ndarray, ...]:
    """place, hash, document of the anchors; their distinct digits, the digit of each; of each digit, its number of documents."""
    place, h, doc = block.anchors()
    order = np.lexsort((doc, h))
    place, h, doc = place[order], h[order], doc[order]
    digits, of = np.unique(_digit(h), return_inverse=True)
    first = np.append(True, (np.diff(of) > 0) | (np.diff(block.ids[doc]) != 0)) if len(of) else np.empty(0, bool)
    return place, h, doc, digits, of, np.bincount(of[first], minlength=len(digits))


def _first_digits(key: tuple, table: pa.Table, buckets: int, documents_most: int) -> pa.Table:
    """Pass 1 of a block: its anchors' digits for each bucket."""
    _, _, _, digits, _, documents = _heads(Block(table))
    sent = digits << np.uint64(1) | (documents > documents_most).astype(np.uint64)
    to = _bucket(digits << np.uint64(16), buckets)
    cuts = np.flatnonzero(np.diff(to)) + 1
    parts = [p for p in np.split(sent, cuts) if len(p)]
    data = [_squeeze(np.diff(p, prepend=np.uint64(0))) for p in parts]
    return pa.table({"bucket": pa.array(to[np.append(0, cuts)] if len(to) else [], pa.int32()), "block": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


def _compare_first(key: tuple, table: pa.Table, blocks_most: int) -> pa.Table:
    """Pass 1 of a bucket: which digits another block has, and which are common."""
    parts = [np.cumsum(_spread(x, "<u8")[0], dtype=np.uint64) for x in table.column("data").to_pylist()]
    flat = np.concatenate(parts)
    digits, of, n = np.unique(flat >> np.uint64(1), return_inverse=True, return_counts=True)
    many = (n > blocks_most) | (np.bincount(of, flat & np.uint64(1), len(digits)) > 0)
    code = ((n > 1) + 2 * many).astype(np.uint8)[of]
    data = [_squeeze(x) for x in np.split(code, np.cumsum([len(p) for p in parts])[:-1])]
    return _heard(table, [0] * len(data), data)


def _answers(table: pa.Table, kind: int) -> list[bytes]:
    rows = [(b, d) for b, k, d in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data"))) if k == kind]
    return [d for _, d in sorted(rows)]


class Survey:
    """The anchors of a block that another document may have too, and the distinct contents around them.

    first: an anchor of each content, in the least document that has it; which: the content of each anchor.
    cold, hot: numbers of the contents of rare and common anchors, in the order in which they are sent.
    """

    def __init__(self, packs: pa.Table, code: np.ndarray):
        block = self.block = Block(packs)
        place, h, doc, digits, of, documents = _heads(block)
        stay = ((code & 1).astype(bool) | (documents > 1))[of]
        self.place, self.h, self.doc, many = place[stay], h[stay], doc[stay], (code >= 2)[of[stay]]
        self.left = np.minimum(self.place - block.starts[self.doc], AROUND).astype(np.uint8)
        self.right = np.minimum(block.ends[self.doc] - self.place - K, AROUND).astype(np.uint8)
        padded = np.concatenate([np.zeros(AROUND, np.uint8), block.flat, np.zeros(AROUND, np.uint8)])
        self.view = np.lib.stride_tricks.sliding_window_view(padded, DEPTH + AROUND) if len(self.place) else None
        content = np.empty(len(self.h), np.uint64)
        for i in range(0, len(content), ROWS_AT_ONCE):
            rows = np.arange(i, min(i + ROWS_AT_ONCE, len(content)))
            content[rows] = self.window(rows).astype(np.uint64) @ _WEIGHTS[0]
        content = _mixed(content + self.left.astype(np.uint64) * _FACTORS[0] + self.right.astype(np.uint64) * _FACTORS[1])
        order = np.lexsort((self.doc, self.h, content))
        new = np.append(True, (np.diff(content[order]) != 0) | (np.diff(self.h[order]) != 0)) if len(order) else np.empty(0, bool)
        self.first, self.which = order[new], np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.content = content[self.first]
        self.ids = block.ids[self.doc[self.first]]
        many = many[self.first]
        self.cold, self.hot = np.flatnonzero(~many), np.flatnonzero(many)
        self.cold = self.cold[np.argsort(self.h[self.first[self.cold]], kind="stable")]  # so by bucket too
        self.hot = self.hot[np.argsort(self.content[self.hot], kind="stable")]

    def window(self, rows: np.ndarray) -> np.ndarray:
        """The anchors with the bytes around them; zero beyond the document."""
        if not len(rows):
            return np.empty((0, DEPTH + AROUND), np.uint8)
        c, at = self.view[self.place[rows]], np.arange(AROUND)
        c[:, :AROUND] *= at >= AROUND - self.left[rows][:, None].astype(np.int64)
        c[:, DEPTH:] *= at < self.right[rows][:, None].astype(np.int64)
        return c

    def around(self, rows: np.ndarray) -> np.ndarray:
        """The bytes around the anchors alone."""
        c = self.window(rows)
        return np.concatenate([c[:, :AROUND], c[:, DEPTH:]], axis=1)


def _parts(h: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, numbers) of ascending hashes."""
    if not len(h):
        return []
    to = _bucket(h, buckets)
    return [(int(to[p[0]]), p) for p in np.split(np.arange(len(h)), np.flatnonzero(np.diff(to)) + 1)]


def _sent(block: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, d = zip(*rows)
    return pa.table({"bucket": pa.array(b, pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(d, pa.binary())})


def _heard(table: pa.Table, kinds: list[int], data: list) -> pa.Table:
    return pa.table({"block": table.column("block").cast(pa.int32()), "bucket": table.column("bucket").cast(pa.int32()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(data, pa.binary())})


def _codes(heard: pa.Table, kind: int) -> np.ndarray:
    return np.concatenate([_spread(d, "u1")[0] for d in _answers(heard, kind)] or [np.empty(0, np.uint8)])


def _contents(key: tuple, packs: pa.Table, heard: pa.Table, buckets: int) -> pa.Table:
    """Pass 2 of a block: hashes of its distinct contents for each bucket (of rare anchors by anchor, of common ones by content)."""
    code = _codes(heard, 0)
    s, number = Survey(packs, code), key[0].as_py()
    out = []
    h, c, ids = s.h[s.first[s.cold]], s.content[s.cold], s.ids[s.cold]
    out += [(to, 1, _squeeze(np.diff(h[p], prepend=np.uint64(0)), c[p], ids[p])) for to, p in _parts(h, buckets)]
    h, c, ids = s.h[s.first[s.hot]], s.content[s.hot], s.ids[s.hot]
    out += [(to, 2, _squeeze(np.diff(c[p], prepend=np.uint64(0)), h[p], ids[p])) for to, p in _parts(c, buckets)]
    return _sent(number, [*out, (number % buckets, 3, _squeeze(code))])


#: Answers on contents: nobody else has the anchor's content nor another content of it; a smaller document has all of it; others may have parts.
ALONE, REPEATED, OPEN = 0, 1, 2


def _compare_contents(key: tuple, table: pa.Table) -> pa.Table:
    """Pass 2 of a bucket: an answer for each content."""
    kinds, data = (table.column(c).to_pylist() for c in ("kind", "data"))
    answer: list[bytes | None] = [d if k == 3 else None for k, d in zip(kinds, data)]
    for kind in (1, 2):
        at = [i for i, k in enumerate(kinds) if k == kind]
        if not at:
            continue
        parts = [_spread(data[i], "<u8", "<u8", "<i8") for i in at]
        # Of rare anchors the anchor comes first, of common ones the content.
        head, content, ids = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        code = np.full(len(ids), OPEN, np.uint8)
        if kind == 1:  # an anchor with one content is settled by it
            order = np.lexsort((content, head))
            new = np.append(True, np.diff(head[order]) != 0)
            differs = np.append(False, (np.diff(content[order]) != 0) & ~new[1:])
            group = np.cumsum(new) - 1
            code[order[np.bincount(group, differs)[group] == 0]] = ALONE
        code[_smaller([head, content], ids)] = REPEATED
        for i, part in zip(at, np.split(code, np.cumsum([len(p[-1]) for p in parts])[:-1])):
            answer[i] = _squeeze(part)
    return _heard(table, kinds, answer)


def _second_digits(key: tuple, packs: pa.Table, heard: pa.Table, buckets: int) -> pa.Table:
    """Pass 3 of a block: the bytes around the anchors whose contents are open, and what it needs to apply the answers."""
    code = np.concatenate([_spread(d, "u1")[0] for d in _answers(heard, 3)] or [np.empty(0, np.uint8)])
    s, number = Survey(packs, code), key[0].as_py()
    verdict = np.empty(len(s.first), np.uint8)
    verdict[s.cold], verdict[s.hot] = _codes(heard, 1), _codes(heard, 2)
    cold, hot = s.first[s.cold[verdict[s.cold] == OPEN]], s.first[s.hot[verdict[s.hot] == OPEN]]
    out = []
    for to, p in _parts(s.h[cold], buckets):
        rows = cold[p]
        out.append((to, 1, _squeeze(np.diff(s.h[rows], prepend=np.uint64(0)), s.block.ids[s.doc[rows]], s.left[rows], s.right[rows], s.around(rows).reshape(-1))))
    keys, ids, key_of = np.empty(0, np.uint64), np.empty(0, np.int64), np.full((len(hot), AROUND + 1), -1, np.int64)
    if len(hot):
        c = s.window(hot)
        on = _held(s.left[hot], s.right[hot])
        one, two = (np.stack([_suffix(s.h[hot], c, lead, w) for lead in range(AROUND + 1)], axis=1)[on] for w in _WEIGHTS)
        order = np.lexsort((two, one))
        new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        keys, more = one[order[new]], two[order[new]]
        key_of[on] = inverse
        ids = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(ids, inverse, np.broadcast_to(s.block.ids[s.doc[hot]][:, None], on.shape)[on])
        out += [(to, 2, _squeeze(keys[p], more[p], ids[p])) for to, p in _parts(keys, buckets)]
    # The state: the runs that whole repeats remove; the anchors of an open content's least document with its number.
    mine = np.full(len(s.first), -1, np.int64)
    of = s.which
    mine[of[cold]], mine[of[hot]] = np.arange(len(cold)), -2 - np.arange(len(hot))
    later = s.block.ids[s.doc] > s.ids[of]
    repeat = later | (verdict[of] == REPEATED)
    cover = np.zeros(len(s.block.flat) + 1, np.int32)
    np.add.at(cover, s.place[repeat] - s.left[repeat], 1)
    np.add.at(cover, s.place[repeat] + K + s.right[repeat], -1)
    runs = np.flatnonzero(np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=np.int8(0)))
    stay = np.flatnonzero(~repeat & (mine[of] != -1))
    stay = stay[np.argsort(s.place[stay])]
    out.append((number % buckets, 3, _squeeze(np.diff(runs, prepend=0), np.diff(s.place[stay], prepend=0), s.left[stay], s.right[stay], mine[of][stay].astype(np.int32), key_of.reshape(-1), ids)))
    return _sent(number, out)


def _held(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which suffixes (by their bytes before the anchor) the document holds whole."""
    lead = np.arange(AROUND + 1)
    return (lead <= left[:, None].astype(np.int64)) & (AROUND - lead <= right[:, None].astype(np.int64))


def _suffix(h: np.ndarray, window: np.ndarray, lead: int, weights: np.ndarray) -> np.ndarray:
    """A hash of the suffixes of DEPTH bytes that start lead bytes before their anchors, and of lead."""
    return _mixed(h + window[:, AROUND - lead : AROUND - lead + DEPTH].astype(np.uint64) @ weights[:DEPTH] + _LEADS[lead])


def _bytes_as_digits(around: np.ndarray, lead: int) -> list[np.ndarray]:
    """The AROUND bytes of suffixes that start lead bytes before their anchors (the anchor left out), as digits of 8, 8 and 2 bytes."""
    c = np.zeros((len(around), 24), np.uint8)
    c[:, :AROUND] = around[:, AROUND - lead : 2 * AROUND - lead]
    return list(c.view(">u8").astype(np.uint64).T)


def _smaller(digits: list[np.ndarray], ids: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Whether an equal key has a smaller id, by passes over the digits, the most significant first; groups of one row end."""
    rows = np.arange(len(ids))
    group = np.zeros(len(ids), np.int64) if group is None else group
    out = np.zeros(len(ids), bool)
    for digit in digits:
        order = np.lexsort((digit[rows], group))
        rows, group = rows[order], group[order]
        d = digit[rows]
        new = np.append(True, (group[1:] != group[:-1]) | (d[1:] != d[:-1]))[: len(rows)]
        group = np.cumsum(new) - 1
        stay = np.bincount(group)[group] > 1 if len(rows) else np.empty(0, bool)
        rows, group = rows[stay], group[stay]
        if not len(rows):
            return out
    at = np.append(True, group[1:] != group[:-1])
    least = np.minimum.reduceat(ids[rows], np.flatnonzero(at))
    out[rows] = ids[rows] > least[np.cumsum(at) - 1]
    return out


def _compare_second(key: tuple, table: pa.Table) -> pa.Table:
    """Pass 3 of a bucket: for each content, the suffixes that a smaller document has (as bits); for each suffix of a common anchor, whether one has it."""
    kinds, data = (table.column(c).to_pylist() for c in ("kind", "data"))
    answer: list[bytes | None] = [d if k == 3 else None for k, d in zip(kinds, data)]
    at = [i for i, k in enumerate(kinds) if k == 1]
    if at:
        parts = [_spread(data[i], "<u8", "<i8", "u1", "u1", "u1") for i in at]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        ids, left, right = (np.concatenate([p[i] for p in parts]) for i in range(1, 4))
        c = np.concatenate([p[4].reshape(-1, 2 * AROUND) for p in parts])
        bits = np.zeros(len(h), np.uint32)
        # Anchors of one document only end here; so do those whose contents are all equal.
        _, of, n = np.unique(h, return_inverse=True, return_counts=True)
        live = np.flatnonzero(n[of] > 1)
        for lead in range(AROUND + 1):
            rows = live[(left[live] >= lead) & (right[live] >= AROUND - lead)]
            found = _smaller(_bytes_as_digits(c[rows], lead), ids[rows], of[rows])
            bits[rows[found]] |= np.uint32(1 << lead)
        for i, part in zip(at, np.split(bits, np.cumsum([len(p[0]) for p in parts])[:-1])):
            answer[i] = _squeeze(part)
    at = [i for i, k in enumerate(kinds) if k == 2]
    if at:
        parts = [_spread(data[i], "<u8", "<u8", "<i8") for i in at]
        one, two, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        found = _smaller([one, two], ids)
        for i, part in zip(at, np.split(found.view(np.uint8), np.cumsum([len(p[0]) for p in parts])[:-1])):
            answer[i] = _squeeze(part)
    return _heard(table, kinds, answer)


def _whole(flat: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Marks all bytes of every UTF-8 character of which a byte is marked."""
    lead = (flat & np.uint8(0xC0)) != np.uint8(0x80)
    lead[:1] = True
    lost = np.logical_or.reduceat(gone, np.flatnonzero(lead))
    return lost[np.cumsum(lead) - 1]


def _remove(packs: pa.Table, heard: pa.Table, whole: bool) -> pa.Table:
    """The rows of a block with their removed runs and what stays; if whole, of every character all bytes or none."""
    block = Block(packs)
    state = _answers(heard, 3)
    cover = np.zeros(len(block.flat) + 1, np.int32)
    if state:
        runs, place, left, right, number, key_of, ids = _spread(state[0], "<i8", "<i8", "u1", "u1", "<i4", "<i8", "<i8")
        runs, place, number = np.cumsum(runs), np.cumsum(place), number.astype(np.int64)
        cover[runs[::2]] += 1
        cover[runs[1::2]] -= 1
        bits = np.concatenate([_spread(d, "<u4")[0] for d in _answers(heard, 1)] or [np.empty(0, np.uint32)])
        more = np.concatenate([_spread(d, "u1")[0] for d in _answers(heard, 2)] or [np.empty(0, np.uint8)]).astype(bool)
        key_of = key_of.reshape(-1, AROUND + 1)
        owner = block.ids[np.searchsorted(block.ends, place, side="right")]
        masks = np.zeros(len(place), np.uint32)
        cold, hot = number >= 0, number < -1
        masks[cold] = bits[number[cold]]
        if hot.any():
            k = key_of[-2 - number[hot]]
            yes = (k >= 0) & (more[k] | (ids[k] < owner[hot][:, None]))
            masks[hot] = (yes * (np.uint32(1) << np.arange(AROUND + 1, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
        for lead in range(AROUND + 1):
            start = place[(masks >> np.uint32(lead) & np.uint32(1)).astype(bool)] - lead
            np.add.at(cover, start, 1)
            np.add.at(cover, start + DEPTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    kept, spans = [], []
    for a, b in zip(block.starts.tolist(), block.ends.tolist()):
        g = gone[a:b]
        if g.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).view(np.int8)))
            spans.append([{"start": int(i), "end": int(j)} for i, j in zip(edge[::2], edge[1::2])])
            kept.append(block.flat[a:b][~(_whole(block.flat[a:b], g) if whole else g)].tobytes())
        else:
            spans.append([])
            kept.append(block.flat[a:b].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = block.rows.drop_columns(["_id", "_text"])
    return out.append_column("_bytes", pa.array(block.ends - block.starts)).append_column("_spans", pa.array(spans, kind)).append_column("_kept", pa.array(kept, pa.binary()))


def _repeats(docs: DataFrame, carried: list[str], block: int = BLOCK, many: tuple[int, int] = (MANY_BLOCKS, MANY_DOCUMENTS), whole: bool = False) -> DataFrame:
    """(row, _bytes, _spans, _kept); row holds the carried columns, so that their names meet no others."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    buckets = n if n <= MANY_BUCKETS else max(MANY_BUCKETS, n // SPREAD)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    rows = docs.select(number.alias("_block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"), text.alias("_text"), F.struct(*carried).alias("row"))
    kept_row = rows.select("row").schema

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches put together to some ROWS rows or a block's bytes."""
        held, count, size = [], 0, 0
        for b in batches:
            held.append(b)
            count, size = count + b.num_rows, size + b.nbytes
            if count >= ROWS or size >= block:
                yield pa.Table.from_batches(held)
                held, count, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            t = t.set_column(2, "_text", t.column("_text").cast(pa.large_binary()))
            order = np.argsort(t.column("_block").to_numpy(), kind="stable")
            held = t.column("_block").to_numpy()[order]
            cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
            packs, t = [], t.drop_columns(["_block"])
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    out = pa.BufferOutputStream()
                    part = t.take(pa.array(order[i:j])).combine_chunks()
                    with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                        w.write_table(part)
                    packs.append((int(held[i]), out.getvalue().to_pybytes()))
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packs], pa.int32()), pa.array([p[1] for p in packs], pa.binary())], ["block", "pack"])

    packs = rows.mapInArrow(pack, "block int, pack binary").repartition(n, "block").persist(StorageLevel.DISK_ONLY)
    sent = "bucket int, block int, kind int, data binary"
    first = packs.groupBy("block").applyInArrow(lambda k, t: _first_digits(k, t, buckets, many[1]), "bucket int, block int, data binary")
    heard = first.groupBy("bucket").applyInArrow(lambda k, t: _compare_first(k, t, many[0]), "block int, bucket int, kind int, data binary")
    second = packs.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(lambda k, a, b: _contents(k, a, b, buckets), sent)
    heard = second.groupBy("bucket").applyInArrow(_compare_contents, "block int, bucket int, kind int, data binary")
    second = packs.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(lambda k, a, b: _second_digits(k, a, b, buckets), sent)
    heard = second.groupBy("bucket").applyInArrow(_compare_second, "block int, bucket int, kind int, data binary")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept_row, T.StructField("_bytes", T.LongType()), T.StructField("_spans", span), T.StructField("_kept", T.BinaryType())])
    return packs.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(lambda a, b: _remove(a, b, whole), schema)


def repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, _bytes, _spans, _kept) of each document: its length in bytes, the removed runs of bytes, the other bytes."""
    return _repeats(docs, ["doc_id"], **options).select("row.doc_id", "_bytes", "_spans", "_kept")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated strings taken out of their texts; their own columns, n_chars counted anew.

    A character that loses some of its bytes is dropped; a text of which nothing stays is empty; a null text stays null.
    """
    out = _repeats(docs, docs.columns, whole=True)
    same, kept = F.size("_spans") == 0, F.col("_kept").cast("string")
    new = {"text": kept, "n_chars": F.length(kept)}
    own = lambda c: F.col("row").getField(c)
    return out.select(*(F.when(same, own(c)).otherwise(new[c].cast(docs.schema[c].dataType)).alias(c) if c in new else own(c).alias(c) for c in docs.columns))
