"""A minimal perfect hash over 64-bit keys: n distinct keys go to the numbers 0 to n - 1, with some three bits a key.

Keys try a bit array a level at a time. A bit that exactly one key chooses is set and that key stays; the others try
the next, smaller array. A key's number is the count of set bits before its own, for which each 64-bit word knows the bits before
it. Keys that no level settles (equal ones do so too) stand in a sorted list behind the others.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Bits for each key of a level; levels; the words of the mixer (fixed values of splitmix64).
ROOM, LEVELS = 1.5, 40
GOLDEN, FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + GOLDEN * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * FIRST
        x = (x ^ (x >> np.uint64(27))) * SECOND
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """sizes: bits of each level; words: all levels' bits; before: bits set before each word; rest: unsettled keys, sorted."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray
    rest: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the keys' numbers. Equal keys get different numbers, in a row, in the order given."""
        left, sizes, bits = np.arange(len(keys)), [], []
        while len(left) and len(sizes) < LEVELS:
            size = 64 * max(1, -(-int(ROOM * len(left)) // 64))
            at = (mixed(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            sizes.append(size)
            bits.append(level)
            left = left[~alone]
        flat = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
        words = np.packbits(flat, bitorder="little").view("<u8")
        counts = flat.reshape(-1, 64).sum(1, dtype=np.int64)
        held = cls(np.array(sizes, np.int64), words, (np.cumsum(counts) - counts).astype(np.uint32), np.sort(keys[left]))
        numbers = held(keys)
        order = left[np.argsort(keys[left], kind="stable")]
        numbers[order] = int(counts.sum()) + np.arange(len(order))
        return held, numbers

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; that of a key which was not built in is -1 or another's."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            mine = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[mine]] & ((np.uint64(1) << bit[mine]) - np.uint64(1)))
            out[left[mine]] = self.before[word[mine]].astype(np.int64) + below
            left, base = left[~mine], base + int(size) // 64
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left])
            found = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left]
            settled = int(np.bitwise_count(self.words).sum())
            out[left[found]] = settled + at[found]
        return out

    def to_bytes(self) -> bytes:
        parts = [self.sizes.astype("<i8"), self.words.astype("<u8"), self.before.astype("<u4"), self.rest.astype("<u8")]
        return struct.pack("<4q", *map(len, parts)) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        sizes, at, parts = struct.unpack_from("<4q", data), 32, []
        for n, kind in zip(sizes, ("<i8", "<u8", "<u4", "<u8")):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*parts)
