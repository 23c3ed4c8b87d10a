"""The language models' bits against interpolated Kneser-Ney from plain dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from plumbline.llm import language_id


def ends(word):
    """(n-gram, the character before it or None) for each n and each character but the opening edge."""
    s = f" {word} "
    for at in range(1, len(s)):
        for n in range(1, min(language_id.ORDER, at + 1) + 1):
            yield n, s[at - n + 1 : at + 1], s[at - n] if at >= n else None


class Plain:
    """One language: counts of the longest n-grams, numbers of different characters before the shorter ones."""

    def __init__(self, words, letters):
        self.floor, before, whole = 1 / (letters + 1), defaultdict(set), Counter()
        for word, times in words:
            for n, gram, prior in ends(word):
                if n == language_id.ORDER:
                    whole[gram] += times
                else:
                    before[gram].add(prior)
        self.count = {**{g: len(x) for g, x in before.items()}, **whole}
        self.total, self.kinds = Counter(), Counter()
        for g, c in self.count.items():
            self.total[len(g), g[:-1]] += c
            self.kinds[len(g), g[:-1]] += 1

    def p(self, gram):
        if not gram:
            return self.floor
        n, context = len(gram), gram[:-1]
        shorter = self.p(gram[1:])
        total = self.total[n, context]
        if not total:
            return shorter
        d = language_id.DISCOUNT
        return (max(self.count.get(gram, 0) - d, 0) + d * self.kinds[n, context] * shorter) / total

    def bits(self, word):
        s = f" {word} "
        return sum(-math.log2(max(self.p(s[max(0, at - language_id.ORDER + 1) : at + 1]), 1e-12)) for at in range(1, len(s)))


def test_bits_of_words_equal_those_from_dictionaries():
    r = random.Random(4)
    drawn = lambda alphabet, n: ["".join(r.choice(alphabet) for _ in range(r.randint(1, 9))) for _ in range(n)]
    words = {"a": [(w, r.randint(1, 5)) for w in sorted(set(drawn("abcde", 300)))], "b": [(w, r.randint(1, 5)) for w in sorted(set(drawn("cdefgé", 200)))], "c": [("ab", 1)]}
    models = language_id.Models(words)
    letters = len({c for held in words.values() for w, _ in held for c in f" {w} "})
    plain = {name: Plain(held, letters) for name, held in words.items()}
    asked = [w for held in words.values() for w, _ in held[:40]] + ["zzz", "abzcd", "x", "ab", "ééééééééééé", "edcba" * 8]
    bits, sizes = models.entropies(asked)
    for row, n, word in zip(bits, sizes, asked):
        assert n == len(word) + 1
        for x, name in zip(row, models.languages):
            assert x == pytest.approx(plain[name].bits(word), rel=2e-4, abs=1e-3)
