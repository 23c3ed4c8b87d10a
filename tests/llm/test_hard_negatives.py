"""Hard negatives against all pairs, the curve, the bounds, and the awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, anchor boolean, v long, place string, ids string, run int, lane int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", 7, 7) for r in rows], SCHEMA)


def plain(rows, k=5, m=5, low=80, high=100):
    kept = {}
    for i, label, x, anchor in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [max(-hn.COMPONENT, min(hn.COMPONENT, math.floor(256 * float(np.float32(c))))) for c in x]
        kept[i, label, tuple(v)] = anchor
    last = lambda i: math.inf if i is None else i
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for (i, label, v), anchor in kept.items():
        if not anchor:
            continue
        others = [(-dot(v, w), last(j), j, of == label) for j, of, w in kept if j != i]
        for s, _, p, same in sorted(o[:3] + (True,) for o in others if o[3])[:k]:
            window = sorted(o[:3] for o in others if not o[3] and -low * s <= -100 * o[0] <= -high * s)[:m]
            out += [(i, p, r, n, -s, -t) for r, (t, _, n) in enumerate(window, 1)]
    return sorted(out, key=str)


def clustered(n, seed=3, dims=12, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3
    of = rng.integers(0, clusters, n)
    x = centres[of] + rng.normal(size=(n, dims)) * 0.2
    return [(i, int((of[i] + (rng.random() < 0.3)) % 4), [float(c) for c in x[i].astype(np.float32)], i % 10 == 0) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(400), [(i, i % 3, [float(i % 4), 1.0, -0.5], i % 5 == 0) for i in range(120)]], ids=["clusters", "ties"])
def test_equals_all_pairs(spark, rows):
    found = hn.mine(table(spark, rows), block=16, run_blocks=2, lane=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, [1.0, 2.0], True), (2, 0, None, True), (3, 0, [1.0, None], True), (4, 0, [nan, 1.0], True), (5, 0, [inf, 1.0], True), (None, 0, [1.0, 1.0], False), (None, 1, [0.95, 0.95], None), (6, 0, [], True), (7, 0, [1.0], True), (8, 1, [1e30, 1.0], True)]
    rows = [*odd, *((10 + i, i % 2, [1.0 + i / 50, 1.0], i % 3 == 0) for i in range(20))]
    rows += [rows[-2], rows[-2], (29, 0, [1.3, 1.0], True)]  # repeated rows, and an id with two labels
    found = hn.mine(table(spark, rows), block=4, run_blocks=2, lane=2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
    assert hn.mine(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    places = hn.hilbert(cells, bits)
    assert len(set(places)) == len(cells)
    along = cells[sorted(range(len(cells)), key=places.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_zones_spare_blocks(spark):
    rng = np.random.default_rng(1)
    a, v = rng.integers(-50, 50, (5, 6)), rng.integers(-50, 50, (40, 6))
    below, above = hn.bounds(a, v.min(0)[None], v.max(0)[None])
    assert (below[:, 0] <= (a @ v.T).min(1)).all() and ((a @ v.T).max(1) <= above[:, 0]).all()
    at, width = hn.placed(hn.vectors_of(table(spark, clustered(1200))))
    made = hn.blocks_of(at, width, 5, 16, 2)
    packs = made.filter("kind = 2").selectExpr("part AS pack", "label", "v", "floors AS least").collect()
    zones = made.filter("kind = 1").selectExpr("label", "low", "high").collect()
    spared = asked = 0
    for p in packs:
        for z in zones:
            if z.label == p.label:
                _, top = hn.bounds(hn._rows(p.v, width), hn._rows(z.low, width), hn._rows(z.high, width))
                asked += 1
                spared += not (top[:, 0] >= hn._longs(p.least)).any()
    assert spared > asked / 3
