"""Hard negatives against brute force over all pairs, cover tree properties, and odd input."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskspark.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, vec string, k int, tree string"


def brute(rows, positives=5, negatives=5, low=80, every=100):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        key = (label, np.array(q, "<i4").tobytes())
        if i not in best or key < best[i][0]:
            best[i] = (key, label, q)
    points = [(i, label, q) for i, (_, label, q) in best.items()]
    out = set()
    for i, label, q in points:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), j, m) for j, m, r in points if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -100 * s][:negatives]
            out |= {(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    found = hardneg.mine(df, F.col("vec_id") % 100 == 0, **more).collect()
    got = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found}
    assert len(got) == len(found)
    return got


def clustered(n, seed, dims=8, spread=0.05):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    return [(k, int(g.integers(0, 3)), (centres[g.integers(0, 6)] + spread * g.normal(size=dims)).tolist()) for k in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.02, 2.0])
def test_brute_force(spark, monkeypatch, spread):
    """Copies, near copies and scattered vectors, several trees, groups and blocks."""
    monkeypatch.setattr(hardneg, "TREE", 60)
    monkeypatch.setattr(hardneg, "GROUP", 2)
    monkeypatch.setattr(hardneg, "BLOCK", 3)
    rows = clustered(700, 1, spread=spread)
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_odd_rows(spark):
    one = [0.5, -0.25, 0.125]
    rows = [
        (0, 1, one), (100, 1, one), (200, 2, [-1.0, 0.0, 0.0]), (1, 1, one), (2, 2, one), (3, 2, one), (4, 2, [0.5, -0.25, 0.0]), (5, 2, [0.5]), (6, 1, []),
        (7, None, one), (8, 1, None), (9, 1, [0.5, None, 0.1]), (10, 1, [float("nan")] * 3), (11, 1, [float("inf"), 0.0, 0.0]), (None, 1, one),
        (12, 2, one), (12, 2, one), (13, 2, one), (13, 1, one), (14, 1, [0.0, 0.0, 0.0]), (300, 3, [0.0] * 3), (301, 4, [0.0] * 3), (302, 3, [0.0] * 3), (-100, 1, [3.0, 1.0, 2.0])]
    want = brute(rows)
    assert mined(spark, rows) == want and {w[0] for w in want} >= {0, 100, 300, -100}
    assert mined(spark, rows, positives=2, negatives=1, low=50) == brute(rows, 2, 1, 50)


def test_many_copies(spark, monkeypatch):
    """A third of all rows are one vector under two labels: they stand in a tree once per label."""
    monkeypatch.setattr(hardneg, "TREE", 60)
    rows = clustered(400, 2) + [(1000 + k, k % 2, [1.0] * 8) for k in range(200)]
    want = brute(rows)
    assert mined(spark, rows) == want and any(w[0] == 1000 for w in want)


def test_large_components_and_none(spark):
    rows = [(0, 1, [300000.0, 1.0]), (1, 1, [300001.0, 2.0]), (2, 2, [290000.0, 3.0])]
    assert mined(spark, rows) == brute(rows) != set()
    assert mined(spark, []) == set() == mined(spark, [(1, 1, [1.0])]) == mined(spark, [(0, 1, [1.0])])


@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_tree_covers(vectors):
    """Every vector is met once, lies within its ancestors' angles, and children lie within half their parent's radius."""
    q = np.array(vectors, "<i4")
    largest = float(np.sqrt((q.astype(float) ** 2).sum(axis=1).max()))
    space = hardneg.Space(3, largest, 40)
    x = space.augmented(q)
    t = hardneg.build(x, largest)
    assert sorted(t.point[t.fresh].tolist()) == list(range(len(q)))

    def below(k):
        out = [t.point[k]]
        for c in range(t.below[k], t.below[k + 1]):
            out += below(c)
        return out

    if largest:
        for k in range(len(t.point)):
            cos = np.clip(x[below(k)] @ x[t.point[k]] / largest ** 2, -1, 1)
            assert (np.arccos(cos) <= t.angle[k] + 1e-5).all()
            for c in range(t.below[k], t.below[k + 1]):
                assert t.angle[c] <= t.angle[k] * 0.75 + 1e-4


def test_search_skips(monkeypatch):
    """Far clusters are not descended."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 16))
    centres *= 256 / np.linalg.norm(centres, axis=1)[:, None]
    q = np.rint(np.repeat(centres, 50, axis=0) + g.normal(size=(2000, 16))).astype("<i4")
    largest = float(np.linalg.norm(q.astype(float), axis=1).max())
    space, seen = hardneg.Space(16, largest, int(np.abs(q).max())), []
    part = hardneg.Part(q, np.zeros(2000, np.int32), np.arange(2000), np.arange(2000), np.ones(2000, np.int64), hardneg.build(space.augmented(q), largest))
    real = hardneg.Space.products
    monkeypatch.setattr(hardneg.Space, "products", lambda s, a, b: (seen.append(len(a) * len(b)), real(s, a, b))[1])
    anchors = hardneg.Anchors(np.array([7]), np.zeros(1, np.int32), q[7:8])
    best = hardneg.Best(np.array([0]), np.array([hardneg.NONE]), np.array([-hardneg.NONE]), 5)
    hardneg.search(part, anchors, best, True, space)
    scores = q.astype(np.int64) @ q[7].astype(np.int64)
    scores[7] = hardneg.NONE
    assert best.score[0].tolist() == sorted(scores.tolist())[::-1][:5] and sum(seen) < 400
