"""Hard negatives against brute force, and the bounds of the triangle inequality."""

import math
import random

import numpy as np
import pytest
from llm_help import crowded
from pyspark.sql import functions as F

from gridspark.llm import hard_negatives as H

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, every=50):
    fine = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, u, la) in enumerate(fine):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(u, v)), b is None, b, lb) for m, (b, v, lb) in enumerate(fine) if m != n and len(u) == len(v)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        for p in [s for s in scored if s[3] == la][:positives]:
            hit = [s for s in scored if s[3] != la and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(a, p[2], k, s[2], -p[0], -s[0]) for k, s in enumerate(hit[:negatives], 1)]
    return sorted(map(repr, out))


def got_of(df):
    return sorted(repr((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in df.collect())


def clustered(rng, n, d, labels):
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 0.7) for c in centre[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 64):
        q = np.floor(256 * rng.normal(size=(200, d)))
        q[:3], q[3:6] = 0, q[6]
        found = H.fitted((q / 256).tolist(), 8)
        angles, norms = H.angles_to(q, found.get(d)).astype(np.float32).astype(float), H.norms_of(q)
        for j in range(0, 200, 7):
            low, high = H.score_bounds(angles[j], norms[j], angles, norms)
            s = H.integer_scores(q, q[j])
            assert (low <= s).all() and (s <= high).all()


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[float(1 << 40), 3.0]]), np.array([float(1 << 20), 1.0])
    assert H.integer_scores(a, b).tolist() == [(1 << 60) + 3]
    assert H.integer_scores(np.array([[1e300]]), np.array([1e300])).tolist() == [H.LAST]


@pytest.mark.parametrize("block, anchors", [(2048, 8192), (7, 3)])
def test_negatives_equal_brute_force(sp, monkeypatch, block, anchors):
    monkeypatch.setattr(H, "FIRST", 6)
    rng = random.Random(block)
    rows = clustered(rng, 400, 6, 4)
    rows += [(450, rows[1][1], 1), (450, rows[1][1], 1), (500, rows[1][1], 2), (501, None, 1), (502, [1.0, None] * 3, 1), (503, [float("nan")] * 6, 1), (504, [1.0] * 6, None),
             (550, [0.0] * 6, 3), (551, [0.0] * 6, 3), (552, [0.0] * 6, 1), (600, [1.0, 2.0], 1), (601, [1.0, 1.0], 1), (602, [0.6, 0.6], 2), (None, [1.0, 1.0], 1), (650, [], 1), (651, [], 2), (652, [], 1)]
    df = crowded(sp.createDataFrame(rows, COLUMNS).repartition(4))
    got = H.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block, anchors=anchors)
    assert got_of(got) == brute(rows)


def test_no_rows_and_no_anchors(sp):
    none = sp.createDataFrame([], COLUMNS)
    assert H.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    few = sp.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], COLUMNS)
    assert H.hard_negatives(few, F.col("vec_id") % 50 == 0).count() == 0
    alone = sp.createDataFrame([(50, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], COLUMNS)
    assert H.hard_negatives(alone, F.col("vec_id") % 50 == 0).count() == 0
