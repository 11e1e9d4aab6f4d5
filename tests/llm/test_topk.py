"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from spanframe.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score int, s string, kind double"


def brute(rows, queries, k, scale=64.0):
    def quantized(rows):
        out = []
        for i, v, *_ in rows:
            if i is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
                out.append((i, tuple(math.floor(x * scale) for x in v)))
        return out

    got = []
    for q, v in set(quantized(queries)):
        score = lambda w: max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63))  # noqa: B023, E731
        found = [(-score(w), c) for c, w in quantized(rows) if c != q and len(w) == len(v)]
        got += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(got)


def table(n, dim, seed, copies=0.3):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 0.2) for _ in range(dim)]
    rows = [(i, hot if rng.random() < copies else [rng.gauss(0, 0.2) for _ in range(dim)], 1, "x", 2.0) for i in range(n)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, queries, k):
    t, q = (spark.createDataFrame(x, SCHEMA) for x in (rows, queries))
    found = topk.top_k(t.repartition(3), q, k=k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("dim", [1, 5, 64, 130])
def test_against_brute_force(spark, monkeypatch, dim):
    rows = table(400, dim, dim)
    assert run(spark, rows, rows[:60], 7) == brute(rows, rows[:60], 7)


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, []), (8, []), (9, [1e300, 1e300]), (10, [-3e17, 1.0]), (11, [1e17, 2.0]), (12, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]),
        (13, [0.5, -0.5]), (13, [0.5, -0.5]), (14, [5e8, 5e8 + 1 / 64]), (15, [5e8, 5e8]), (-20, [0.1, -0.01]),
    ]
    rows = [(i, v, 0, "", 0.0) for i, v in rows]
    assert run(spark, rows, rows, 20) == brute(rows, rows, 20)
    assert run(spark, rows, rows, 1) == brute(rows, rows, 1)


def test_empty_sides(spark):
    rows = table(5, 3, 1)
    assert run(spark, [], [], 3) == run(spark, rows, [], 3) == run(spark, [], rows, 3) == []


def test_pruned_tile_is_exact():
    """Clustered vectors in order, so that later chunks are pruned at every level."""
    rng = np.random.default_rng(3)
    # candidates grow worse: long runs fall to the coarse levels
    x = np.floor(rng.normal(0, 1, (9000, 64)) * np.linspace(40, 1, 9000)[:, None] + np.linspace(8, -8, 9000)[:, None])
    ids = rng.permutation(9000)
    tile = topk.Tile(ids[:30], ids[:30], x[:30], 10)
    for at in range(0, 9000, 500):
        tile.offer(ids[at : at + 500], x[at : at + 500])
    for n in range(30):
        s = (x @ x[n]).astype(int)
        want = [j for j in np.lexsort((ids, -s)) if j != n][:10]
        assert tile.found[n].tolist() == ids[want].tolist() and tile.scores[n].tolist() == s[want].tolist()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 7, 64, 65):
        q, x = rng.integers(-60, 60, (20, dim)).astype(float), rng.integers(-60, 60, (30, dim)).astype(float)
        bounds = [topk.segment_features(q, n) @ topk.segment_features(x, n).T for n in (64, 16, 4)]
        for coarse, fine in zip(bounds, bounds[1:]):
            assert (fine <= coarse + 1e-6).all()
        assert (q @ x.T <= bounds[-1] + 1e-6).all()
