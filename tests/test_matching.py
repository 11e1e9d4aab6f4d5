"""Matching against exhaustive search, suppression against its definition."""

import random
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa

from spanframe.operators.matching import best_pairs, match, peaks, whole_groups


def exhaustive(truth, found, tol):
    best = (0, 0)
    for n in range(1, min(len(truth), len(found)) + 1):
        for a in combinations(range(len(truth)), n):
            for b in permutations(range(len(found)), n):
                offsets = [abs(truth[i] - found[j]) for i, j in zip(a, b)]
                if max(offsets) <= tol:
                    best = max(best, (n, -sum(offsets)))
    return best


def test_best_pairs_is_optimal():
    rng = random.Random(4)
    for _ in range(150):
        truth, found = (sorted(rng.randrange(30) for _ in range(rng.randrange(5))) for _ in range(2))
        pairs = best_pairs(np.array(truth), np.array(found), 6)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert (len(pairs), -sum(abs(truth[i] - found[j]) for i, j in pairs)) == exhaustive(truth, found, 6)


def whole_table(truth, found, tol):
    """The same optimum and the same choice among equals, by a table of all pairs."""
    n, m = len(truth), len(found)
    best = {(i, j): (0, 0) for i in range(n + 1) for j in range(m + 1)}
    with_pair = lambda i, j: (best[i + 1, j + 1][0] + 1, best[i + 1, j + 1][1] - abs(truth[i] - found[j]))
    near = lambda i, j: abs(truth[i] - found[j]) <= tol
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(best[i + 1, j], best[i, j + 1], *([with_pair(i, j)] if near(i, j) else []))
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if near(i, j) and best[i, j] == with_pair(i, j):
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i, j + 1]:
            j += 1
        else:
            i += 1
    return pairs


def test_best_pairs_chooses_as_the_whole_table():
    rng = random.Random(11)
    for _ in range(400):
        truth, found = (sorted(rng.randrange(60) for _ in range(rng.randrange(25))) for _ in range(2))
        tol = rng.choice([0, 1, 5, 20, 100])
        assert best_pairs(np.array(truth, dtype=np.int64), np.array(found, dtype=np.int64), tol) == whole_table(truth, found, tol)


def test_best_pairs_of_a_dense_fight():
    frames = np.arange(30_000)
    assert best_pairs(frames, frames + 2, 100) == [(i, i) for i in range(30_000)]


def test_match_by_groups_equals_whole(spark):
    rng = random.Random(7)
    rows = [(f, rng.randrange(2), i, rng.randrange(4000)) for i in range(120) for f in (1, 2)]
    t = spark.createDataFrame([(f, i * 2 + f, x, s) for f, s, i, x in rows], "fight_id long, event_id long, frame long, side int")
    got = match(t.where("side = 0"), t.where("side = 1"), 40, "fight_id").collect()
    for f in (1, 2):
        truth = sorted(x for g, s, _, x in rows if g == f and s == 0)
        found = sorted(x for g, s, _, x in rows if g == f and s == 1)
        pairs = best_pairs(np.array(truth), np.array(found), 40)
        mine = [r for r in got if r.fight_id == f and r.offset is not None]
        assert len(mine) == len(pairs)
        assert sum(abs(r.offset) for r in mine) == sum(abs(truth[i] - found[j]) for i, j in pairs)
        assert len([r for r in got if r.fight_id == f and r.truth_id is not None]) == len(truth)
    assert match(t.limit(0), t.limit(0), 40, "fight_id").count() == 0


def test_peaks(spark):
    rows = [(1, 1, 10, 0.5), (1, 2, 15, 0.9), (1, 3, 19, 0.8), (1, 4, 40, 0.1), (1, 5, 21, 0.9)]
    t = spark.createDataFrame(rows, "fight_id long, event_id long, frame long, score double")
    assert sorted(r.event_id for r in peaks(t, 5, "fight_id").collect()) == [2, 4, 5]
    assert sorted(r.event_id for r in peaks(t, 5, "fight_id", threshold=0.5).collect()) == [2, 5]
    assert sorted(r.event_id for r in peaks(t.union(t.selectExpr("fight_id", "event_id + 10", "frame + 100", "score / 2")), 5, "fight_id").collect()) == [2, 4, 5, 12, 14, 15]


def test_groups_stream_whole(spark):
    """Many groups go through at once, whatever the batches, and none is torn."""
    begins = [True, False, True, True, False, False, False, True]
    t = pa.table({"begins": begins, "n": range(8)})
    for size in (1, 2, 3, 8):
        tables = [x["n"].to_pylist() for x in whole_groups(iter(t.to_batches(size)))]
        assert sum(tables, []) == list(range(8)) and all(begins[x[0]] for x in tables)
    assert len(list(whole_groups(iter(t.to_batches())))) == 2 and not list(whole_groups(iter([])))

    rng = random.Random(8)
    sides = [[(rng.choice([None, "a", "b"]), rng.randrange(900), i, rng.choice([0.5, 1.5, float(i)])) for i in range(n)] for n in (250, 300)]
    one, other = (spark.createDataFrame(rows, "key string, frame long, event_id long, score double") for rows in sides)
    plain = lambda t: sorted(map(tuple, t.collect()), key=str)
    whole = plain(match(one, other, 3, "key")), plain(peaks(one, 5, "key"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert whole == (plain(match(one, other, 3, "key")), plain(peaks(one, 5, "key")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key in (None, "a", "b"):
        a, b = (sorted((f, i) for k, f, i, _ in rows if k == key) for rows in sides)
        frames = sorted(f for f, _ in a + b)
        cuts = [frames[0], *(y for x, y in zip(frames, frames[1:]) if y - x > 3), frames[-1] + 1]
        for low, high in zip(cuts, cuts[1:]):
            x, y = ([r for r in side if low <= r[0] < high] for side in (a, b))
            want |= {(x[i][1], y[j][1]) for i, j in best_pairs(np.array([f for f, _ in x], np.int64), np.array([f for f, _ in y], np.int64), 3)}
    assert {(t, f) for _, t, f, _ in whole[0] if t is not None and f is not None} == want
