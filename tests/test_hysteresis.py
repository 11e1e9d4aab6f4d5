"""Latches, votes and corner labels against row-by-row machines."""

import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from spanframe.operators import corners, hysteresis
from spanframe.operators.folds import fold_arrays


@pytest.mark.parametrize("block", [5, 4096])
def test_latch(spark, block):
    rng, rows, want = random.Random(block), [], []
    for key in range(8):
        need, on, run, ask = rng.randint(1, 4), key % 2 == 0, 0, None
        for at in range(1, rng.choice([1, 60, 60])):
            ask, before = rng.choice([ask, ask, ask, True, False, None]), ask
            run = run + 1 if ask is before and at > 1 else 1
            rows.append((key, at, ask, need, f"f{at}"))
            if ask is not None and run == need and ask != on:
                on = ask
                want.append((key, at, on, f"f{at}"))
    t = spark.createDataFrame(rows, "key long, at long, ask boolean, need int, label string")
    got = hysteresis.latched(t, "key", "at", "ask", "need", F.col("key") % 2 == 0, ["label"], block)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 12


def state_machine(rows, start):
    """Row by row: votes of a window, a change only after a stay."""
    window, now, since, out = deque(maxlen=rows[0][3]), start, rows[0][4], []
    for _, at, value, _, dwell in rows:
        if value is not None:
            window.append(value)
        since += 1
        if window:
            counts = {}
            for v in window:
                counts[v] = counts.get(v, 0) + 1
            target = max(counts, key=counts.get)
            if target != now and since >= dwell:
                now, since = target, 0
                out.append((rows[0][0], at, now))
    return out


@pytest.mark.parametrize("block", [6, 4096])
def test_votes_and_dwell(spark, block):
    rng, rows, want = random.Random(block), [], []
    for key in range(10):
        value, own = "a", []
        for at in range(1, rng.choice([1, 2, 120])):
            value = rng.choice([value] * 4 + ["a", "b", "c"])
            own.append((key, at, value if rng.random() < 0.8 else None, 1 + key % 6, 1 + key % 9))
        if own:
            want += state_machine(own, "a")
        rows += own
    t = spark.createDataFrame(rows, "key long, at long, v string, width int, dwell int")
    got = hysteresis.settled(t, "key", "at", "v", "width", "dwell", "a", block)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    assert hysteresis.settled(t.where("key < 0"), "key", "at", "v", "width", "dwell", "a", block).isEmpty()


def labels(frames):
    """Frame by frame, slot by slot: costs with a penalty for what would turn."""
    label, pending, count, out = {0: 0, 1: 1}, None, 0, []
    for fight, frame, need, first, *c in frames:
        cost = {(s, k): c[2 * s + k] for s in (0, 1) for k in (0, 1)}
        seen = [s for s in ((0, 1) if first == 0 else (1, 0)) if cost[s, 0] is not None]
        if not seen:
            continue
        full = lambda s, k: cost[s, k] + (corners.TURN_COST if label[s] != k else 0)  # noqa: B023, E731
        if len(seen) == 2:
            a, b = seen
            candidate = {a: 0, b: 1} if full(a, 0) + full(b, 1) <= full(a, 1) + full(b, 0) else {a: 1, b: 0}
        else:
            k = 0 if full(seen[0], 0) <= full(seen[0], 1) else 1
            candidate = {seen[0]: k, 1 - seen[0]: 1 - k}
        if candidate == label:
            pending, count = None, 0
            continue
        pending, count = candidate, count + 1 if pending == candidate else 1
        if count >= need:
            label, pending, count = candidate, None, 0
            out.append((fight, frame, label[0] == 1))
    return out


FRAMES = "fight_id long, frame long, need int, first int, c00 double, c01 double, c10 double, c11 double"


def corner_frames(seed):
    rng, rows = random.Random(seed), []
    for fight in range(8):
        lean = 0.0
        for frame in range(0, 300, 2):
            lean = rng.choice([lean, lean, lean, -1.0, 0.0, 1.0])
            c = []
            for s in (0, 1):
                a, b = rng.choice([0.0, 0.25, 0.5]) + max(lean, 0) * (1 - s) - min(lean, 0) * s, rng.choice([0.0, 0.25, 0.5]) + max(lean, 0) * s - min(lean, 0) * (1 - s)
                c += [None, None] if rng.random() < 0.2 else [a, b]
            rows.append((fight, frame, 1 + fight % 4, rng.randint(0, 1), *c))
    return rows


@pytest.mark.parametrize("block", [5, 4096])
def test_corner_labels(spark, block):
    rows = corner_frames(block)
    got = sorted(map(tuple, corners.turns(spark.createDataFrame(rows, FRAMES), block=block).collect()))
    want = sorted(t for f in range(8) for t in labels([r for r in rows if r[0] == f]))
    assert got == want and len(want) > 30


def test_swapped_slots_give_swapped_labels(spark):
    """Names of slots mean nothing: with both exchanged, the same frames turn, once the
    labels have been set either way."""
    rows = [r for r in corner_frames(3) if r[4] is not None and r[6] is not None]
    quarter = lambda r: (*r[:4], *(x + 0.01 * i for i, x in enumerate(r[4:])))  # no ties
    rows = [quarter(r) for r in rows]
    other = [(f, n, need, 1 - first, c, d, a, b) for f, n, need, first, a, b, c, d in rows]
    run = lambda x: {(r.fight_id, r.frame): r.swapped for r in corners.turns(spark.createDataFrame(x, FRAMES)).collect()}
    one, two = run(rows), run(other)
    shared = set(one) & set(two)
    assert len(shared) > 20 and all(one[k] != two[k] for k in shared)
    for fight in range(8):
        a, b = (sorted(k for k in x if k[0] == fight) for x in (one, two))
        assert abs(len(a) - len(b)) <= 1


def test_templates_against_numbers(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for fight in range(12):
        sums = {}
        for _ in range(fight * 2):
            slot = rng.randint(0, 1)
            red = rng.uniform(-0.2, 0.2) + (0.1 if slot == fight % 2 else -0.1) * (fight % 3)
            hist = None if rng.random() < 0.2 else [float(rng.randint(0, 9)) for _ in range(4)]
            weight = rng.choice([0, 10, 200])
            rows.append((fight, slot, red, hist, weight))
            sums.setdefault(slot, []).append((red, hist, weight))
        mean = {s: sum(r for r, *_ in v) / len(v) for s, v in sums.items()}
        hists = {}
        for s, v in sums.items():
            used = [(h, w) for _, h, w in v if h is not None and w > 0]
            if used:
                h = [sum(x[i] * w for x, w in used) / sum(w for _, w in used) for i in range(4)]
                hists[s] = [x / sum(h) for x in h] if sum(h) > 0 else h
        missing = [s for s in (0, 1) if s not in mean]
        if missing:
            want[fight] = corners.NO_FRAMES % missing[0]
            continue
        far = 0.0
        if len(hists) == 2:
            common = sum(math.sqrt(a * b) for a, b in zip(hists[0], hists[1])) / math.sqrt(sum(hists[0]) * sum(hists[1]))
            far = math.sqrt(max(0.0, 1 - common))
        separation = 0.5 * min(1.0, abs(mean[0] - mean[1]) / 0.3) + 0.5 * far
        red = [mean[s] >= 0 for s in (0, 1)]
        want[fight] = corners.AMBIGUOUS % ("red" if red[0] else "blue") if red[0] == red[1] else corners.LOW_SEPARATION % (separation, 0.15) if separation < 0.15 else round(separation, 9)
    t = spark.createDataFrame(rows, "fight_id long, slot int, net_red double, hist array<double>, weight int")
    got = {r.fight_id: r.reason or round(r.separation, 9) for r in corners.templates(t, spark.range(12).withColumnRenamed("id", "fight_id")).collect()}
    assert got == want and len({type(v) for v in want.values()}) == 2


def test_votes(spark):
    rows = [(1, 0.5, 0.1)] * 3 + [(1, 0.1, 0.105)] * 9 + [(1, 0.0, 0.2)] * 4 + [(2, 0.3, 0.0)] * 2 + [(3, None, 0.2)]
    got = corners.tape_votes(spark.createDataFrame(rows, "fight_id long, net_red_0 double, net_red_1 double"), least=5)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 4, True, 1), (2, 2, 0, False, 0), (3, 0, 0, False, 0)]


def test_fold_over_stretches(spark):
    """The state goes on over batches, null keys are a key, nulls are NaN."""
    rows = [(k, i, float(i) if i % 7 else None) for k in (None, 1, 2) for i in range(1, 40)]
    t = spark.createDataFrame(rows, "key long, i long, v double")

    def step(state, c):
        out, now = [], state or 0.0
        for v in c["v"].tolist():
            now += 0 if math.isnan(v) else v
            out.append(now)
        return now, [out]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = fold_arrays(t, step, ["v"], "total double", "key", order=["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.key, r.i): r.total for r in got} == {(k, i): float(sum(j for j in range(1, i + 1) if j % 7)) for k, i, _ in rows}
    assert Counter(r.key for r in got) == {None: 39, 1: 39, 2: 39}


def test_a_mean_of_zero_has_no_sign(spark):
    """0.1 + 0.2 - 0.3 and its like are 0, above or below by the order of summation."""
    sums = [[0.1, 0.2, -0.3], [-0.3, 0.2, 0.1], [-0.1, -0.2, 0.3], [0.3, -0.2, -0.1]]
    assert {s > 0 for s in map(sum, sums)} == {True, False} and any(s < 0 for s in map(sum, sums))
    rows = [(fight, slot, red, None, 0) for fight, reds in enumerate(sums) for slot, values in ((0, reds), (1, [-0.5])) for red in values]
    t = spark.createDataFrame(rows, "fight_id long, slot int, net_red double, hist array<double>, weight int").coalesce(1)
    got = corners.templates(t, spark.range(4).withColumnRenamed("id", "fight_id")).collect()
    assert sorted((r.fight_id, r.net_red_0, r.corner_0, r.reason) for r in got) == [(f, 0.0, 0, None) for f in range(4)]
