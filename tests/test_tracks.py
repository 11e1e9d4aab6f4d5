"""Tracking against all assignments, smoothing against numpy."""

import random
from itertools import permutations

import numpy as np
import pytest

from spanframe.operators import tracks

# ---------------------------------------------------------------- sessions and smoothing


@pytest.mark.parametrize("block", [4, 4096])
def test_sessions(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for key in range(6):
        frame = start = rng.randint(0, 9)
        for i in range(rng.choice([1, 40])):
            gap = rng.choice([1, 1, 2, 3, 4, 30]) if i else 0
            start = frame + gap if gap > 3 else start
            frame += gap
            rows.append((key, frame))
            want[key, frame] = start
    got = tracks.gap_sessions(spark.createDataFrame(rows, "key long, frame long"), ["key"], "frame", 3, block)
    assert {(r.key, r.frame): r.session for r in got.collect()} == want


def savgol(x, width):
    """Fit each window by numpy and read the polynomial at its row."""
    n, half = len(x), width // 2
    out = []
    for i in range(n):
        s = min(max(i - half, 0), n - width)
        out.append(np.polyval(np.polyfit(np.arange(width) - half, x[s : s + width], 2), i - s - half))
    return np.array(out)


def smooth(frames, values, fps):
    """One run of rows: interpolation, median with repeated edges, fit."""
    dense = np.arange(frames[0], frames[-1] + 1)
    x = np.interp(dense, frames, values)
    n = len(x)
    w = min(tracks.odd_frames(0.1, fps), n - 1 + n % 2)
    if w >= 3:
        p = np.pad(x, w // 2, mode="edge")
        x = np.array([np.median(p[i : i + w]) for i in range(n)])
    w = min(tracks.odd_frames(0.24, fps), n - 1 + n % 2)
    return dense, savgol(x, w) if w > 2 else x


@pytest.mark.parametrize(("block", "fps"), [(16, 50.0), (4096, 50.0), (8, 25.0)])
def test_smoothing(spark, block, fps):
    rng, rows, want = random.Random(block), [], {}
    most = max(1, round(fps * 0.3))
    for key in range(7):
        frame, runs = 5, [[]]
        for _ in range([1, 2, 3, 4, 9, 60, 90][key]):
            gap = rng.choice([1, 1, 1, 2, 5, most, most + 3])
            frame += gap
            if gap > most and runs[-1]:
                runs.append([])
            b = [rng.uniform(0, 50) + frame, rng.uniform(0, 50), 0, 0]
            b[2:] = [b[0] + rng.uniform(10, 60), b[1] + rng.uniform(10, 60)]
            runs[-1].append((frame, b))
        for run in runs:
            rows += [(key, f, tuple(b), None) for f, b in run]
            if len(run) == 1:
                want[key, run[0][0]] = (run[0][1], False)
                continue
            fs = [f for f, _ in run]
            b = np.array([b for _, b in run])
            parts = [smooth(fs, v, fps) for v in ((b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])]
            for i, f in enumerate(parts[0][0]):
                cx, cy, w, h = (p[1][i] for p in parts)
                want[key, int(f)] = ([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], int(f) not in fs)
    t = spark.createDataFrame(rows, "key long, frame long, box struct<x1:double,y1:double,x2:double,y2:double>, skeleton array<array<double>>")
    got = {(r.key, r.frame): (list(r.box), r.filled) for r in tracks.smooth_boxes(t, "key", fps=fps, block=block).collect()}
    assert set(got) == set(want) and any(f for _, f in want.values())
    for k, (b, filled) in want.items():
        assert got[k][1] == filled and np.allclose(got[k][0], b, atol=1e-6), k


def test_boxes_stay_on_their_skeletons(spark):
    """A fit carried off by an outlier gives way to the observed box, and boxes hold their joints."""
    joints = lambda x, y: [[x + (i % 3) * 8.0, y + i * 4.0, 0.9] for i in range(17)]
    rows = [(1, f, (100.0, 100.0, 140.0, 180.0), joints(110, 105)) for f in range(20)]
    rows += [(1, f, (300.0, 100.0, 340.0, 180.0), joints(310, 105)) for f in range(20, 24)]
    rows += [(1, f, (100.0, 100.0, 140.0, 180.0), joints(110, 105)) for f in range(24, 44)]
    t = spark.createDataFrame(rows, "key long, frame long, box struct<x1:double,y1:double,x2:double,y2:double>, skeleton array<array<double>>")
    got = {r.frame: r.box for r in tracks.smooth_boxes(t, "key", fps=50.0).collect()}
    assert got[0].x1 == pytest.approx(100) and got[22].x1 == pytest.approx(300, abs=1e-6)
    for _, f, _, skeleton in rows:
        assert all(got[f].x1 <= x <= got[f].x2 and got[f].y1 <= y <= got[f].y2 for x, y, _ in skeleton)


def test_empty(spark):
    t = spark.createDataFrame([], "key long, frame long, box struct<x1:double,y1:double,x2:double,y2:double>, skeleton array<array<double>>")
    assert tracks.smooth_boxes(t, "key", fps=50.0).isEmpty()


# ---------------------------------------------------------------- identities


def test_match_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        rows, columns = rng.randint(1, 3), rng.randint(1, 4)
        costs = [[rng.random() for _ in range(columns)] for _ in range(rows)]
        got = tracks.match(costs)
        used = [c for c in got if c is not None]
        assert len(used) == len(set(used)) == min(rows, columns)
        wide = [*range(columns), *[None] * rows]
        every = [p for p in set(permutations(wide, rows)) if sum(c is not None for c in p) == min(rows, columns)]
        total = lambda p: sum(costs[r][c] for r, c in enumerate(p) if c is not None)  # noqa: B023, E731
        assert total(got) == min(map(total, every))


def plain(frames, wait):
    """Frame by frame without cuts, frames without boxes included."""
    people, out = {}, {}
    for f in range(min(frames), max(frames) + 1):
        out[f] = tracks.follow(people, frames.get(f, []), wait)
    return {f: s for f, s in out.items() if f in frames}


@pytest.mark.parametrize("block", [16, 4096])
def test_cut_tracks_equal_whole_ones(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for key in range(5):
        frames, at = {}, [[0.0, 0.0], [60.0, 5.0]]
        frame = 0
        for _ in range(150):
            frame += rng.choice([1, 1, 1, 2, 3, 5, 6, 7, 8, 40]) if rng.random() < 0.2 else 1
            for p in at:
                p[0] += rng.uniform(-6, 6)
                p[1] += rng.uniform(-3, 3)
            seen = [[x, y, x + 30.0, y + 60.0] for x, y in at if rng.random() < 0.85]
            rng.shuffle(seen)
            seen += [[500.0, 500.0, 520.0, 540.0]] if rng.random() < 0.05 else []
            if seen:
                frames[frame] = seen
        fps = 10.0 if key % 2 else 8.0
        for f, slots in plain(frames, max(1, round(fps * 0.6))).items():
            for no, (b, slot) in enumerate(zip(frames[f], slots)):
                rows.append((key, f, no, *b, fps))
                want[key, f, no] = slot
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "key long, frame long, no int, x1 double, y1 double, x2 double, y2 double, fps double")
    got = {(r.key, r.frame, r.no): r.slot for r in tracks.track(t, "key", block=block).collect()}
    assert got == want and {0, 1, None} <= set(want.values())


def test_crossing_people_keep_their_slots():
    people = {}
    assert tracks.follow(people, [[0, 0, 30, 60], [100, 0, 130, 60]], 6) == [0, 1]
    for i in range(1, 40):
        seen = [[100 - 2.3 * i, 0, 130 - 2.3 * i, 60], [2.3 * i, 0, 30 + 2.3 * i, 60]]
        assert tracks.follow(people, seen, 6) == [1, 0]
    assert [tracks.follow(people, [], 6) for _ in range(7)] == [[]] * 7 and not people


def test_equal_costs_go_to_the_lower_slot():
    """Also if the person of slot 0 came after that of slot 1."""
    for slots in ((0, 1), (1, 0)):
        people = {s: tracks.Person([0.0, 0.0, 10.0, 10.0]) for s in slots}
        assert tracks.follow(dict(people), [[3.0, 0.0, 13.0, 10.0]], 6) == [0]
        assert tracks.follow(dict(people), [[3.0, 0.0, 13.0, 10.0], [-3.0, 0.0, 7.0, 10.0]], 6) == [0, 1]
