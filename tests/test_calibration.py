"""Joined runs and the scoreboard's place against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import calibration, clock

FPS = 2


def fit(run, down=True):
    v = [s * FPS + f if down else f - s * FPS for f, s, _ in run]
    centre = statistics.median(v)
    near = [r for r, x in zip(run, v) if abs(x - centre) <= 4 * FPS]
    if near and len(near) < len(run):
        centre = statistics.median([s * FPS + f if down else f - s * FPS for f, s, _ in near])
    return centre, near


def merged(runs, down=True):
    fitted = [(no, *fit(r, down)) for no, r in runs]
    fitted = [x for x in fitted if len(x[2]) >= 3]
    out = [[fitted[0][0], 1, *fitted[0][1:]]] if fitted else []
    for no, centre, near in fitted[1:]:
        _, n, at, before = out[-1]
        a, b = ({x for _, _, x in r if x is not None} for r in (before, near))
        if not (a and b and a != b) and abs(centre - at) <= 4 * FPS:
            out[-1][1:] = [n + 1, *fit(sorted(before + near, key=lambda r: r[0]), down)]
        else:
            out.append([no, 1, centre, near])
    return out


@pytest.mark.parametrize("down", [True, False])
def test_merged_runs_and_numbers(spark, down):
    rng, rows, want = random.Random(3), [], {}
    for fight in range(40):
        runs, frame, base = [], 0, 600
        for no in range(1, rng.randint(1, 8)):
            base += rng.choice([0, 0, 3, 6, 9, 200])
            number = rng.choice([None, None, 1 + no // 3])
            run = []
            for _ in range(rng.choice([1, 2, 3, 6, 9])):
                frame += rng.randint(1, 4)
                secs = (base - frame) / FPS if down else (frame - base) / FPS
                run.append((frame, secs + rng.choice([0, 0, 0, 0.5, 1, 7]), number if rng.random() < 0.7 else None))
            runs.append((no, run))
            rows += [(fight, no, *r) for r in run]
        found = merged(runs, down)
        observed = [statistics.mode([n for *_, n in near if n is not None]) if any(n is not None for *_, n in near) else None for *_, near in found]
        anchor = next((i for i, n in enumerate(observed) if n is not None), None)
        for i, (no, n, centre, near) in enumerate(found):
            number = observed[i] if observed[i] is not None else i + 1 if anchor is None else max(1, observed[anchor] + i - anchor)
            secs = [s for _, s, _ in near]
            want[fight, no] = (n, round(centre / FPS, 6), len(near), max(secs), min(secs), number, observed[i] is not None)
    t = spark.createDataFrame(rows, "fight_id long, run long, frame long, secs double, round_num int")
    got = clock.numbered_rounds(clock.merged_runs(t, FPS, "fight_id", down=down), "fight_id").collect()
    assert {(r.fight_id, r.run): (r.runs, r.intercept, r.inliers, r.highest, r.lowest, r.round_number, r.numbered) for r in got} == want
    assert max(n for n, *_ in want.values()) > 2


def cluster(boxes):
    """Box by box, with the mean of all centres of a cluster."""
    tx, ty = (max(1.0, float(np.median([b[i + 2] - b[i] for b in boxes]))) for i in (0, 1))
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    clusters = []
    for b in boxes:
        x, y = centre(b)
        for c in clusters:
            if abs(x - np.mean([centre(o)[0] for o in c])) <= tx and abs(y - np.mean([centre(o)[1] for o in c])) <= ty:
                c.append(b)
                break
        else:
            clusters.append([b])
    return clusters


def test_clusters_in_order(spark):
    rng, rows, want = random.Random(8), [], {}
    for fight in range(15):
        boxes = []
        for _ in range(rng.choice([1, 2, 30])):
            x, y = rng.choice([0, 0, 40, 300]) + rng.randint(0, 40), rng.choice([0, 20]) + rng.randint(0, 9)
            boxes.append((x, y, x + rng.randint(5, 30), y + rng.randint(3, 9)))
        found = cluster(boxes)
        want[fight] = sorted(max(found, key=len))
        rows += [(fight, no, *map(float, b)) for no, b in enumerate(boxes)]
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "fight_id long, no int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in calibration.dominant(t, "fight_id").collect():
        got.setdefault(r.fight_id, []).append((r.x1, r.y1, r.x2, r.y2))
    assert {f: sorted(b) for f, b in got.items()} == {f: [tuple(map(float, b)) for b in v] for f, v in want.items()}


def test_samples_are_spread(spark):
    for n in (1, 2, 7, 8, 9, 23, 1000):
        most = min(calibration.TRIED, n)
        want = sorted({int(i * n / most) for i in range(most)})
        t = spark.range(n).where(calibration.tried(F.col("id"), F.lit(n)))
        assert sorted(r.id for r in t.collect()) == want and len(want) == most


def test_region_is_padded_cut_and_gated(spark):
    boxes = [(1, i, "timer", 5.0 + i, 5.0, 25.0 + i, 15.0) for i in range(4)] + [(1, 9, "timer", 300.0, 5.0, 320.0, 15.0), (1, 10, "round", 60.0, 4.0, 70.0, 14.0)]
    t = spark.createDataFrame(boxes, "fight_id long, no int, kind string, x1 double, y1 double, x2 double, y2 double")
    videos = spark.createDataFrame([(1, 80.0, 100.0), (2, 10.0, 10.0)], "fight_id long, width double, height double")
    reads = lambda n: spark.createDataFrame([(1, i, i < n) for i in range(8)], "fight_id long, frame long, reads boolean")
    rows = [tuple(r) for n in (2, 1) for r in calibration.region(t, reads(n), videos).collect()]
    assert rows == [(1, 0.0, 0.0, 80.0, 35.0, 0.25, True), (1, 0.0, 0.0, 80.0, 35.0, 0.125, False)]
    assert math.isclose(calibration.region(t, reads(0).where("false"), videos).first().match_rate, 0)
