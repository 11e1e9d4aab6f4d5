"""Initiators, recoil, limbs and poses against plain loops."""

import math
import random
from collections import deque

import pytest

from spanframe.operators import strikes


@pytest.mark.parametrize("block", [5, 8192])
def test_initiators(spark, block):
    rng, rows, want = random.Random(block), [], {}
    for fight in range(6):
        fps, frame = rng.choice([10.0, 24.0, 50.0]), 0
        last = deque(maxlen=max(1, round(fps * 0.3)))
        for _ in range(rng.choice([1, 40])):
            frame += rng.choice([1, 1, 4])
            row = (rng.uniform(0, 30), rng.uniform(0, 30), rng.choice([None, 0.0, 40.0, 60.0]), rng.choice([None, 50.0]))
            rows.append((fight, frame, fps, *row))
            last.append(row)
            red, blue = (last[-1][i] - last[0][i] for i in (0, 1))
            scales = [s for r in (last[0], last[-1]) for s in r[2:] if s]
            least = 0.17 * (sum(scales) / len(scales) if scales else 1.0)
            want[fight, frame] = None if len(last) < 2 else "blue" if red - blue > least else "red" if blue - red > least else None
    t = spark.createDataFrame(rows, "fight_id long, frame long, fps double, red double, blue double, red_scale double, blue_scale double")
    assert {(r.fight_id, r.frame): r.initiator for r in strikes.initiators(t, block=block).collect()} == want
    assert {"red", "blue", None} == set(want.values())


@pytest.mark.parametrize("block", [16, None])
def test_landed(spark, block):
    rng, heads, rows, want = random.Random(7), [], [], {}
    for fight in range(4):
        fps = rng.choice([24.0, 50.0])
        step = max(1, round(fps * 0.08))
        by_frame = {f: [(rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([None, 0.05, 40.0])) for _ in (0, 1)] for f in range(200) if rng.random() < 0.25}
        heads += [(fight, f, *h) for f, h in by_frame.items()]
        for i in range(60):
            f, who = rng.choice([*by_frame, *range(200)]), rng.randrange(2)
            rows.append((fight, fight * 100 + i, f, who, fps, "x"))
            verdict = None
            if f in by_frame and by_frame[f][who][2] is not None:
                later = next((g for g in range(f + step, f + 4 * step + 1) if g in by_frame), None)
                if later is not None:
                    (x, y, scale), (u, v, _) = by_frame[f][who], by_frame[later][who]
                    verdict = math.hypot(u - x, v - y) / step * fps >= 1.5 * scale
            want[fight * 100 + i] = verdict
    point = "struct<x:double,y:double,scale:double>"
    got = strikes.landed(spark.createDataFrame(rows, "fight_id long, event_id long, frame long, defender int, fps double, later_0 string"), spark.createDataFrame(heads, f"fight_id long, frame long, head_0 {point}, head_1 {point}"), block=block)
    assert {r.event_id: r.landed for r in got.collect()} == want and {True, False, None} == set(want.values())


def mean(kp, joints):
    seen = [kp[j] for j in joints if kp[j][2] >= 0.3]
    return (sum(p[0] for p in seen) / len(seen), sum(p[1] for p in seen) / len(seen)) if seen else None


def far(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def limb(action, target, me, op):
    head = mean(op, range(5)) or mean(op, (5, 6))
    body = mean(op, (5, 6, 11, 12))
    aim = head if target == "head" else (mean(op, (13, 14)) or body) if target == "leg" else body
    family = "hook" if "hook" in action else "uppercut" if "uppercut" in action else "kick" if action.endswith("kick") else "knee" if action.endswith("knee") else action
    if family in ("kick", "knee"):
        hip = mean(me, (11, 12)) or mean(me, (5, 6))
        seen = [(k, me[j]) for k, j in enumerate((15, 16) if family == "kick" else (13, 14)) if me[j][2] >= 0.3]
        seen.sort(key=lambda s: -far(s[1], hip) if hip else 0)
        left = not seen or seen[0][0] == 0
        return ([11, 13, 15] if left else [12, 14, 16]) if family == "kick" else ([11, 13] if left else [12, 14])
    if action.startswith(("left_", "right_")):
        return [5, 7, 9] if action.startswith("left_") else [6, 8, 10]
    aim = aim or head
    a, b = (far(me[j], aim) if me[j][2] >= 0.3 and aim else math.inf for j in (9, 10))
    return [5, 7, 9] if a <= b else [6, 8, 10]


def test_limbs(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    pose = lambda p: [[rng.uniform(0, 99), rng.uniform(0, 99), 0.9 if rng.random() < p else 0.1] for _ in range(17)]
    rows = [(i, rng.choice(["jab", "cross", "left_hook", "right_hook", "left_uppercut", "low_kick", "head_kick", "knee", "elbow"]), rng.choice(["head", "body", "leg", None]), pose(rng.choice([0, 0.3, 0.9])), pose(rng.choice([0, 0.1, 0.9]))) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, action string, target string, me array<array<double>>, op array<array<double>>")
    got = {r.id: r.chain for r in t.select("id", strikes.limb(F.col("action"), F.col("target"), F.col("me"), F.col("op")).alias("chain")).collect()}
    assert got == {i: limb(a, g, me, op) for i, a, g, me, op in rows}


def test_best_pose(spark):
    rng = random.Random(5)
    poses = [(k, f, [[[0.0, 0.0, rng.choice([0.2, 0.5, 0.9])] for _ in range(3)] for _ in (0, 1)]) for k in range(5) for f in range(60) if rng.random() < 0.8]
    hits = [(k, i, rng.randrange(60)) for k in range(4) for i in range(5)]
    want = {}
    for k, i, s in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        for f in range(s - 3, s + 4):
            for q, g, people in poses:
                if (q, g) == (k, f):
                    c = [p[2] for s in people for p in s]
                    score = (sum(x >= 0.5 for x in c), min(c))
                    if k not in want or score > want[k][1:]:
                        want[k] = (f, *score)
    got = strikes.best_pose(spark.createDataFrame(hits, "fight_id long, event_id long, frame long"), spark.createDataFrame(poses, "fight_id long, frame long, skeletons array<array<array<double>>>"))
    assert {r.fight_id: (r.frame, r.seen, r.worst) for r in got.collect()} == want
