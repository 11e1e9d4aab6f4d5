"""Training windows and samples against numpy and plain loops."""

import random

import numpy as np
import pytest

from spanframe.operators import training
from spanframe.operators.training import CHANNELS, CLIP, MIRRORED, TOTAL

PEOPLE = "fight_id long, corner int, frame long, box struct<x1:double,y1:double,x2:double,y2:double>, skeleton array<array<double>>"


def people(seed, fights=4, n=60, share=0.7):
    rng, out = random.Random(seed), {}
    for fight in range(fights):
        for frame in range(n):
            for corner in (0, 1):
                if rng.random() < share:
                    x, y = rng.uniform(0, 300), rng.uniform(0, 50)
                    b = (x, y, x + rng.uniform(20, 60), y + rng.uniform(60, 120))
                    kp = [[rng.uniform(b[0] - 400, b[2] + 400) if rng.random() < 0.1 else rng.uniform(b[0], b[2]), rng.uniform(b[1], b[3]), rng.choice([0.1, 0.39, 0.4, 0.9, 0.95])] for _ in range(17)]
                    out[fight, corner, frame] = (b, None if rng.random() < 0.1 else kp)
    return out


def table(spark, people):
    return spark.createDataFrame([(*k, *v) for k, v in people.items()], PEOPLE)


def anchor(p):
    b, kp = p
    sure = [j for j in (5, 6, 11, 12) if kp[j][2] >= 0.4]
    if len(sure) >= 2:
        x, y = ([kp[j][a] for j in sure] for a in (0, 1))
        centre = (min(x) + max(x)) / 2, (min(y) + max(y)) / 2
    else:
        centre = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    mid = lambda i, j: np.array([(kp[i][a] + kp[j][a]) / 2 for a in (0, 1)])
    width = np.hypot(kp[5][0] - kp[6][0], kp[5][1] - kp[6][1])
    long = np.linalg.norm(mid(5, 6) - mid(11, 12))
    if min(kp[j][2] for j in (5, 6, 11, 12)) >= 0.4 and long >= 0.5 * width:
        return centre, max(long, 10)
    if min(kp[5][2], kp[6][2]) >= 0.4 and width > 0:
        return centre, max(width, 10)
    return centre, max((b[3] - b[1]) / 3, 10)


def window(people, fight, frame, corner, fps, n):
    seen = {k: v for k, v in people.items() if v[1] is not None}
    if frame >= n or (fight, corner, frame) not in seen:
        return None
    origin, size = anchor(seen[fight, corner, frame])
    frames = np.clip(np.rint(frame + (np.arange(TOTAL) - (TOTAL - 1) / 2) / 25 * fps).astype(int), 0, n - 1)
    flip = False
    for f in [frame, *sorted(frames, key=lambda f: abs(f - frame))]:
        if (fight, 1 - corner, f) in seen:
            flip = anchor(seen[fight, 1 - corner, f])[0][0] < origin[0]
            break
    rows = []
    for c in (corner, 1 - corner):
        channels = np.zeros((52, TOTAL))
        for t, f in enumerate(frames):
            if (fight, c, f) not in seen:
                continue
            kp = np.array(seen[fight, c, f][1])
            if flip:
                for a, b in MIRRORED:
                    kp[[a, b]] = kp[[b, a]]
            xy = (kp[:, :2] - origin) / size
            xy[:, 0] *= -1 if flip else 1
            xy[kp[:, 2] < 0.4] = 0
            channels[:51, t] = np.concatenate([np.clip(xy, -CLIP, CLIP), kp[:, 2:]], axis=1).reshape(-1)
            channels[51, t] = 1
        rows.append(channels)
    return np.concatenate(rows)


def test_windows(spark):
    seen, rng = people(1, share=0.5), random.Random(2)
    asked = [(i, rng.randrange(4), rng.randrange(70), rng.randrange(2), rng.choice([24.0, 29.97, 10.0]), 60, "mine") for i in range(80)]
    t = training.windows(spark.createDataFrame(asked, "id long, fight_id long, frame long, corner int, fps double, n_frames long, _x string"), table(spark, seen))
    got = {r.id: (np.array(r.window), r._x) for r in t.collect()}
    want = {i: w for i, fight, frame, corner, fps, n, _ in asked if (w := window(seen, fight, frame, corner, fps, n)) is not None}
    assert set(got) == set(want) and 10 < len(want) < 80
    for i, w in want.items():
        assert got[i][0].shape == (CHANNELS, TOTAL) and np.allclose(got[i][0], w, atol=1e-9) and got[i][1] == "mine"


def near(labels, fight, corner, frame, radius):
    return any(f == fight and c == corner and abs(n - frame) <= radius for f, n, c, *_ in labels)


@pytest.mark.parametrize("parts", [1, 7])
def test_samples(spark, parts):
    rng, seen = random.Random(3), people(4, fights=5, n=200, share=0.6)
    labels = [(rng.randrange(4), rng.randrange(200), rng.randrange(2), rng.choice(["jab", "hook", "elbow", "kick", None]), rng.choice(["head", "leg", "unknown", None]), i, 2.0) for i in range(60)]
    rounds = [(f, a, a + 60) for f in range(3) for a in (0, 100)]
    excluded = [(f, 20, 35) for f in range(4)]
    spans = "fight_id long, start_frame long, end_frame long"
    t = training.samples(
        spark.createDataFrame(labels, "fight_id long, frame long, corner int, family string, target string, event_id long, fps double").repartition(parts), table(spark, seen).repartition(parts),
        spark.createDataFrame(rounds, spans), spark.createDataFrame(excluded, spans), seed=9,
    )
    got = [tuple(r) for r in t.collect()]
    whole = {k for k, v in seen.items() if v[1] is not None}
    families = {"jab": 1, "hook": 3, "kick": 5}
    positives = sorted((f, n, c, "label", families[a], {"head": 0, "leg": 2}.get(g, -1), i) for f, n, c, a, g, i, _ in labels if a in families and (f, c, n) in whole)
    assert sorted(r for r in got if r[3] == "label") == positives
    hard = sorted((f, n, 1 - c) for f, n, c, *_ in positives if (f, 1 - c, n) in whole and not near(labels, f, 1 - c, n, 2))
    assert sorted(r[:3] for r in got if r[3] == "hard_neg") == hard and hard
    drawn = [r[:3] for r in got if r[3] == "rand_neg"]
    free = {(f, n, c) for f, c, n in whole if (f == 3 or any(g == f and a <= n <= b for g, a, b in rounds)) and not any(g == f and a <= n <= b for g, a, b in excluded) and not near(labels, f, c, n, 2)}
    assert set(drawn) <= free and len(set(drawn)) == len(drawn)
    for f in range(5):
        assert sum(r[0] == f for r in drawn) == min(sum(r[0] == f for r in positives), sum(x[0] == f for x in free))
    drawn_by.append(sorted(drawn))
    assert drawn_by[0] == drawn_by[-1]


drawn_by = []


def test_nothing(spark):
    t = training.samples(spark.createDataFrame([], "fight_id long, frame long, corner int, family string, target string, event_id long, fps double"), table(spark, people(1)), spark.createDataFrame([], "fight_id long, start_frame long, end_frame long"), spark.createDataFrame([], "fight_id long, start_frame long, end_frame long"))
    assert t.isEmpty()
