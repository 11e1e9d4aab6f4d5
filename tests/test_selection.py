"""People and masks against all assignments; corner accuracy."""

import random
from itertools import permutations

import numpy as np

from spanframe.operators import corners, selection


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 7))
        cost = rng.integers(0, 6, (n, n)) / 5 if rng.random() < 0.5 else rng.random((n, n))
        got = selection.assign(cost)
        assert sorted(got) == list(range(n))
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in permutations(range(n)))
        assert abs(cost[np.arange(n), got].sum() - best) < 1e-9


def box(rng):
    x, y = rng.uniform(0, 60), rng.uniform(0, 20)
    return [x, y, x + rng.uniform(20, 50), y + rng.uniform(40, 60)]


def test_selection(spark):
    rng, people, masks, want = random.Random(4), [], [], {}
    for fight in range(3):
        for frame in range(60):
            p, r = [box(rng) for _ in range(rng.randint(0, 5))], [box(rng) for _ in range(rng.randint(0, 4))]
            sure = [rng.random() for _ in p]
            people += [(fight, frame, i, *b, c) for i, (b, c) in enumerate(zip(p, sure))]
            masks += [(fight, frame, i, *b) for i, b in enumerate(r)]
            if p and r:
                over = selection.overlaps(np.array(p), np.array(r))
                wide = [*range(len(r)), *[None] * len(p)]
                best = max(set(permutations(wide, len(p))), key=lambda a: round(sum(over[i, c] for i, c in enumerate(a) if c is not None), 12))
                hit = sorted((i for i, c in enumerate(best) if c is not None and over[i, c] >= selection.LEAST_OVERLAP), key=lambda i: -sure[i])[:2]
                want |= {(fight, frame, i): n + 1 for n, i in enumerate(hit)}
    rng.shuffle(people)
    t = selection.select_people(spark.createDataFrame(people, "fight_id long, frame long, no int, x1 double, y1 double, x2 double, y2 double, confidence double"), spark.createDataFrame(masks, "fight_id long, frame long, no int, x1 double, y1 double, x2 double, y2 double"))
    assert {(r.fight_id, r.frame, r.no): r.rank for r in t.collect()} == want and len(want) > 60


def test_two_masks_on_one_person_keep_one():
    people, masks = np.array([[0, 0, 10, 20], [40, 0, 50, 20.0]]), np.array([[0, 0, 10, 20], [0, 0, 10, 19.0]])
    assert selection.chosen(people, np.array([0.5, 0.9]), masks) == [0]


def test_corner_accuracy(spark):
    t = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 1), (1, 3, 1, 0), (1, 4, 1, 1), (1, 5, None, 0), (2, 1, None, None)], "fight_id long, frame long, vote_0 int, vote_1 int")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "fight_id long")
    got = {r.fight_id: (r.decisive, r.correct, r.accuracy) for r in corners.accuracy(t, keys).collect()}
    assert got == {1: (3, 2, 2 / 3), 2: (0, 0, None), 3: (0, 0, None)}
