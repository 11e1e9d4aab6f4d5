"""Agreement of two passes is symmetric, and a ceiling only at its own tolerance."""

import random

from spanframe.plans.quality_checks import agreement, ceilings


def test_symmetric_and_known(spark):
    rng = random.Random(2)
    one = [(f, i, rng.randrange(3000)) for f in range(4) for i in range(40)]
    other = [(f, i, t + rng.randint(-20, 20)) for f, i, t in one if rng.random() < 0.8] + [(9, 1, 5)]
    a, b = (spark.createDataFrame(x, "fight_id long, event_id long, frame long") for x in (one, other))
    x, y = ({r.fight_id: r for r in agreement(p, q, 12, "fight_id").collect()} for p, q in ((a, b), (b, a)))
    assert {f: r.f1 for f, r in x.items()} == {f: r.f1 for f, r in y.items()} and 0 < x[0].f1 < 1
    assert all((r.tp, r.fp, r.fn) == (y[f].tp, y[f].fn, y[f].fp) for f, r in x.items())
    same = {r.fight_id: r.f1 for r in agreement(a, a, 0, "fight_id").collect()}
    assert set(same.values()) == {1.0}


def test_ceiling_needs_the_same_tolerance(spark):
    scores = spark.createDataFrame([(1, 12), (2, 20), (3, 12)], "fight_id long, tolerance int")
    agreements = spark.createDataFrame([(1, 12, 0.9), (2, 12, 0.8)], "fight_id long, tolerance int, f1 double")
    got = {r.fight_id: (r.comparable, r.ceiling) for r in ceilings(scores, agreements, "fight_id").collect()}
    assert got == {1: (True, 0.9), 2: (False, None), 3: (None, None)}
