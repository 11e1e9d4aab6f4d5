"""The segmentation machines: blocks of windows against the frame-by-frame machine."""

import random

import pytest

from spanframe.operators import segmentation
from spanframe.operators.segmentation import Machine, Rules

RULES = Rules(presence=2.0, fight_gap=4.0, engagement=1.0, round_gap=2.0, shortest=0.7)
SCHEMA = "fight_id long, frame long, hit boolean, fps double, at long"


def fights(seed, n=30, length=400):
    rng, rows = random.Random(seed), []
    for fight in range(n):
        fps, frame, hit = rng.choice([3.0, 5.0, 4.8]), 0, True
        for _ in range(rng.choice([0, 1, 5, length, length])):
            frame += rng.choice([1, 1, 1, 2])
            if rng.random() < 0.06:
                hit = not hit
            rows.append((fight, frame, (hit if rng.random() < 0.85 else not hit) if rng.random() < 0.97 else None, fps, -1))
    rng.shuffle(rows)
    return rows


def step_by_step(rows, rules):
    out = []
    for fight in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == fight)
        machine = Machine(own[0][3], rules)
        for _, frame, hit, *_ in own:
            out += [(fight, *r) for r in machine.see(frame, bool(hit))]
        out += [(fight, *r) for r in machine.open_round()]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_blocks_equal_the_machine(spark, block):
    rows = fights(block)
    got = segmentation.segment(spark.createDataFrame(rows, SCHEMA), RULES, block=block)
    want = step_by_step(rows, RULES)
    assert got.columns == ["fight_id", "start_frame", "end_frame"]
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 20 and len({f for f, *_ in want}) < len(want)


def test_known_fight(spark):
    """Starts are back-dated to the window's first frame, ends to the gap's first frame."""
    rules = Rules(presence=4, enter=0.75, leave=0.25, fight_gap=3, engagement=2, engaged=1.0, disengaged=0.0, round_gap=2, shortest=1)
    hits = "1111111" + "00" + "0" + "11" + "1111" + "00000000000"
    rows = [(1, i + 1, c == "1", 1.0, 0) for i, c in enumerate(hits)]
    # the pair 8, 9 is all without hits from frame 9 on, and a gap at frame 10; hits are back at 11, 12
    assert step_by_step(rows, rules) == [(1, 1, 9), (1, 11, 18)]
    assert sorted(map(tuple, segmentation.segment(spark.createDataFrame(rows, SCHEMA), rules, block=4).collect())) == [(1, 1, 9), (1, 11, 18)]


def test_no_frames(spark):
    assert segmentation.segment(spark.createDataFrame([], SCHEMA), RULES).isEmpty()
