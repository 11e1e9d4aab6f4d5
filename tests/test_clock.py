"""The clock's closed forms and folds against step-by-step versions."""

import random

from spanframe.operators import clock, smoothing
from spanframe.operators.folds import fold

FPS = 2


def fixpoint(rounds, frames):
    """One edit a pass: drop a short round before the last, else join over a short
    gap, else join the closest two of too many."""
    most = max(1, int((frames / FPS + 30) // 90))
    work = sorted(rounds)
    while len(work) > 1:
        short = [i for i, (s, e) in enumerate(work[:-1]) if e - s + 1 < 60 * FPS]
        gaps = [work[i + 1][0] - work[i][1] for i in range(len(work) - 1)]
        tight = [i for i, g in enumerate(gaps) if g < 30 * FPS]
        if short:
            del work[short[0]]
        elif tight or len(work) > most:
            i = tight[0] if tight else gaps.index(min(gaps))
            work[i : i + 2] = [(work[i][0], work[i + 1][1])]
        else:
            break
    return work


def test_plausible_is_the_fixpoint(spark):
    rng, rounds, frames = random.Random(5), [], []
    for fight in range(120):
        at = 1
        for _ in range(rng.randint(1, 9)):
            at += rng.choice([1, 20, 59, 60, 61, 90, 90, 150])
            end = at + rng.choice([10, 100, 118, 119, 120, 300, 400])
            rounds.append((fight, at, end))
            at = end
        frames.append((fight, rng.choice([at, at + 500, at // 3 + 1])))
    out = clock.plausible(spark.createDataFrame(rounds, "fight_id long, start_frame long, end_frame long"), spark.createDataFrame(frames, "fight_id long, frames long"), FPS)
    want = sorted((f, *r) for f, n in frames for r in fixpoint([(s, e) for g, s, e in rounds if g == f], n))
    assert sorted(map(tuple, out.select("fight_id", "start_frame", "end_frame").collect())) == want
    assert any(sum(g == f for g, *_ in rounds) > sum(g == f for g, *_ in want) > 1 for f, _ in frames)
    none = spark.createDataFrame([], "fight_id long, start_frame long, end_frame long")
    assert clock.plausible(none, spark.createDataFrame(frames, "fight_id long, frames long"), FPS).isEmpty()


def test_monotone_follows_the_last_accepted(spark):
    rng, rows = random.Random(6), []
    for key in (None, 1, 2, 3):
        t = 300
        for frame in range(200):
            t += rng.choice([-3, -1, 0, 1, 2]) * (-1 if key == 2 else 1)
            rows.append((key, frame, None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 40, -5]), "x"))
    df = spark.createDataFrame(rows, "key long, frame long, secs long, last string")
    got = {(r.key, r.frame): r.rejected for r in clock.monotone(df.where("key is not null"), "key").collect()}
    for key in (1, 2, 3):
        seq = [(f, s) for k, f, s, _ in rows if k == key]
        read = [s for _, s in seq if s is not None]
        falls, rises = (sum(d(b - a) for a, b in zip(read, read[1:])) for d in (lambda x: x < 0, lambda x: x > 0))
        way, last = 1 if falls >= rises else -1, None
        for frame, s in seq:
            bad = s is not None and last is not None and (s - last) * way > 2
            assert got[key, frame] == bad
            last = last if s is None or bad else s
    assert any(got.values())


def test_fold_carries_its_state_over_batches(spark):
    def total(state, row):
        state = (state or 0) + row["id"]
        return state, (state,)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("if(id % 3 = 0, null, id % 3) as key", "id")
        out = fold(df, total, "total long", "key", order=["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 100
    for r in out:
        assert r.total == sum(range(r.id % 3, r.id + 1, 3))


def test_increments_are_confirmed(spark):
    numbers = [1, 1, 2, 1, None, 2, 2, None, 2, 4, 4, 4, 3, 3, 2, 3, 3, 3, 3]
    df = spark.createDataFrame([(7, i, n) for i, n in enumerate(numbers)], "key long, frame long, round_num long")
    assert sorted(map(tuple, clock.confirmed_increments(df, "key").collect())) == [(7, 5, 2), (7, 15, 3)]


def test_clock_decides_and_detection_fills_in(spark):
    found = spark.createDataFrame([(1, 50, 90), (1, 95, 130), (2, 5, 9), (3, 5, 9)], "fight_id long, start_frame long, end_frame long")
    spans = "fight_id long, round_number int, start_frame long, end_frame long, start_anchored boolean, end_anchored boolean"
    read = spark.createDataFrame([(1, 1, 60, 100, False, False), (1, 2, 200, 900, True, True), (2, 1, 700, 900, True, True)], spans)
    frames = spark.createDataFrame([(1, 500), (2, 500), (3, 500)], "fight_id long, frames long")
    out = sorted(map(tuple, clock.reconciled(read, found, frames).collect()))
    assert out == [(1, 50, 130, "clock"), (1, 200, 500, "clock"), (2, 5, 9, "detection"), (3, 5, 9, "detection")]


def test_fit_drops_what_is_off(spark):
    rows = [(1, 1, f, 100 - f // FPS + (50 if f == 8 else 0), None) for f in range(2, 20, 2)]
    df = spark.createDataFrame(rows, "key long, run long, frame long, secs long, round_num long")
    assert [tuple(r) for r in clock.fit_intercepts(df, FPS, "key").collect()] == [(1, 1, 100.0, 8, 1, 99, 91)]
    runs = clock.split_runs(spark.createDataFrame([(1, 1, 90, 1), (1, 2, 80, None), (1, 3, 111, None), (1, 4, 110, 1), (1, 5, None, 2), (1, 6, 100, 2)], "key long, frame long, secs long, round_num long"), "key")
    assert [r.run for r in runs.orderBy("frame").collect()] == [1, 1, 2, 2, 3, 3]


def test_filter_holds_over_doubtful_rows(spark):
    rows = [(1, 1, 10.0, 0.9), (1, 2, 999.0, 0.1), (1, 3, None, 0.9), (1, 4, 10.0, 0.9), (1, 5, 20.0, None), (1, 6, 12.0, 0.4), (2, 9, 3.0, 0.9)]
    df = spark.createDataFrame(rows, "key long, frame long, x double, confidence double")
    got = {r.frame: r.smooth for r in smoothing.one_euro(df, "key").collect()}
    assert {f: got[f] for f in (1, 2, 3, 4, 5, 9)} == {1: 10.0, 2: 999.0, 3: None, 4: 10.0, 5: 20.0, 9: 3.0}
    assert 10 < got[6] < 12
    assert smoothing.one_euro(df.limit(0), "key").isEmpty()


def test_verdicts_name_the_first_reason(spark):
    videos = [(1, 0, 0, None), (2, 900, 800, 0.125), (3, 900, 90, 1.0), (4, 900, 900, 0.5), (5, 900, 900, 0.5), (6, 900, 900, 0.5), (7, 900, 900, 0.375)]
    rounds = [(3, 1, 500, "clock"), (4, 1, 4, "clock"), (5, 1, 500, "clock"), (6, 1, 500, "clock"), (7, 1, 500, "detection")]
    out = clock.verdicts(
        spark.createDataFrame(rounds, "fight_id long, start_frame long, end_frame long, source string"),
        spark.createDataFrame([(5, 9), (5, 30), (6, 10)], "fight_id long, support long"),
        spark.createDataFrame(videos, "fight_id long, frames long, valid_frames long, timer_coverage double"),
        FPS,
    )
    got = {r.fight_id: r for r in out.collect()}
    assert [got[i].reason for i in range(1, 8)] == [clock.EMPTY, clock.NO_ROUNDS, clock.LOW_RATIO % 0.1, clock.TOO_SHORT % 2.0, "", "", ""]
    assert got[4].review_reason == clock.GATE_FAILED and got[5].review_reason == clock.THIN % (1, 2, 9)
    assert (got[6].is_valid, got[6].needs_review, got[6].review_reason) == (True, False, "")
    assert got[7].review_reason == clock.NO_CLOCK % 38


def test_rounds_of_fits_snap_and_anchor(spark):
    fits = [(1, 1, 300.0, 9, 0, 290, 10), (1, 2, 700.25, 3, 0, 150, 60), (1, 3, 900.0, 2, 0, 100, 1), (1, 4, 5000.0, 9, 0, 300, 0), (1, 5, 1400.0, 5, 1, 330, 21)]
    df = spark.createDataFrame(fits, "key long, run long, intercept double, inliers long, rejected long, highest long, lowest long")
    out = clock.rounds_of_fits(df, spark.createDataFrame([(1, 2000)], "key long, frames long"), FPS, "key")
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(1, 1, 600, 300, 9, True, True), (2, 1040, 1400, 180, 3, False, False)]
