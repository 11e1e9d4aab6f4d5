"""Keyed state: a stream's rounds equal the batch's, whatever the triggers, restarts and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators import segmentation
from spanframe.operators.segmentation import Rules
from spanframe.streaming import live, machines

RULES = Rules(presence=2.0, fight_gap=4.0, engagement=1.0, round_gap=2.0, shortest=0.7)
START = 1_700_000_000  # frame 0, as an instant
COLUMNS = "fight_id long, frame long, event_id long, hit boolean, fps double, at timestamp"


def frames(seed, fights=5, length=300):
    rng, rows = random.Random(seed), []
    for fight in range(fights):
        hit, frame = True, 0
        for _ in range(length):
            frame += rng.choice([0, 1, 1, 2])
            hit = hit != (rng.random() < 0.06)
            rows.append((fight, frame, len(rows), hit != (rng.random() < 0.1), 5.0))
    return rows


def write(spark, rows, cuts, folder):
    """Files that arrive one after the other, each with a span of frames."""
    df = spark.createDataFrame(rows, "fight_id long, frame long, event_id long, hit boolean, fps double")
    df = df.withColumn("at", F.timestamp_seconds(F.col("frame") + START))
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.where(f"frame > {a} and frame <= {b}").coalesce(1).write.parquet(f"{folder}/new-{n}")
        yield n


def run(session, folder, home, late="1 minute", idle_ms=10**9):
    stream = session.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return live.run_to_table(machines.live_rounds(stream, RULES, late, idle_ms), home)


@pytest.fixture(scope="module")
def session(spark):
    return live.stateful(spark)


def test_stream_equals_batch_over_restarts(session, tmp_path):
    rows = frames(1)
    want = sorted(map(tuple, segmentation.segment(session.createDataFrame(rows, COLUMNS.rsplit(",", 1)[0]), RULES, order=("frame", "event_id")).collect()))
    assert len(want) > 8
    for cuts in ([-1, 10**6], [-1, 3, 90, 91, 200, 10**6]):
        folder, home = f"file://{tmp_path}/in-{len(cuts)}", f"file://{tmp_path}/home-{len(cuts)}"
        for n in write(session, rows, cuts, folder):
            if n % 2 == 1:  # every second file finds a query that starts again from its checkpoint
                run(session, folder, home)
        got = machines.rounds_so_far(run(session, folder, home))
        assert sorted(map(tuple, got.collect())) == want
        again = machines.rounds_so_far(run(session, folder, home))
        assert sorted(map(tuple, again.collect())) == want


def test_repeated_and_late_frames_change_nothing(session, tmp_path):
    rows = frames(2, fights=2, length=150)
    want = sorted(map(tuple, segmentation.segment(session.createDataFrame(rows, COLUMNS.rsplit(",", 1)[0]), RULES, order=("frame", "event_id")).collect()))
    folder, home = f"file://{tmp_path}/in", f"file://{tmp_path}/home"
    list(write(session, rows, [-1, 60, 10**6], folder))
    run(session, folder, home)
    session.createDataFrame(rows, COLUMNS.rsplit(",", 1)[0]).withColumn("at", F.timestamp_seconds(F.col("frame") + START)).where("frame > 100").write.parquet(f"{folder}/again")
    assert sorted(map(tuple, machines.rounds_so_far(run(session, folder, home)).collect())) == want


def test_idle_fights_end_and_leave_no_state(session, tmp_path):
    rows = [(1, f, f, True, 5.0) for f in range(1, 60)] + [(2, f, f, True, 5.0) for f in range(1, 4000)]
    folder, home = f"file://{tmp_path}/in", f"file://{tmp_path}/home"
    for _ in write(session, rows, [-1, 100, 2000, 3000, 10**6], folder):
        emitted = run(session, folder, home, late="1 second", idle_ms=600_000)
    over = emitted.where("over")
    assert {(r.fight_id, r.start_frame, r.end_frame) for r in over.where("final").collect()} == {(1, 1, 59)}
    assert sorted(map(tuple, machines.rounds_so_far(emitted).collect())) == [(1, 1, 59), (2, 1, 3999)]
