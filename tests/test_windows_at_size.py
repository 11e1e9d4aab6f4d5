"""Plans that keep their cost in line with the input."""

import contextlib
import io

from pyspark.sql import functions as F

from spanframe.operators import tracks
from spanframe.plans import QUERIES
from spanframe.plans.events import stepped_sample
from spanframe.plans.statistics import next_pending


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_a_sample_never_broadcasts_its_grid(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 6, 8), (1, 12, 9), (2, 9, 3)], "fight_id long, frame long, event_id long")
    grid = spark.createDataFrame([(f, x) for f in (1, 2) for x in (1, 5, 10, 11, 13)], "fight_id long, frame long")
    t = stepped_sample(rows, grid, ["event_id"])
    want = {(1, 5): (5, 7), (1, 11): (12, 9), (1, 13): (12, 9), (2, 10): (9, 3)}
    assert sorted(map(tuple, t.collect())) == [(f, x, *want.get((f, x), (None, None))) for f in (1, 2) for x in (1, 5, 10, 11, 13)]
    assert "Join" not in plan(t)


def test_next_pending_never_shrinks_a_window(spark):
    # pending: 3, 5 of a; none of b; one of c
    rows = [("a", 1, 1, 2, True), ("a", 1, 2, 3, None), ("a", 2, 1, 5, None), ("a", 2, 1, 6, False), ("b", 1, 1, 7, True), ("c", 1, 1, 8, None)]
    t = next_pending(spark.createDataFrame(rows, "action string, fight_id long, frame long, event_id long, is_verified boolean"))
    assert sorted(map(tuple, t.collect()), key=lambda r: r[1]) == [("a", 2, 3), ("a", 3, 5), ("a", 5, 3), ("a", 6, 3), ("b", 7, None), ("c", 8, None)]
    assert "unboundedfollowing" not in plan(t).lower()


def test_frames_explode_in_many_tasks(spark):
    for name in ("U-03-frames", "U-03"):
        t = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert name == "U-03" or t.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        assert "RepartitionByExpression" in plan(t)


def test_smoothing_deals_small_rows_of_one_key_to_many_tasks(spark):
    joints = F.expr("transform(sequence(0, 16), i -> array(id + i % 3 * 8.0D, 100 + i * 4.0D, 0.9D))")
    box = F.expr("named_struct('x1', id - 5.0D, 'y1', 95.0D, 'x2', id + 25.0D, 'y2', 170.0D)")
    t = spark.range(400).select((F.col("id") % 1).alias("key"), F.col("id").alias("frame"), box.alias("box"), joints.alias("skeleton"))
    t = tracks.smooth_boxes(t, "key", fps=50.0, block=32)
    # dealt once, and without the skeletons
    physical = plan(t).split("== Physical Plan ==")[1]
    assert physical.count("Exchange") == 1 and "Join" not in physical
    above = physical.split("Exchange")[0]
    assert "_hull" in above and "skeleton" not in above
    assert t.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert t.select(F.spark_partition_id()).distinct().count() > 1 and t.count() == 400
