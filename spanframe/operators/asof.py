"""As-of and nearest joins on the frame axis, as one sort instead of a range join.

Both sides are united and lined up by frame inside their key; a window then
carries the last (or next) row of the other side. ``block`` cuts a key into runs
of that many frames, each a group of its own; what crosses the cut is carried by
one small row per key and block, so that a key with most rows takes many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(both: DataFrame, key: str, block: int | None, order: list[Column], before: bool) -> Column | DataFrame:
    bounds = (Window.unboundedPreceding, Window.currentRow) if before else (Window.currentRow, Window.unboundedFollowing)
    pick = F.last if before else F.first
    if block is None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(*bounds)
        return both.withColumn("_found", pick("_mark", ignorenulls=True).over(w))
    both = both.withColumn("_block", F.floor(F.col("_at") / block))
    w = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(*bounds)
    both = both.withColumn("_found", pick("_mark", ignorenulls=True).over(w))
    ends = both.groupBy(key, "_block").agg((F.max_by if before else F.min_by)("_mark", F.when(F.col("_mark").isNotNull(), F.struct("_at", "_tie"))).alias("_end"))
    w = Window.partitionBy(key).orderBy("_block")
    w = w.rowsBetween(Window.unboundedPreceding, -1) if before else w.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(key, "_block", pick("_end", ignorenulls=True).over(w).alias("_carry"))
    return both.join(ends, [key, "_block"]).withColumn("_found", F.coalesce("_found", "_carry")).drop("_carry", "_block")


def _lined_up(points: DataFrame, marks: DataFrame, key: str, frame: str, mark_frame: str, tie: str, values: list[str], marks_first: bool) -> DataFrame:
    mark = F.struct(F.col(mark_frame).alias("_mf"), F.col(tie).alias("_mt"), *values)
    left = points.select(key, F.col(frame).alias("_at"), F.lit(1 if marks_first else 0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias("_mark"))
    right = marks.select(key, F.col(mark_frame).alias("_at"), F.lit(0 if marks_first else 1).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), mark.alias("_mark"))
    return left.unionByName(right)


def asof(points: DataFrame, marks: DataFrame, values: list[str], *, key: str = "fight_id", frame: str = "frame", mark_frame: str = "frame", tie: str = "event_id", forward: bool = False, block: int | None = None) -> DataFrame:
    """Each point with the ``values`` of the last mark at or before its frame
    (``forward``: of the first at or after it) in its key.

    Of marks in one frame the last (first) by ``tie`` counts. Without a mark the
    values are null. Adds ``mark_frame`` as well.
    """
    both = _lined_up(points, marks, key, frame, mark_frame, tie, values, marks_first=not forward)
    order = [F.col("_at"), F.col("_side"), F.col("_tie")]
    found = _carried(both, key, block, order, before=not forward).where(F.col("_point").isNotNull())
    kept = [c for c in points.columns if c not in values and c != "mark_frame"]
    return found.select(*(F.col(f"_point.{c}").alias(c) for c in kept), F.col("_found._mf").alias("mark_frame"), *(F.col(f"_found.{v}").alias(v) for v in values))


def nearest(points: DataFrame, marks: DataFrame, values: list[str], *, key: str = "fight_id", frame: str = "frame", tie: str = "event_id", within: int | Column | None = None, later_wins: bool = False, block: int | None = None) -> DataFrame:
    """Each point with the ``values`` of the mark nearest in frames, and ``distance``.

    ``within`` keeps marks that are strictly nearer. At equal distance the
    earlier mark wins, or the later one if ``later_wins``.
    """
    marks = marks.select(key, frame, tie, *[v for v in values if v not in (key, frame, tie)])
    pack = lambda out: F.struct(F.col("mark_frame").alias("f"), *values).alias(out)
    kept = [c for c in points.columns if c not in values and c != "mark_frame"]
    back = asof(points, marks, values, key=key, frame=frame, tie=tie, block=block).select(*kept, pack("_b"))
    both = asof(back, marks, values, key=key, frame=frame, tie=tie, forward=True, block=block).select(*kept, "_b", pack("_n"))
    before, after = F.col(frame) - F.col("_b.f"), F.col("_n.f") - F.col(frame)
    nearer = (after <= before) if later_wins else (after < before)
    chosen = F.when(before.isNull() | F.coalesce(nearer, F.lit(False)), F.col("_n")).otherwise(F.col("_b"))
    out = both.withColumn("_c", chosen).withColumn("distance", F.abs(F.col("_c.f") - F.col(frame)))
    if within is not None:
        out = out.withColumn("_c", F.when(F.col("distance") < within, F.col("_c"))).withColumn("distance", F.when(F.col("_c.f").isNotNull(), F.col("distance")))
    return out.select(*kept, F.col("_c.f").alias("mark_frame"), "distance", *(F.col(f"_c.{v}").alias(v) for v in values))
