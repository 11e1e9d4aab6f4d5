"""Algebra of closed intervals [start_frame, end_frame] in groups.

Frames are never exploded: an interval is a row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, E = "start_frame", "end_frame"


def length(start: Column, end: Column) -> Column:
    return F.greatest(end - start + 1, F.lit(0))


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Frames that two intervals share."""
    return F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1, F.lit(0))


def iou(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Shared frames over frames in either."""
    both = overlap(a, b)
    either = length(*a) + length(*b) - both
    return F.when(either != 0, both / either).otherwise(F.lit(0.0))


def coalesced(spans: DataFrame, *keys: str, touch: int = 1) -> DataFrame:
    """The union of the spans of each key: (keys, start_frame, end_frame).

    Spans at most ``touch`` frames apart are one.
    """
    before = Window.partitionBy(*keys).orderBy(S, E).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(E).over(before)
    t = spans.where(F.col(E) >= F.col(S)).withColumn("_new", F.when(reach.isNull() | (F.col(S) > reach + touch), 1).otherwise(0))
    t = t.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy(S, E).rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "_island").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("_island")


def subtracted(spans: DataFrame, cuts: DataFrame, *keys: str, carry: list[str] = ()) -> DataFrame:
    """Pieces of the spans outside all ``cuts`` of their key.

    The cuts are united first; a span with c cuts inside leaves at most c + 1
    pieces. ``carry`` names columns that pieces inherit.
    """
    cut = coalesced(cuts.select(*keys, S, E), *keys).select(*keys, F.col(S).alias("_cs"), F.col(E).alias("_ce"))
    left = spans.select(*keys, S, E, *[c for c in carry if c not in keys])
    hit = [left[k] == cut[k] for k in keys] + [cut._cs <= left[E], cut._ce >= left[S]]
    whole = [c for c in left.columns]
    pairs = left.join(cut, hit, "left").select(*(left[c] for c in whole), "_cs", "_ce")
    holes = F.array_sort(F.collect_list(F.when(F.col("_cs").isNotNull(), F.struct("_cs", "_ce"))))
    t = pairs.groupBy(*whole).agg(holes.alias("_holes"))
    starts = F.concat(F.array(F.col(S)), F.transform("_holes", lambda h: h["_ce"] + 1))
    ends = F.concat(F.transform("_holes", lambda h: h["_cs"] - 1), F.array(F.col(E)))
    t = t.withColumn("_piece", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e")))).where("_piece.s <= _piece.e")
    return t.select(*[c for c in whole if c not in (S, E)], F.col("_piece.s").alias(S), F.col("_piece.e").alias(E))


def scored_spans(rounds: DataFrame, excluded: DataFrame, *keys: str) -> DataFrame:
    """Frames that count: in a round and not excluded, as disjoint spans."""
    return subtracted(coalesced(rounds.select(*keys, S, E), *keys), excluded, *keys)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Deal rows that are going to explode evenly to four tasks a core: by their bytes they
    are few, so that they would be left to one task, and with them all that comes out."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def contained(points: DataFrame, spans: DataFrame, key: str = "fight_id", how: str = "left_semi", frame: str = "frame") -> DataFrame:
    """Points inside (left_semi) or outside (left_anti) the spans of their key."""
    return points.join(spans, (points[key] == spans[key]) & points[frame].between(spans[S], spans[E]), how)


def banded(points: DataFrame, spans: DataFrame, band: int, key: str = "fight_id", frame: str = "frame", extra: list[str] = ()) -> DataFrame:
    """Inner containment join through bands of ``band`` frames, for keys with very
    many spans: both sides meet on (key, band), so that a key is spread over tasks
    and a point meets only the spans that reach into its band."""
    cells = spans.select(key, S, E, *extra).withColumn("_band", F.explode(F.sequence(F.floor(F.col(S) / band), F.floor(F.col(E) / band))))
    t = points.withColumn("_band", F.floor(F.col(frame) / band)).join(cells, [key, "_band"])
    return t.where(F.col(frame).between(F.col(S), F.col(E))).drop("_band")


def spans_of_marks(marks: DataFrame, last_end: DataFrame | None, fallback: Column | int, *, key: str = "fight_id", frame: str = "frame", tie: str = "event_id") -> DataFrame:
    """Change points to spans: each runs to the frame before the next one; the last
    to the end of the span of ``last_end`` that holds it, else to ``fallback``."""
    w = Window.partitionBy(key).orderBy(frame, tie)
    t = marks.withColumn("_next", F.lead(frame).over(w))
    if last_end is not None:
        r = last_end.select(F.col(key).alias("_k"), F.col(S).alias("_rs"), F.col(E).alias("_re"))
        t = t.join(r, F.col("_next").isNull() & (F.col(key) == F.col("_k")) & F.col(frame).between(F.col("_rs"), F.col("_re")), "left")
        t = t.drop("_k", "_rs")
    else:
        t = t.withColumn("_re", F.lit(None).cast("long"))
    end = F.coalesce(F.col("_next") - 1, "_re", fallback if isinstance(fallback, Column) else F.lit(fallback))
    return t.withColumn(S, F.col(frame)).withColumn(E, end).drop("_next", "_re")


def elementary(spans: DataFrame, *keys: str) -> DataFrame:
    """Cut the axis of each key at every start and after every end: consecutive
    segments (keys, start_frame, end_frame) inside which no span begins or ends."""
    cuts = spans.select(*keys, F.explode(F.array(F.col(S), F.col(E) + 1)).alias(S)).distinct()
    nxt = F.lead(S).over(Window.partitionBy(*keys).orderBy(S))
    return cuts.withColumn(E, nxt - 1).where(F.col(E).isNotNull())
