"""A sequence of frames thinned out for plots, with the reading next to each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.asof import nearest
from spanframe.operators.segmentation import BLOCK, number_rows

#: Seconds between two points.
STEP = 0.5


def debug_series(frames: DataFrame, readings: DataFrame, values: list[str], key: str = "fight_id", order: tuple[str, ...] = ("frame",), block: int = BLOCK) -> DataFrame:
    """Every n-th of a key's ``frames`` (STEP seconds of its fps, at least one frame) with
    ``values`` of the reading nearest to it, however far (ties: the earlier), and null
    without readings. ``frames``: key, frame, event_id, fps and more; ``readings``: key,
    frame, event_id and the values, one a frame."""
    every = F.greatest(F.lit(1), F.floor(F.col("fps") * STEP).cast("long"))
    t = number_rows(frames, key, order=list(order), block=block, out="_n").where(F.col("_n") % every == 0).drop("_n")
    return nearest(t, readings, values, key=key, block=block).drop("mark_frame", "distance")
