"""Where the scoreboard lies: the place that most of its boxes share, and whether it reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.folds import fold_arrays

#: Pixels around the boxes, frames that are tried, share of them that must read.
PADDING, TRIED, MIN_RATE = 20, 8, 0.2


def clustered(boxes: DataFrame, *keys: str, order: str = "no") -> DataFrame:
    """Add ``cluster``: in order, a box joins the first cluster whose mean centre is no
    further than the key's median box width and height (1 at least), or opens one. The
    order matters, as means move; ``order`` must tell a key's boxes apart."""
    sizes = boxes.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.median(F.col("x2") - F.col("x1"))).alias("_tx"), F.greatest(F.lit(1.0), F.median(F.col("y2") - F.col("y1"))).alias("_ty"))
    t = boxes.join(sizes, list(keys)).withColumns({"_cx": (F.col("x1") + F.col("x2")) / 2.0, "_cy": (F.col("y1") + F.col("y2")) / 2.0})

    def step(state, c):
        sums, n = state or (np.zeros((0, 2)), np.zeros(0))
        out = []
        for x, y, tx, ty in zip(*(c[k].tolist() for k in ("_cx", "_cy", "_tx", "_ty")), strict=True):
            near = np.flatnonzero((np.abs(sums[:, 0] / n - x) <= tx) & (np.abs(sums[:, 1] / n - y) <= ty)) if len(n) else []
            if len(near):
                i = int(near[0])
                sums[i] += (x, y)
                n[i] += 1
            else:
                i = len(n)
                sums, n = np.vstack([sums, [x, y]]), np.append(n, 1.0)
            out.append(i)
        return (sums, n), [out]

    return fold_arrays(t, step, ["_cx", "_cy", "_tx", "_ty"], "cluster int", *keys, order=[order]).drop("_tx", "_ty", "_cx", "_cy")


def dominant(boxes: DataFrame, *keys: str, order: str = "no") -> DataFrame:
    """The boxes of each key's largest cluster; of equal ones that opened first."""
    t = clustered(boxes, *keys, order=order)
    best = t.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_n"))
    best = best.groupBy(*keys).agg(F.max_by("cluster", F.struct("_n", -F.col("cluster"))).alias("cluster"))
    return t.join(best, [*keys, "cluster"], "left_semi").drop("cluster")


def tried(index: Column, n: Column, most: int = TRIED) -> Column:
    """Whether sample ``index`` (from 0) of ``n`` is one of the ``most`` that are spread over them."""
    used = F.least(F.lit(most), n)
    i = F.ceil(index * used / n)
    return (i < used) & (F.floor(i * n / used) == index)


def region(boxes: DataFrame, samples: DataFrame, videos: DataFrame, key: str = "fight_id") -> DataFrame:
    """The scoreboard's place: key, x, y, w, h, match_rate, accepted. ``boxes``: key, no,
    kind ("timer" or "round"), x1, y1, x2, y2; stray ones of each kind are dropped first.
    ``samples``: key, frame, reads; ``videos``: key, width, height. Without boxes a
    video has no row."""
    kept = dominant(boxes, key, "kind")
    around = kept.groupBy(key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    w = Window.partitionBy(key)
    spread = samples.withColumns({"_i": F.row_number().over(w.orderBy("frame")) - 1, "_n": F.count(F.lit(1)).over(w)}).where(tried(F.col("_i"), F.col("_n")))
    rates = spread.groupBy(key).agg((F.count_if("reads") / F.count(F.lit(1))).alias("match_rate"))
    t = around.join(videos, key).join(rates, key, "left")
    left, top = F.greatest(F.lit(0), F.col("x1") - PADDING), F.greatest(F.lit(0), F.col("y1") - PADDING)
    rate = F.coalesce("match_rate", F.lit(0.0))
    return t.select(
        key, left.alias("x"), top.alias("y"), (F.least("width", F.col("x2") + PADDING) - left).alias("w"), (F.least("height", F.col("y2") + PADDING) - top).alias("h"),
        rate.alias("match_rate"), (rate >= MIN_RATE).alias("accepted"),
    )
