"""Which of the people in a frame are the fighters: those that masks point at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least overlap of a person and a mask, and people that are kept.
LEAST_OVERLAP, MOST = 0.35, 2


def overlaps(people: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Intersection over union of all boxes (n, 4) with all others (m, 4)."""
    low, high = np.maximum(people[:, None, :2], masks[None, :, :2]), np.minimum(people[:, None, 2:], masks[None, :, 2:])
    common = np.prod(np.clip(high - low, 0, None), axis=2)
    area = lambda b: np.prod(b[:, 2:] - b[:, :2], axis=1)
    whole = area(people)[:, None] + area(masks)[None] - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)


def assign(cost: np.ndarray) -> np.ndarray:
    """A column for each row of a square matrix, each once, with the least sum: rows are
    added one by one along shortest alternating paths."""
    n = len(cost)
    row_of, by_row, by_column = np.full(n, -1), np.zeros(n), np.zeros(n)
    for row in range(n):
        best, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
        here, at, behind = row, 0.0, -1
        rows_seen = []
        while True:
            rows_seen.append((here, at))
            reach = at + cost[here] - by_row[here] - by_column
            shorter = ~done & (reach < best)
            best[shorter], came[shorter] = reach[shorter], behind
            column = int(np.where(done, np.inf, best).argmin())
            at, behind = best[column], column
            done[column] = True
            if row_of[column] < 0:
                break
            here = row_of[column]
        for r, then in rows_seen:
            by_row[r] += at - then
        by_column[done] += best[done] - at
        while behind >= 0:  # turn the path about
            before = came[behind]
            row_of[behind] = row_of[before] if before >= 0 else row
            behind = before
    out = np.full(n, -1)
    out[row_of] = np.arange(n)
    return out


def chosen(people: np.ndarray, confidence: np.ndarray, masks: np.ndarray) -> list[int]:
    """The people that masks point at, one to one with the most overlap in all, but no
    pair below LEAST_OVERLAP; of those the MOST confident ones, surest first."""
    if not len(people) or not len(masks):
        return []
    over = overlaps(people, masks)
    n = max(over.shape)
    cost = np.ones((n, n))
    cost[: len(people), : len(masks)] = 1 - over
    pairs = [(p, m) for p, m in enumerate(assign(cost)) if p < len(people) and m < len(masks) and over[p, m] >= LEAST_OVERLAP]
    return sorted((p for p, _ in pairs), key=lambda p: -confidence[p])[:MOST]


def select_people(people: DataFrame, masks: DataFrame, key: str = "fight_id") -> DataFrame:
    """key, frame, no and rank (from 1) of the people that are kept in each frame.

    ``people``: key, frame, no, x1, y1, x2, y2, confidence; ``masks``: key, frame, no, x1, y1,
    x2, y2. The boxes of a frame, a few, are collected; frames are dealt over tasks.
    """
    flat = lambda *c: F.array(*(F.col(x).cast("double") for x in c))
    row = F.struct(F.col("no").cast("long").alias("no"), flat("x1", "y1", "x2", "y2").alias("b"))
    side = lambda t, extra: t.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct(row["no"].alias("no"), row["b"].alias("b"), extra.alias("c")))).alias("_s"))
    p = side(people, F.col("confidence").cast("double")).select(key, "frame", F.col("_s.no").alias("nos"), F.flatten("_s.b").alias("people"), F.col("_s.c").alias("confidence"))
    t = p.join(side(masks, F.lit(0.0)).select(key, "frame", F.flatten("_s.b").alias("masks")), [key, "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for nos, people, sure, masks in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("nos", "people", "confidence", "masks")), strict=True):
                kept.append([int(nos[i]) for i in chosen(np.asarray(people).reshape(-1, 4), np.asarray(sure), np.asarray(masks).reshape(-1, 4))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1)), pa.array(kept, pa.list_(pa.int64()))], names=[*batch.schema.names[:2], "kept"])

    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    found = t.mapInArrow(run, f"{key} {kinds[key]}, frame {kinds['frame']}, kept array<bigint>")
    return found.select(key, "frame", F.posexplode("kept").alias("_i", "no")).select(key, "frame", "no", (F.col("_i") + 1).alias("rank"))
