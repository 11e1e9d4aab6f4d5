"""One-to-one matching and suppression of events, cut into independent groups first.

A gap wider than the tolerance parts two events for good, so a fight falls into
small groups that are solved apart; they stream through a task in batches of many. A
fight dense all through is one group, in one task's memory: its rows, and a table of
its pairs within the tolerance.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def gap_groups(df: DataFrame, gap: int, *keys: str, frame: str = "frame", ties: tuple[str, ...] = (), out: str = "begins") -> DataFrame:
    """Mark the rows of a key that begin a run of rows whose neighbours are at most
    ``gap`` apart. Partitions hold whole keys, in the order of keys, frame and ``ties``."""
    w = Window.partitionBy(*keys).orderBy(frame, *ties)
    begins = F.coalesce(F.col(frame) - F.lag(frame).over(w) > gap, F.lit(True))
    return df.repartition(*keys).withColumn(out, begins).sortWithinPartitions(*keys, frame, *ties)


def whole_groups(batches: Iterator[pa.RecordBatch], begins: str = "begins") -> Iterator[pa.Table]:
    """Cut a stream of rows in order so that no group is torn: many small groups go
    through at once, and no more is held than a batch and the group that is open."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(begins).to_numpy(zero_copy_only=False))
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            if sum(b.num_rows for b in held):
                yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _spans(table: pa.Table, begins: str = "begins") -> tuple[np.ndarray, np.ndarray]:
    """First rows of a table's groups, and their lengths."""
    starts = np.flatnonzero(table[begins].to_numpy())
    return starts, np.diff(starts, append=table.num_rows)


def best_pairs(truth: np.ndarray, found: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """Most pairs within the tolerance, then least total offset, for two sorted
    lists of frames. On a line an optimum without crossings exists, so a table over
    suffixes finds it; of equal ones earlier truth and earlier finds pair first.

    Of row i only the columns [low, high] within the tolerance are held: before them
    it is constant, behind them equal to the next row. Memory is the number of
    pairs within the tolerance, not of all pairs.
    """
    n, m = len(truth), len(found)
    low, high = np.searchsorted(found, truth - tolerance, "left"), np.searchsorted(found, truth + tolerance, "right")
    pair = tolerance * min(n, m) + 1  # one more pair outweighs all offsets
    gains = [pair - np.abs(found[a:b].astype(np.int64) - int(t)) for t, a, b in zip(truth, low, high)]
    rows: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    after, start = np.zeros(1, np.int64), m  # the next row and its first column
    for i in range(n - 1, -1, -1):
        a, b = low[i], high[i]
        row = after[np.maximum(np.arange(a, b + 1), start) - start]
        row[:-1] = np.maximum(row[:-1], row[1:] + gains[i])
        rows[i] = after = np.maximum.accumulate(row[::-1])[::-1]
        start = a

    def best(i: int, j: int) -> int:
        i = max(i, int(np.searchsorted(high, j, "left")))
        return 0 if i >= n else int(rows[i][max(j, low[i]) - low[i]])

    pairs, i, j = [], 0, 0
    while i < n and j < m:
        here = best(i, j)
        if low[i] <= j < high[i] and here == best(i + 1, j + 1) + int(gains[i][j - low[i]]):
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif here == best(i, j + 1):
            j += 1
        else:
            i += 1
    return pairs


def match(truth: DataFrame, found: DataFrame, tolerance: int, *keys: str, frame: str = "frame", name: str = "event_id") -> DataFrame:
    """Optimal one-to-one matching inside each key: keys, truth_id, found_id and
    offset (found - truth); unmatched rows have a null partner."""
    side = lambda t, v: t.select(*keys, F.col(frame).cast("long").alias("frame"), F.col(name).cast("long").alias("id"), F.lit(v).alias("side"))
    both = gap_groups(side(truth, 0).unionByName(side(found, 1)), tolerance, *keys, ties=("id", "side"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            at, ids, found = pc.fill_null(table["frame"], 0).to_numpy(), table["id"], table["side"].to_numpy() == 1
            partner = np.full(len(at), -1)
            starts, rows = _spans(table)
            n_found = np.add.reduceat(found.astype(np.int64), starts)
            two = starts[(rows == 2) & (n_found == 1)]  # neighbours, so within the tolerance
            partner[two], partner[two + 1] = two + 1, two
            for i in np.flatnonzero((rows > 2) & (n_found > 0) & (n_found < rows)):
                here = np.arange(starts[i], starts[i] + rows[i])
                a, b = here[~found[here]], here[found[here]]
                for x, y in best_pairs(at[a], at[b], tolerance):
                    partner[a[x]], partner[b[y]] = b[y], a[x]
            kept = np.flatnonzero(~found | (partner < 0))  # a pair is told by its truth
            other = partner[kept]
            alone, lone_find = other < 0, found[kept]
            own = ids.take(pa.array(kept))
            columns = [table[k].take(pa.array(kept)) for k in keys] + [
                pc.if_else(pa.array(lone_find), None, own),
                pc.if_else(pa.array(lone_find), own, ids.take(pa.array(other, mask=alone))),
                pa.array(at[other] - at[kept], pa.int64(), mask=alone),
            ]
            yield from pa.table(columns, names=[*keys, "truth_id", "found_id", "offset"]).combine_chunks().to_batches()

    schema = StructType([*(both.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("truth_id", "found_id", "offset"))])
    return both.mapInArrow(solve, schema)


def peaks(scores: DataFrame, radius: int, *keys: str, threshold: float | None = None, frame: str = "frame", score: str = "score", name: str = "event_id") -> DataFrame:
    """Greedy suppression: strongest first (ties: earlier frame, then id), dropping
    what lies within ``radius`` frames of a kept row of its key, and at once what
    scores below ``threshold``."""
    if threshold is not None:
        scores = scores.where(F.col(score) >= threshold)
    t = gap_groups(scores.select(*keys, frame, score, name), radius, *keys, frame=frame, ties=(name,))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            frames, scored = table[frame].to_numpy(), table[score].to_numpy()
            starts, rows = _spans(table)
            stays = np.zeros(table.num_rows, bool)
            stays[starts[rows == 1]] = True
            for i in np.flatnonzero(rows > 1):
                at = []
                # rows are in the order of frame and id, and the sort is stable
                for j in starts[i] + np.argsort(-scored[starts[i] : starts[i] + rows[i]], kind="stable"):
                    here = bisect_left(at, frames[j])  # kept frames, sorted
                    if all(abs(x - frames[j]) > radius for x in at[max(here - 1, 0) : here + 1]):
                        stays[j] = True
                        at.insert(here, frames[j])
            yield from table.drop_columns(["begins"]).filter(pa.array(stays)).combine_chunks().to_batches()

    return t.mapInArrow(keep, t.drop("begins").schema)
