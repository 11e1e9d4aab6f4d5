"""Training windows of fixed shape and the samples of a data set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spanframe.functions.geometry import CONFIDENT, scale, torso
from spanframe.operators.asof import nearest
from spanframe.operators.intervals import contained
from spanframe.operators.segmentation import number_rows

# ---------------------------------------------------------------- fixed values: the model's input

#: Classes (0: no strike) and targets by index.
CLASSES = ("none", "jab", "cross", "hook", "uppercut", "kick", "knee")
TARGETS = ("head", "body", "leg")
#: Steps a second, steps of a window, and more on each side to shift it by.
HERTZ, STEPS, JITTER = 25, 31, 3
TOTAL = STEPS + 2 * JITTER
#: Joints, and those that change places in a mirror.
JOINTS = 17
MIRRORED = ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16))
#: Bound of normalised coordinates.
CLIP = 8.0
#: Seconds around a label without negatives; random negatives a positive.
EXCLUSION_SECONDS, RANDOM_SHARE = 1.0, 1.0

PERSON_CHANNELS = JOINTS * 3 + 1
CHANNELS = 2 * PERSON_CHANNELS


# ---------------------------------------------------------------- windows


def present(people: DataFrame) -> DataFrame:
    """The people with a whole skeleton: only these count as seen."""
    return people.where(F.col("skeleton").isNotNull() & (F.size("skeleton") == JOINTS))


def centre_of(person: Column) -> tuple[Column, Column]:
    """The middle of a person's torso, or else of its box."""
    t, b = torso(person["skeleton"]), person["box"]
    return tuple(F.coalesce((t[f"{a}1"] + t[f"{a}2"]) / 2, (b[f"{a}1"] + b[f"{a}2"]) / 2) for a in "xy")


def size_of(person: Column) -> Column:
    """The scale of a person's skeleton, or else a third of the box's height, 10 at least."""
    b = person["box"]
    return F.coalesce(scale(person["skeleton"]), F.greatest((b["y2"] - b["y1"]) / 3, F.lit(10.0)))


def _tensor(people: pa.Array, x: np.ndarray, y: np.ndarray, size: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Channels (n, PERSON_CHANNELS, TOTAL) of n requests with TOTAL flat skeletons each (null: not seen)."""
    n, seen = len(x), people.is_valid().to_numpy(zero_copy_only=False)
    joints = np.zeros((n * TOTAL, JOINTS, 3))
    joints[seen] = people.flatten().to_numpy(zero_copy_only=False).reshape(-1, JOINTS, 3)
    joints = joints.reshape(n, TOTAL, JOINTS, 3)
    order = np.arange(JOINTS)
    for pair in MIRRORED:
        order[list(pair)] = pair[::-1]
    joints[flip] = joints[flip][:, :, order]
    place = (joints[..., :2] - np.stack([x, y], axis=1)[:, None, None]) / size[:, None, None, None]
    place[flip, ..., 0] *= -1
    place[joints[..., 2] < CONFIDENT] = 0
    seen = seen.reshape(n, TOTAL)
    out = np.concatenate([np.clip(place, -CLIP, CLIP), joints[..., 2:]], axis=3).reshape(n, TOTAL, -1) * seen[..., None]
    return np.concatenate([out, seen[..., None]], axis=2).transpose(0, 2, 1)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_own, _x, _y, _size, _flip, _steps) to (_own, window), a few hundred at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            place = [part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            steps = part.column(5).flatten()
            x = np.concatenate([_tensor(people, *place) for people in steps.flatten()[1:]], axis=1)
            rows = pa.ListArray.from_arrays(np.arange(len(x) * CHANNELS + 1, dtype=np.int32) * TOTAL, pa.array(x.reshape(-1)))
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * CHANNELS, rows)
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["_own", "window"])


def windows(requests: DataFrame, people: DataFrame, key: str = "fight_id") -> DataFrame:
    """The requests with ``window``, CHANNELS arrays of TOTAL steps: the person asked for,
    then the opponent, around the first one's place in the middle and in units of its
    size, mirrored so that the opponent is ahead. Requests whose person is not seen in
    their frame are left out.

    ``requests``: id, key, frame, corner, fps, n_frames. ``people``: key, corner (0, 1),
    frame, box, skeleton, one row at most for each. The steps lie on a grid of time, so
    the shape is the same at any frame rate; steps beyond the video repeat its edge. All
    are equi joins on (key, frame); a request's TOTAL steps are the only thing that is
    collected, and numpy makes its tensor of them.
    """
    pair = present(people).groupBy(key, "frame").agg(*(F.max_by(F.struct("box", "skeleton"), F.when(F.col("corner") == c, 1)).alias(f"p{c}") for c in (0, 1)))
    mine = lambda same: F.when(F.col("corner") == (0 if same else 1), F.col("p0")).otherwise(F.col("p1"))
    asked = requests.select(F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("_own"), "id", key, "frame", "corner", "fps", "n_frames")
    t = asked.where(F.col("frame") < F.col("n_frames")).join(pair, [key, "frame"]).withColumns({"_a": mine(True), "_o": mine(False)}).where(F.col("_a").isNotNull())
    (x, y), (ahead, _) = centre_of(F.col("_a")), centre_of(F.col("_o"))
    t = t.withColumns({"_x": x, "_y": y, "_size": size_of(F.col("_a")), "_ahead": F.when(F.col("_o").isNotNull(), ahead)}).drop("p0", "p1", "_a", "_o")
    grid = t.select("_own", "id", key, "corner", "_x", "_y", "_size", "_ahead", F.col("frame").alias("_at"), "fps", "n_frames", F.explode(F.sequence(F.lit(0), F.lit(TOTAL - 1))).alias("_step"))
    at = F.rint(F.col("_at") + (F.col("_step") - (TOTAL - 1) / 2) / HERTZ * F.col("fps")).cast("long")
    grid = grid.withColumn("frame", F.greatest(F.lit(0), F.least(at, F.col("n_frames") - 1))).join(pair, [key, "frame"], "left")
    grid = grid.withColumns({"_a": mine(True), "_o": mine(False)})
    grid = grid.withColumn("_ox", F.when(F.col("_o").isNotNull(), centre_of(F.col("_o"))[0]))
    # the opponent in the middle frame, or else where it is seen next to it
    seen = F.min_by("_ox", F.when(F.col("_ox").isNotNull(), F.struct(F.abs(F.col("frame") - F.col("_at")), "_step")))
    flat = lambda p: F.flatten(F.transform(F.col(f"{p}.skeleton"), lambda j: j.cast("array<double>"))).alias(p)
    steps = F.array_sort(F.collect_list(F.struct("_step", flat("_a"), flat("_o"))))
    t = grid.groupBy("id").agg(F.first("_own").alias("_own"), *(F.first(c).alias(c) for c in ("_x", "_y", "_size")), F.coalesce(F.first("_ahead"), seen).alias("_ahead"), steps.alias("_steps"))
    flip = F.coalesce(F.col("_ahead") < F.col("_x"), F.lit(False))
    t = t.select("_own", "_x", "_y", F.col("_size").cast("double").alias("_size"), flip.alias("_flip"), "_steps")
    schema = StructType([t.schema["_own"], StructField("window", ArrayType(ArrayType(DoubleType())))])
    return t.mapInArrow(_build, schema).select("_own.*", "window")


# ---------------------------------------------------------------- samples


def _away(points: DataFrame, labels: DataFrame, key: str, radius: Column) -> DataFrame:
    """Points (key, corner, frame, event_id) with no label of their corner within ``radius`` frames."""
    both = lambda t: t.withColumn("_k", F.struct(key, "corner"))
    t = nearest(both(points), both(labels).select("_k", "frame", "event_id", F.lit(1).alias("_label")), ["_label"], key="_k")
    return t.where(F.col("distance").isNull() | (F.col("distance") > radius)).select(*points.columns)


def samples(labels: DataFrame, people: DataFrame, rounds: DataFrame, excluded: DataFrame, seed: int = 0, key: str = "fight_id") -> DataFrame:
    """Where a data set's windows lie: key, frame, corner, kind, family, target, event_id.

    ``labels``: key, frame, corner, family, target, event_id, fps. Positives ("label") are
    those of a family in CLASSES whose person is seen in that frame. "hard_neg" is
    the opponent in a positive's frame, if it is seen and has no label of any family
    within EXCLUSION_SECONDS; "rand_neg" are RANDOM_SHARE times as many frames of people as
    there are positives in a key (all there are, if fewer), seen inside a round (anywhere
    in keys without rounds), outside ``excluded`` and away from labels. Which ones, a
    hash of seed, key, corner and frame tells: the same under any partitioning, and each
    at most once. Families and targets are indexes, 0 and -1 for none.
    """
    index = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int") - 1
    seen = present(people).select(key, "corner", "frame")
    family = index(CLASSES, "family")
    hits = labels.withColumns({"_f": family, "_t": F.coalesce(index(TARGETS, "target"), F.lit(-1))}).where("_f > 0")
    positives = hits.join(seen, [key, "corner", "frame"], "left_semi")
    rate = labels.groupBy(key).agg(F.max("fps").alias("fps"))
    radius = F.col("fps") * EXCLUSION_SECONDS
    other = positives.select(key, (1 - F.col("corner")).alias("corner"), "frame", "event_id", "fps")
    hard = _away(other, labels, key, radius).join(seen, [key, "corner", "frame"], "left_semi")

    want = positives.groupBy(key).agg(F.bround(F.count(F.lit(1)) * RANDOM_SHARE).cast("long").alias("_want"))
    free = seen.join(rate, key).withColumn("event_id", F.col("frame"))
    free = contained(free, rounds, key).unionByName(free.join(rounds.select(key).distinct(), key, "left_anti"))
    free = _away(contained(free, excluded, key, "left_anti"), labels, key, radius)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), key, "corner", "frame"))
    free = free.join(want, key).withColumn("_hash", hashed).withColumn("_h", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"))
    free = number_rows(free, key, order=["_h", "_hash"], block=1 << 22, out="_place").where("_place <= _want")

    row = lambda t, kind, f, g, e: t.select(key, "frame", "corner", F.lit(kind).alias("kind"), f.alias("family"), g.alias("target"), e.cast("long").alias("event_id"))
    none, zero = F.lit(-1), F.lit(0)
    return row(positives, "label", F.col("_f"), F.col("_t"), F.col("event_id")).unionByName(row(hard, "hard_neg", zero, none, F.lit(None))).unionByName(row(free, "rand_neg", zero, none, F.lit(None)))
