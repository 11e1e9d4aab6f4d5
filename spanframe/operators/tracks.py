"""Boxes of people over frames: identities, gaps and smoothing."""

from __future__ import annotations

from itertools import permutations
from math import hypot

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.geometry import box, centred, cornered, off_centre, skeleton_hull, torso_centre
from spanframe.operators.folds import fold_arrays
from spanframe.operators.intervals import spread

#: Frames of a block.
BLOCK = 8192
#: Seconds of the median's and the fit's windows, and of the longest gap that is filled.
MEDIAN_SECONDS, FIT_SECONDS, GAP_SECONDS = 0.1, 0.24, 0.3
#: Degree of the fitted polynomial.
DEGREE = 2
#: A smoothed box further off its skeleton than this share of its diagonal is dropped.
DRIFT_RATIO = 0.05

_PARTS = ("cx", "cy", "w", "h")


def gap_sessions(df: DataFrame, keys: list[str], frame: str, most: Column | int, block: int = BLOCK, out: str = "session") -> DataFrame:
    """Add ``out``: the frame with which a key's run of rows begins that are no more than
    ``most`` frames apart. Frames are cut into cells, and only the cells' edges are
    lined up by key."""
    t = df.withColumn("_cell", F.floor(F.col(frame) / block))
    inside = Window.partitionBy(*keys, "_cell").orderBy(frame)
    begins = F.col(frame) - F.lag(frame).over(inside) > most
    t = t.withColumn("_begun", F.last(F.when(begins, F.col(frame)), ignorenulls=True).over(inside))
    cells = t.groupBy(*keys, "_cell").agg(F.min(frame).alias("_first"), F.max(frame).alias("_last"), F.max("_begun").alias("_begun"), F.min(F.lit(most) if isinstance(most, int) else most).alias("_most"))
    along = Window.partitionBy(*keys).orderBy("_cell")
    breaks = F.coalesce(F.col("_first") - F.lag("_last").over(along) > F.col("_most"), F.lit(True))
    cells = cells.withColumn("_opens", F.when(breaks, F.col("_first")))
    # what goes on at the end of a cell, and hence at the start of the next
    cells = cells.withColumn("_held", F.last(F.coalesce("_begun", "_opens"), ignorenulls=True).over(along))
    cells = cells.withColumn("_carry", F.coalesce("_opens", F.lag("_held").over(along)))
    return t.join(cells.select(*keys, "_cell", "_carry"), [*keys, "_cell"]).withColumn(out, F.coalesce("_begun", "_carry")).drop("_cell", "_begun", "_carry")


# ---------------------------------------------------------------- smoothing


def odd_frames(seconds: float, fps: float) -> int:
    n = max(3, round(fps * seconds))
    return n + 1 - n % 2


def fit_weights(width: int, degree: int = DEGREE) -> list[list[float]]:
    """Row p gives the weights of ``width`` values for the value at p of the polynomial
    that fits them best."""
    powers = np.vander(np.arange(width) - width // 2, degree + 1)
    return (powers @ np.linalg.pinv(powers)).tolist()


def _near(part: str, k: int, here) -> Column:
    """The value k rows on (or back), or the nearest there is."""
    move = F.lead if k > 0 else F.lag
    return F.coalesce(*(move(part, i).over(here) for i in range(abs(k), 0, -1)), F.col(part)) if k else F.col(part)


def smooth_boxes(boxes: DataFrame, *keys: str, fps: float, block: int = BLOCK) -> DataFrame:
    """Fill short gaps of each key's boxes and smooth them: keys, frame, box, filled.

    ``boxes``: keys, frame, box (x1, y1, x2, y2) and skeleton (17 x 3, or null), one row
    a key and frame. Rows more than GAP_SECONDS apart begin anew; a lone box stays as
    it is. Centre and size are interpolated over gaps, then go through a running median
    (edges repeat their last value) and a running polynomial fit (at edges the fit of
    the first or last full window); windows shrink to the length of what they run over.
    A box that then lies off its skeleton becomes the observed one again, and no box is
    smaller than its skeleton. Rows without a key or frame are left out.

    All are windows and array sums over blocks of frames with margins, dealt once, so a
    key of any length is many tasks. Of a skeleton only its torso's centre and its hull
    are dealt.
    """
    most, median, fit = max(1, round(fps * GAP_SECONDS)), odd_frames(MEDIAN_SECONDS, fps), odd_frames(FIT_SECONDS, fps)
    # what a frame looks at lies within fit + median frames, and so does a row within ``most`` frames of each
    margin = fit + median + most
    place = lambda frame: F.floor((frame + block // 2) / block)
    t = boxes.dropna(subset=[*keys, "frame"]).select(*keys, "frame", "box", "skeleton")
    t = t.withColumn("_block", F.explode(F.sequence(place(F.col("frame") - margin), place(F.col("frame") + margin))))
    # after the generator, lest the optimizer makes the skeleton anew for every use
    t = t.select(*keys, "_block", "frame", "box", torso_centre(F.col("skeleton")).alias("_torso"), skeleton_hull(F.col("skeleton")).alias("_hull"))
    t = spread(t, *keys, "_block").withColumn("_c", centred(F.col("box")))
    along = Window.partitionBy(*keys, "_block").orderBy("frame")
    t = t.withColumns({"_begins": F.coalesce(F.col("frame") - F.lag("frame").over(along) > most, F.lit(True)), "_next": F.lead("frame").over(along), "_nc": F.lead("_c").over(along)})
    t = t.withColumn("session", F.last(F.when(F.col("_begins"), F.col("frame")), ignorenulls=True).over(along))
    # every frame up to the next row, the gaps on a straight line
    until = F.when(F.col("_next") - F.col("frame") <= most, F.col("_next") - 1).otherwise(F.col("frame"))
    t = t.withColumn("_f", F.explode(F.sequence("frame", until)))
    step = F.col("_f") - F.col("frame")
    line = lambda p: F.when(step == 0, F.col(f"_c.{p}")).otherwise((F.col(f"_nc.{p}") - F.col(f"_c.{p}")) / (F.col("_next") - F.col("frame")) * step + F.col(f"_c.{p}"))
    seen = lambda c: F.when(step == 0, F.col(c)).alias(c)
    t = t.select(*keys, "_block", "session", F.col("_f").alias("frame"), (step > 0).alias("filled"), *map(seen, ("box", "_torso", "_hull")), *(line(p).alias(p) for p in _PARTS))
    here = Window.partitionBy(*keys, "_block", "session").orderBy("frame")
    # of a run that goes on beyond the margin what is there is enough
    t = t.withColumns({"_i": F.col("frame") - F.col("session"), "_n": F.max("frame").over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("session") + 1})
    for p in _PARTS:
        middle = F.col(p)
        for width in range(3, median + 1, 2):  # the widest that fits
            values = F.sort_array(F.array(*(_near(p, k, here) for k in range(-(width // 2), width // 2 + 1))))
            middle = F.when(F.col("_n") >= width, F.get(values, F.lit(width // 2))).otherwise(middle)
        t = t.withColumn(f"_m{p}", middle)
    around = here.rowsBetween(-(fit - 1), fit - 1)
    t = t.withColumn("_all", F.collect_list(F.struct("_i", *(f"_m{p}" for p in _PARTS))).over(around)).where(F.col("_block") == place(F.col("frame")))
    width = F.least(F.lit(fit), F.col("_n") - 1 + F.col("_n") % 2).cast("int")
    start = F.least(F.greatest(F.col("_i") - F.floor(width / 2), F.lit(0)), F.col("_n") - width)
    first = F.get("_all", F.lit(0))["_i"]
    weights = F.array(*(F.array(*(F.array(*map(F.lit, row)) for row in fit_weights(w))) for w in range(DEGREE + 1 + (DEGREE % 2), fit + 1, 2)))
    row = F.get(F.get(weights, ((width - (DEGREE + 1 + (DEGREE % 2))) / 2).cast("int")), (F.col("_i") - start).cast("int"))
    values = F.slice("_all", (start - first + 1).cast("int"), width)
    t = t.withColumns({"_w": F.when(width > DEGREE, row), "_v": values})
    fitted = lambda p: F.when(F.col("_w").isNotNull(), F.aggregate(F.zip_with("_v", "_w", lambda v, w: v[f"_m{p}"] * w), F.lit(0.0), lambda a, x: a + x)).otherwise(F.col(f"_m{p}"))
    smooth = cornered(F.struct(*(fitted(p).alias(p) for p in _PARTS)))
    t = t.select(*keys, "frame", "filled", "box", "_torso", "_hull", (F.col("_n") == 1).alias("_alone"), smooth.alias("_s"))
    kept = F.when(~F.col("filled") & (off_centre(F.col("_s"), F.col("_torso")) > DRIFT_RATIO), F.col("box")).otherwise(F.col("_s"))
    t = t.withColumn("_s", kept)
    s, hull = F.col("_s"), F.col("_hull")
    grown = F.when(hull.isNull(), s).otherwise(box(F.least(s["x1"], hull["x1"]), F.least(s["y1"], hull["y1"]), F.greatest(s["x2"], hull["x2"]), F.greatest(s["y2"], hull["y2"])))
    return t.select(*keys, "frame", F.when(F.col("_alone"), F.col("box")).otherwise(grown).alias("box"), "filled")


# ---------------------------------------------------------------- identities

#: Weights of overlap and distance in the cost of a match; people tracked at most.
OVERLAP_WEIGHT, DISTANCE_WEIGHT, SLOTS = 0.6, 0.4, 2
#: Seconds for which a lost person is waited for; overlap from which speeds are frozen.
LOST_SECONDS, TANGLED = 0.6, 0.3


def overlap(a, b) -> float:
    """Intersection over union of two boxes; 0 for empty ones."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / whole if whole > 0 else 0.0


class Person:
    """A tracked box with its speed, and how long it was not seen."""

    def __init__(self, seen):
        self.box, self.speed, self.lost = list(seen), (0.0, 0.0), 0

    def centre(self):
        return (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2

    def expected(self):
        x, y = self.speed
        return [self.box[0] + x, self.box[1] + y, self.box[2] + x, self.box[3] + y]

    def cost(self, seen) -> float:
        ahead = self.expected()
        size = max(1.0, hypot(seen[2] - seen[0], seen[3] - seen[1]))
        far = hypot((ahead[0] + ahead[2]) / 2 - (seen[0] + seen[2]) / 2, (ahead[1] + ahead[3]) / 2 - (seen[1] + seen[3]) / 2)
        return OVERLAP_WEIGHT * (1 - overlap(ahead, seen)) + DISTANCE_WEIGHT * far / size

    def meet(self, seen, frozen: bool) -> None:
        x, y = self.centre()
        self.box, self.lost = list(seen), 0
        if not frozen:
            now = self.centre()
            self.speed = (now[0] - x, now[1] - y)

    def coast(self) -> None:
        self.box, self.lost = self.expected(), self.lost + 1


def match(costs: list[list[float]]) -> list[int | None]:
    """For each row (person) a column (box) of its own, as many as can be, with the least
    sum of costs; of equal ones the first in order of rows and columns."""
    rows, columns = len(costs), len(costs[0])
    n = min(rows, columns)
    best, chosen = None, [None] * rows
    for own in permutations(range(rows), n) if rows > columns else [tuple(range(rows))]:
        for boxes in permutations(range(columns), n) if rows <= columns else [tuple(range(columns))]:
            total = sum(costs[r][c] for r, c in zip(own, boxes, strict=True))
            if best is None or total < best:
                best, chosen = total, [dict(zip(own, boxes, strict=True)).get(r) for r in range(rows)]
    return chosen


def follow(people: dict[int, Person], seen: list, wait: int) -> list[int | None]:
    """One frame: the slot of each box (null: both slots are taken). Changes ``people``."""
    out: list[int | None] = [None] * len(seen)
    known = sorted(people)  # among equal costs the lower slot comes first
    matched = set()
    if known and seen:
        frozen = len(seen) == 2 and overlap(*seen) > TANGLED
        for slot, c in zip(known, match([[people[s].cost(b) for b in seen] for s in known]), strict=True):
            if c is not None:
                people[slot].meet(seen[c], frozen)
                out[c] = slot
                matched.add(slot)
    for c, b in enumerate(seen):
        if out[c] is None and len(people) < SLOTS:
            out[c] = next(s for s in range(SLOTS) if s not in people)
            people[out[c]] = Person(b)
    for slot in known:
        if slot not in matched:
            people[slot].coast()
            if people[slot].lost > wait:
                del people[slot]
    return out


def track(boxes: DataFrame, key: str, fps: str = "fps", block: int = BLOCK) -> DataFrame:
    """Give each box the slot (0 or 1) of the person that it shows: key, frame, no, slot.

    ``boxes``: key, frame, no (the order of a frame's boxes), x1, y1, x2, y2 and fps.
    Boxes go to the people they fit best, by overlap and distance from where those are
    expected; a person that is not seen moves on, and is given up after LOST_SECONDS.
    Where a key has no boxes for longer than that, nothing is left to carry on: there it
    is cut, and each stretch is a group of its own. Inside, frames go through a fold.
    """
    wait = F.greatest(F.lit(1), F.bround(F.col(fps) * LOST_SECONDS).cast("int"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("b")))), lambda s: s["b"]))
    frames = boxes.groupBy(key, "frame").agg(flat.alias("flat"), F.array_sort(F.collect_list("no")).alias("nos"), F.max(wait).alias("wait"))
    # a frame without boxes ages both people; after wait + 1 of them nobody is left
    frames = gap_sessions(frames, [key], "frame", F.col("wait") + 1, block)

    def step(state, c):
        people, last = state or ({}, None)
        slots = []
        for frame, flat, wait in zip(c["frame"].tolist(), c["flat"], c["wait"].tolist(), strict=True):
            for _ in range(0 if last is None else frame - last - 1):
                follow(people, [], wait)
            slots.append(follow(people, np.asarray(flat, dtype=float).reshape(-1, 4).tolist(), wait))
            last = frame
        return (people, last), [slots]

    t = fold_arrays(frames, step, ["frame", "flat", "wait"], "slots array<int>", key, "session", order=["frame"])
    pairs = F.explode(F.arrays_zip("nos", "slots")).alias("_p")
    return t.select(key, "frame", pairs).select(key, "frame", F.col("_p.nos").alias("no"), F.col("_p.slots").alias("slot"))
