"""Fights and rounds found in a sequence of frames, by two nested hysteresis machines.

Outside a fight, a full window with enough hits begins one, back-dated to the
window's start; inside, so many frames in a row with few hits end it, at the first
of them. Inside a fight a shorter window does the same for rounds, and the first
round begins with the fight.

Both machines are set-reset latches: what a frame asks for (begin, end) depends on
the last frames alone, not on the state, and the state is the last that was asked
for. So the frames of a fight are cut into blocks with margins, windows find each
block's few requests, and only these are lined up per fight. A fight of any length
is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Seconds and shares of both machines."""

    presence: float = 5.0
    enter: float = 0.7
    leave: float = 0.3
    fight_gap: float = 45.0
    engagement: float = 3.0
    engaged: float = 0.6
    disengaged: float = 0.2
    round_gap: float = 20.0
    shortest: float = 1.2


#: Frames of a block.
BLOCK = 8192


def frames_of(seconds: float, fps: Column) -> Column:
    return F.floor(F.lit(seconds) * fps).cast("long")


def number_rows(df: DataFrame, *keys: str, order: list[str], block: int, out: str) -> DataFrame:
    """Number a key's rows from 1 by ``order``, whose first column is cut into cells of
    ``block``: rows are numbered in their cell, and the cells' counts tell what lies before."""
    t = df.withColumn("_cell", F.floor(F.col(order[0]) / block))
    cells = t.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    t = t.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)))
    return t.join(cells, [*keys, "_cell"]).withColumn(out, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before", "_cell")


def requests(rows: DataFrame, *keys: str, enter: float, leave: float, block: int) -> DataFrame:
    """What frames ask for: keys, at, frame, begin, since. ``rows`` have the keys, at
    (1, 2, ... in each key), frame, hit, width (of the window) and gap (rows in a row with
    few hits that end it). ``begin`` is true for a full window with enough hits, false at
    the row that completes a gap, whose first frame is ``since``. Of requests of one kind
    that follow each other in a block only the first is kept."""
    margin = F.col("width") + F.col("gap") + 1
    home = F.floor(F.col("at") / block)
    t = rows.withColumn("_block", F.explode(F.sequence(home, F.floor((F.col("at") + margin) / block))))
    # a row enters the window's sum, and leaves it again ``width`` rows on
    hit = F.col("hit").cast("int")
    both = F.array(F.struct(F.col("at").alias("_pos"), F.lit(1).alias("_kind"), hit.alias("_change")), F.struct((F.col("at") + F.col("width")).alias("_pos"), F.lit(0).alias("_kind"), (-hit).alias("_change")))
    t = t.select("*", F.inline(both)).where(F.floor(F.col("_pos") / block) <= F.col("_block"))
    here = Window.partitionBy(*keys, "_block").orderBy("_pos", "_kind")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_sum", F.sum("_change").over(so_far)).where("_kind = 1")
    ratio = F.col("_sum") / F.least("at", "width")
    t = t.withColumn("_low", ratio <= leave).withColumn("_full", (F.col("at") >= F.col("width")) & (ratio >= enter))
    last_high = F.max(F.when(~F.col("_low"), F.col("at"))).over(so_far)
    # in the key's first block nothing lies before row 1; in others a longer run than the margin ends nothing
    start = F.coalesce(last_high, F.when(F.col("_block") == 0, 0))
    first_low = F.last(F.when(F.col("_low") & ~F.coalesce(F.lag("_low").over(here), F.lit(False)), F.col("frame")), ignorenulls=True).over(so_far)
    t = t.withColumn("since", first_low).withColumn("_ends", F.coalesce(F.col("_low") & (F.col("at") - start == F.col("gap")), F.lit(False)))
    t = t.withColumn("begin", F.when(F.col("_full"), True).when(F.col("_ends"), False)).where(F.col("begin").isNotNull() & (F.col("_block") == home))
    new = ~F.lag("begin").over(here).eqNullSafe(F.col("begin"))
    return t.withColumn("_new", new).where("_new").select(*keys, "at", "frame", "begin", "since")


def segment(frames: DataFrame, rules: Rules = Rules(), key: str = "fight_id", order: tuple[str, ...] = ("frame",), block: int = BLOCK) -> DataFrame:  # noqa: B008
    """Rounds (key, start_frame, end_frame) of ``frames``: key, frame, hit (null: none)
    and fps, the same in all of a key's rows. Ties in ``frame`` are ordered by the rest
    of ``order``. Rounds shorter than ``rules.shortest`` are left out, as are rounds that
    would end before they begin."""
    fps = F.col("fps")
    t = number_rows(frames.select(key, "fps", F.coalesce("hit", F.lit(False)).alias("hit"), *order), key, order=list(order), block=block, out="at")
    outer = t.select(key, "at", "frame", "hit", frames_of(rules.presence, fps).alias("width"), frames_of(rules.fight_gap, fps).alias("gap"))
    asked = requests(outer, key, enter=rules.enter, leave=rules.leave, block=block)
    along = Window.partitionBy(key).orderBy("at")
    asked = asked.withColumn("_new", ~F.coalesce(F.lag("begin").over(along), F.lit(False)).eqNullSafe(F.col("begin"))).where("_new")
    # of what is left beginnings and ends alternate, a beginning first
    ends = asked.withColumns({"exit_at": F.lead("at").over(along), "fight_end": F.lead("since").over(along)}).where("begin")
    last = t.groupBy(key).agg(F.max("frame").alias("last_frame"), F.max("at").alias("last_at"), F.first("fps").alias("fps"))
    width = frames_of(rules.presence, fps)
    bouts = ends.join(last, key).select(
        key, F.col("at").alias("enter_at"), (F.col("frame") - width + 1).alias("fight_start"), F.coalesce(F.col("exit_at") - 1, "last_at").alias("last_at"), F.coalesce("fight_end", "last_frame").alias("fight_end"), "fps",
    )
    # each row meets the bout that holds it in its block
    spread = bouts.withColumn("_block", F.explode(F.sequence(F.floor(F.col("enter_at") / block), F.floor(F.col("last_at") / block)))).select(key, "_block", "enter_at", "last_at")
    inner = t.withColumn("_block", F.floor(F.col("at") / block)).join(spread.withColumnRenamed("last_at", "until"), [key, "_block"]).where("at between enter_at and until")
    inner = inner.select(key, "enter_at", (F.col("at") - F.col("enter_at") + 1).alias("at"), "frame", "hit", frames_of(rules.engagement, fps).alias("width"), frames_of(rules.round_gap, fps).alias("gap"))
    asked = requests(inner, key, "enter_at", enter=rules.engaged, leave=rules.disengaged, block=block)
    asked = asked.select(key, "enter_at", "at", "frame", "begin", "since").unionByName(bouts.select(key, "enter_at", F.lit(0).cast("long").alias("at"), F.col("fight_start").alias("frame"), F.lit(True).alias("begin"), F.lit(None).cast("long").alias("since")))
    along = Window.partitionBy(key, "enter_at").orderBy("at")
    asked = asked.withColumn("_new", ~F.lag("begin").over(along).eqNullSafe(F.col("begin"))).where("_new")
    rounds = asked.withColumn("_end", F.lead("since").over(along)).where("begin").join(bouts.select(key, "enter_at", "fight_end", "fps"), [key, "enter_at"])
    start = F.when(F.col("at") == 0, F.col("frame")).otherwise(F.col("frame") - frames_of(rules.engagement, fps) + 1)
    rounds = rounds.select(key, start.alias("start_frame"), F.coalesce("_end", "fight_end").alias("end_frame"), "fps")
    long_enough = (F.col("end_frame") >= F.col("start_frame")) & (F.col("end_frame") - F.col("start_frame") + 1 >= frames_of(rules.shortest, fps))
    return rounds.where(long_enough).drop("fps")


# ---------------------------------------------------------------- one frame at a time


@dataclass
class Machine:
    """Both machines of one fight, frame by frame, for streams: ``see`` returns the
    rounds that a frame ends. All that it knows is in its fields."""

    fps: float
    rules: Rules = field(default_factory=Rules)
    presence: list = field(default_factory=list)
    engagement: list = field(default_factory=list)
    fight_start: int | None = None
    fight_cand: int | None = None
    fight_streak: int = 0
    round_start: int | None = None
    round_cand: int | None = None
    round_streak: int = 0
    last_frame: int | None = None

    def _span(self, seconds: float) -> int:
        return int(seconds * self.fps)

    def _closed(self, end: int) -> list[tuple[int, int]]:
        start = self.round_start
        return [(start, end)] if start is not None and end >= start and end - start + 1 >= self._span(self.rules.shortest) else []

    @staticmethod
    def _share(window: list, hit: bool, width: int) -> float:
        window.append(bool(hit))
        if len(window) > width:
            window.pop(0)
        return sum(window) / len(window) if window else 0.0

    def see(self, frame: int, hit: bool) -> list[tuple[int, int]]:
        rules, self.last_frame = self.rules, frame
        share = self._share(self.presence, hit, self._span(rules.presence))
        if self.fight_start is None:
            if len(self.presence) >= self._span(rules.presence) and share >= rules.enter:
                self.fight_start = self.round_start = frame - len(self.presence) + 1
                self.fight_cand = self.round_cand = None
                self.fight_streak = self.round_streak = 0
                self.engagement = []
        elif share <= rules.leave:
            self.fight_cand = frame if self.fight_cand is None else self.fight_cand
            self.fight_streak += 1
            if self.fight_streak >= self._span(rules.fight_gap):
                out = self._closed(self.fight_cand)
                self.fight_start = self.round_start = self.fight_cand = None
                self.fight_streak = 0
                return out
        else:
            self.fight_cand, self.fight_streak = None, 0
        if self.fight_start is None:
            return []
        share = self._share(self.engagement, hit, self._span(rules.engagement))
        if self.round_start is None:
            if len(self.engagement) >= self._span(rules.engagement) and share >= rules.engaged:
                self.round_start = frame - len(self.engagement) + 1
                self.round_cand, self.round_streak = None, 0
        elif share <= rules.disengaged:
            self.round_cand = frame if self.round_cand is None else self.round_cand
            self.round_streak += 1
            if self.round_streak >= self._span(rules.round_gap):
                out = self._closed(self.round_cand)
                self.round_start = self.round_cand = None
                self.round_streak = 0
                return out
        else:
            self.round_cand, self.round_streak = None, 0
        return []

    def open_round(self) -> list[tuple[int, int]]:
        """The round that would end if the frames did."""
        return self._closed(self.last_frame) if self.fight_start is not None and self.last_frame is not None else []
