"""Which corner a tracked fighter belongs to, by the colour of tape and kit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.geometry import bhattacharyya, histogram_distance, tape_distance
from spanframe.operators.hysteresis import latched
from spanframe.operators.segmentation import BLOCK, number_rows

#: Least difference in a frame that votes, and votes that decide.
VOTE_MARGIN, MIN_VOTES = 0.010, 25
#: Difference of mean tape that counts as full, least separation of two templates.
FULL_GAP, MIN_SEPARATION = 0.30, 0.15
#: Weights of tape and kit, and what a frame must save to turn a label.
TAPE_WEIGHT, KIT_WEIGHT, TURN_COST = 0.6, 0.4, 0.5
#: Seconds for which a turn must be asked for.
CONFIRM_SECONDS = 0.08

#: Why there are no templates.
NO_FRAMES = "no clean frames for slot %d"
AMBIGUOUS = "ambiguous tape (both slots read %s)"
LOW_SEPARATION = "low separation margin (%.3f < %.3f)"


def tape_votes(pairs: DataFrame, key: str = "fight_id", least: int = MIN_VOTES) -> DataFrame:
    """Frames in which both slots are seen vote for the redder one if they differ
    enough: key, votes_0, votes_1, decided, corner_0 (the corner of slot 0: 0 is red).
    ``pairs`` has one row a frame: net_red_0, net_red_1. With fewer than ``least`` votes
    nothing is decided, and slot 0 stays red."""
    gap = F.col("net_red_0") - F.col("net_red_1")
    clear = F.abs(gap) >= VOTE_MARGIN
    t = pairs.groupBy(key).agg(F.count_if(clear & (gap > 0)).alias("votes_0"), F.count_if(clear & (gap < 0)).alias("votes_1"))
    decided = F.col("votes_0") + F.col("votes_1") >= least
    return t.select(key, "votes_0", "votes_1", decided.alias("decided"), F.when(decided & (F.col("votes_0") < F.col("votes_1")), 1).otherwise(0).alias("corner_0"))


def templates(seen: DataFrame, keys: DataFrame, key: str = "fight_id") -> DataFrame:
    """One row for each of ``keys``: net_red_0, net_red_1 (means), hist_0, hist_1 (means
    weighted by pixels, of sum 1), separation, corner_0 and reason (null: sound).
    ``seen``: key, slot (0, 1), net_red, hist (array, may be null), weight.

    Bins are summed one by one before they meet, so that a fight's histograms are
    never collected. The sign of a mean decides: it is rounded to 12 places, so that a
    mean of 0 is 0 in whatever order its rows are summed."""
    means = seen.groupBy(key, "slot").agg(F.round(F.avg("net_red"), 12).alias("net_red"))
    used = seen.where(F.col("hist").isNotNull() & (F.col("weight") > 0))
    bins = used.select(key, "slot", F.col("weight").cast("double").alias("weight"), F.posexplode("hist").alias("bin", "v"))
    bins = bins.groupBy(key, "slot", "bin").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    hists = bins.groupBy(key, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda b: b["v"]).alias("hist"))
    total = F.aggregate("hist", F.lit(0.0), lambda a, v: a + v)
    hists = hists.withColumn("hist", F.when(total > 0, F.transform("hist", lambda v: v / total)).otherwise(F.col("hist")))
    both = means.join(hists, [key, "slot"], "left")
    of = lambda slot, c: F.max_by(c, F.when(F.col("slot") == slot, 1)).alias(f"{c}_{slot}")
    t = keys.select(key).join(both.groupBy(key).agg(*(of(s, c) for s in (0, 1) for c in ("net_red", "hist"))), key, "left")
    red = [F.col(f"net_red_{s}") >= 0 for s in (0, 1)]
    gap = F.least(F.lit(1.0), F.abs(F.col("net_red_0") - F.col("net_red_1")) / FULL_GAP)
    t = t.withColumn("separation", 0.5 * gap + 0.5 * F.coalesce(bhattacharyya(F.col("hist_0"), F.col("hist_1")), F.lit(0.0)))
    reason = (
        F.when(F.col("net_red_0").isNull(), NO_FRAMES % 0)
        .when(F.col("net_red_1").isNull(), NO_FRAMES % 1)
        .when(red[0] & red[1], AMBIGUOUS % "red")
        .when(~red[0] & ~red[1], AMBIGUOUS % "blue")
        .when(F.col("separation") < MIN_SEPARATION, F.format_string(LOW_SEPARATION, "separation", F.lit(MIN_SEPARATION)))
    )
    return t.withColumns({"reason": reason, "corner_0": F.when(red[0], 0).otherwise(1)})


def label_cost(net_red: Column, tape: Column, hist: Column, weight: Column, sign: Column, template: Column) -> Column:
    """How ill a fighter fits a corner's template, from 0 to 1."""
    return TAPE_WEIGHT * tape_distance(net_red, tape, sign) + KIT_WEIGHT * histogram_distance(hist, weight, template)


def turns(frames: DataFrame, key: str = "fight_id", block: int = BLOCK) -> DataFrame:
    """Where a fight's two labels turn about: key, frame, swapped. Both turn at once, so
    that no corner is there twice.

    ``frames``: key, frame, need (frames that confirm a turn), first (the slot of the
    first detection) and c00, c01, c10, c11: the cost of slot s in corner c, null if the
    slot is not seen; frames without both are left out. Labels begin as slot 0 red. With
    one slot seen, the other gets the other corner.
    """
    c = {n: F.col(f"c{n}") for n in ("00", "01", "10", "11")}
    one, other = c["00"].isNotNull(), c["10"].isNotNull()
    t = frames.where(one | other)
    # what the labels as they are save against swapped ones; a turn costs TURN_COST a seen slot
    saved = F.when(one & other, (c["01"] + c["10"]) - (c["00"] + c["11"])).when(one, c["01"] - c["00"]).otherwise(c["10"] - c["11"])
    tie = F.when(one & other, F.col("first") == 0).otherwise(one)
    cost = F.when(one & other, 2 * TURN_COST).otherwise(TURN_COST)
    keeps = lambda margin: (margin > 0) | ((margin == 0) & tie)
    t = t.select(key, "frame", "need", F.when(~keeps(saved + cost), True).when(keeps(saved - cost), False).alias("ask"))
    t = number_rows(t, key, order=["frame"], block=block, out="at")
    found = latched(t, key, "at", "ask", "need", F.lit(False), ["frame"], block)
    return found.select(key, "frame", F.col("on").alias("swapped"))


def decisive(frames: DataFrame, key: str = "fight_id") -> DataFrame:
    """Frames in which the colours tell the corners apart: key, frame, right. ``frames``:
    key, frame, vote_0, vote_1 (1: red, 0: blue, null: neither); corner 0 is right if red."""
    told = F.col("vote_0").isNotNull() & F.col("vote_1").isNotNull() & (F.col("vote_0") != F.col("vote_1"))
    return frames.where(told).select(key, "frame", (F.col("vote_0") == 1).alias("right"))


def accuracy(frames: DataFrame, keys: DataFrame, key: str = "fight_id") -> DataFrame:
    """For each of ``keys``: decisive, correct and accuracy (null without decisive frames)."""
    t = decisive(frames, key).groupBy(key).agg(F.count(F.lit(1)).alias("decisive"), F.count_if("right").alias("correct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keys.select(key).join(t, key, "left").select(key, zero("decisive"), zero("correct"), (F.col("correct") / F.col("decisive")).alias("accuracy"))
