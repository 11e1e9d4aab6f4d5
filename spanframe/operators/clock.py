"""The clock on screen: runs of readings, their fit, confirmed rounds, and what a
round list may look like. Frames count from 1; a clock that counts down reads
``C - frame / fps`` all through a round."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.folds import fold, fold_arrays
from spanframe.operators.runs import run_lengths

#: Seconds against its direction by which a clock must jump to be a new round's.
RESET_JUMP = 30
#: Seconds from the fit beyond which a reading is no part of it.
MAX_RESIDUAL = 4
#: Readings in a row that confirm the next round's number.
CONFIRM = 3
#: Seconds that a clock may go back before its reading is rejected.
MAX_BACKWARD = 2
#: Seconds of the shortest round before the last, and of the shortest break.
MIN_INTERIOR, MIN_BREAK = 60, 30


def split_runs(readings: DataFrame, *keys: str, down: bool = True) -> DataFrame:
    """Number from 1 the runs between resets: a run ends where the number of the
    round differs from that of the reading before (both read), or the clock jumps
    by more than RESET_JUMP against its direction. A null time never jumps."""
    w = Window.partitionBy(*keys).orderBy("frame")
    step = F.col("secs") - F.lag("secs").over(w)
    new = (F.col("round_num") != F.lag("round_num").over(w)) | F.coalesce((step if down else -step) > RESET_JUMP, F.lit(False))
    t = readings.withColumn("_new", F.when(new, 1).otherwise(0))
    return t.withColumn("run", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fit_intercepts(runs: DataFrame, fps: int, *keys: str, down: bool = True) -> DataFrame:
    """A run's one free parameter: the median over its readings, again without those
    more than MAX_RESIDUAL off it (if any are left). Reckoned in frames, so exact.
    Also the highest and lowest time of the readings that are left."""
    v = F.col("secs") * fps + F.col("frame") if down else F.col("frame") - F.col("secs") * fps
    t = runs.where("secs is not null").select(*keys, "run", "secs", v.alias("_v"))
    t = t.join(t.groupBy(*keys, "run").agg(F.median("_v").alias("_centre")), [*keys, "run"])
    near = F.abs(F.col("_v") - F.col("_centre")) <= MAX_RESIDUAL * fps
    centre = F.coalesce(F.median(F.when(near, F.col("_v"))), F.first("_centre"))
    seen = F.when(near, F.col("secs"))
    return t.groupBy(*keys, "run").agg(F.round(centre / fps, 6).alias("intercept"), F.count_if(near).alias("inliers"), F.count_if(~near).alias("rejected"), F.max(seen).alias("highest"), F.min(seen).alias("lowest"))


#: Seconds of the usual rounds, and how far from them a reading still speaks for one.
ROUND_LENGTHS, LENGTH_TOLERANCE = (180, 300), 20
#: Readings that a round needs.
MIN_SAMPLES = 3


def snapped_length(highest: Column) -> Column:
    """The shortest usual length that a highest reading fits; else the reading."""
    return F.coalesce(*(F.when(highest <= n + LENGTH_TOLERANCE, F.lit(n)) for n in ROUND_LENGTHS), highest)


def rounds_of_fits(fits: DataFrame, frames: DataFrame, fps: int, *keys: str, down: bool = True) -> DataFrame:
    """Rounds of runs fitted with MIN_SAMPLES readings, cut to the video (``frames``:
    keys, frames); an edge is anchored if a reading was seen near it. Rounds of which
    nothing is left are dropped."""
    length = snapped_length(F.col("highest"))
    t = fits.where(F.col("inliers") >= MIN_SAMPLES).join(frames, list(keys)).withColumn("length", length)
    start = F.col("intercept") - F.col("length") if down else F.col("intercept")
    at = lambda secs: F.bround(F.round(secs * fps, 3)).cast("long")  # noqa: E731  the intercept is a whole or half frame
    t = t.withColumns({"start_frame": F.greatest(F.lit(1), at(start)), "end_frame": F.least("frames", at(start + F.col("length")))})
    t = t.withColumns({"start_anchored": F.col("highest") >= F.col("length") - LENGTH_TOLERANCE, "end_anchored": F.col("lowest") <= LENGTH_TOLERANCE})
    return t.where("end_frame > start_frame").select(*keys, "run", "start_frame", "end_frame", "length", F.col("inliers").alias("support"), "start_anchored", "end_anchored")


def confirmed_increments(readings: DataFrame, *keys: str) -> DataFrame:
    """Frames where the number of the round rises by one and holds for CONFIRM
    readings (unread ones aside); misread numbers between change nothing."""
    islands = run_lengths(readings, "round_num", *keys, order=["frame"])

    def step(known, row):
        if known is None:
            return row["round_num"], (False,)
        rises = row["round_num"] == known + 1 and row["n"] >= CONFIRM
        return (row["round_num"] if rises else known), (rises,)

    t = fold(islands, step, "rises boolean", *keys, order=["run"]).where("rises")
    return t.select(*keys, F.col("first").alias("frame"), "round_num")


def monotone(readings: DataFrame, *keys: str) -> DataFrame:
    """Add ``rejected``: a time more than MAX_BACKWARD against the direction of its
    key, measured from the last one accepted. The direction is down unless more
    steps rise than fall. Null times are neither rejected nor a measure."""
    w = Window.partitionBy(*keys).orderBy("frame")
    t = readings.where("secs is not null").withColumn("_step", F.col("secs") - F.lag("secs").over(w))
    ways = t.groupBy(*keys).agg((F.count_if(F.col("_step") < 0) >= F.count_if(F.col("_step") > 0)).alias("_down"))

    def step(last, c):
        out = []
        for secs, sign in zip(c["secs"].astype(float).tolist(), c["_sign"].astype(float).tolist(), strict=True):
            read = secs == secs  # else it is NaN
            out.append(read and last is not None and (secs - last) * sign > MAX_BACKWARD)
            last = secs if read and not out[-1] else last
        return last, [out]

    signed = readings.join(ways.select(*keys, F.when(F.col("_down"), 1).otherwise(-1).alias("_sign")), list(keys), "left")
    return fold_arrays(signed, step, ["secs", "_sign"], "rejected boolean", *keys, order=["frame"]).drop("_sign")


def most_rounds(frames: Column, fps: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((frames / fps + MIN_BREAK) / (MIN_INTERIOR + MIN_BREAK)))


def plausible(rounds: DataFrame, frames: DataFrame, fps: int, key: str = "fight_id") -> DataFrame:
    """What the repeated edits end in: short rounds before the last are dropped,
    rounds without a real break between them joined, then the closest ones (ties:
    the earlier) until the video (``frames``: key, frames) can hold them.

    Windows suffice, for rounds that do not overlap: a join only makes rounds
    longer and leaves the other gaps as they are, so one pass of each rule is final.
    """
    w = Window.partitionBy(key).orderBy("start_frame", "end_frame")
    t = rounds.select(key, "start_frame", "end_frame").withColumn("_last", F.lead("start_frame").over(w).isNull())
    t = t.where(F.col("_last") | (F.col("end_frame") - F.col("start_frame") + 1 >= MIN_INTERIOR * fps))
    t = t.withColumn("_gap", F.col("start_frame") - F.lag("end_frame").over(w))
    apart = F.coalesce(F.col("_gap") >= MIN_BREAK * fps, F.lit(False))
    t = t.withColumn("_apart", apart).join(frames.select(key, most_rounds(F.col("frames"), fps).alias("_most")), key)
    t = t.withColumn("_over", 1 + F.sum(F.col("_apart").cast("int")).over(Window.partitionBy(key)) - F.col("_most"))
    rank = F.row_number().over(Window.partitionBy(key, "_apart").orderBy("_gap", "start_frame"))
    t = t.withColumn("_new", (F.col("_apart") & (rank > F.col("_over"))).cast("int"))
    t = t.withColumn("_round", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(key, "_round").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_round")


def reconciled(clock: DataFrame, found: DataFrame, frames: DataFrame, key: str = "fight_id") -> DataFrame:
    """Rounds of the clock with ``source`` clock: an edge that the clock does not pin
    (``start_anchored``, ``end_anchored``) is that of the found rounds which overlap,
    all cut to the video; keys of which nothing is left have the found ones, with
    ``source`` detection."""
    f = found.select(F.col(key).alias("_key"), F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    meets = (F.col(key) == F.col("_key")) & (F.col("_e") >= F.col("start_frame")) & (F.col("_s") <= F.col("end_frame"))
    own = [key, "round_number", "start_frame", "end_frame", "start_anchored", "end_anchored"]
    t = clock.select(own).join(f, meets, "left").groupBy(own).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).join(frames.select(key, "frames"), key)
    start = F.when(F.col("start_anchored") | F.col("_s").isNull(), F.col("start_frame")).otherwise(F.col("_s"))
    end = F.when(F.col("end_anchored") | F.col("_e").isNull(), F.col("end_frame")).otherwise(F.col("_e"))
    kept = t.select(key, F.greatest(F.lit(1), start).alias("start_frame"), F.least("frames", end).alias("end_frame"), F.lit("clock").alias("source")).where("end_frame > start_frame")
    rest = found.join(kept.select(key).distinct(), key, "left_anti").select(key, "start_frame", "end_frame", F.lit("detection").alias("source"))
    return kept.unionByName(rest)


#: The words of the verdicts.
NO_ROUNDS, EMPTY = "No valid fight segments found", "Empty video"
LOW_RATIO, TOO_SHORT = "Valid frame ratio too low: %.2f < 0.2", "Fight duration too short: %.1fs < 2.4s"
GATE_FAILED = "Segmentation quality gate failed"
NO_CLOCK = "Round count came from fighter detection alone — the scoreboard clock could not be fitted (timer read on %d%% of samples). Detection splits a round at any long camera cutaway, so the boundaries below are a guess."
THIN = "%d of %d round(s) rest on fewer than 10 scoreboard readings (thinnest: %d) — the clock fit is under-determined"
#: Least share of usable frames, least seconds of all rounds, readings of a sound fit.
MIN_VALID, MIN_FIGHT, HEALTHY = 0.2, 2.4, 10


def verdicts(rounds: DataFrame, clock: DataFrame, videos: DataFrame, fps: int, key: str = "fight_id") -> DataFrame:
    """Whether a video's round list holds, why not, and whether to look at it.

    ``rounds`` as ``reconciled`` gives them, ``clock`` with ``support`` (readings a
    round rests on), ``videos`` with frames, valid_frames, timer_coverage; a video
    without rounds or clock is judged too. The first rule that applies gives the reason.
    """
    r = rounds.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("length"), F.max("source").alias("source"))
    thin = F.col("support") < HEALTHY
    c = clock.groupBy(key).agg(F.count(F.lit(1)).alias("n_clock"), F.count_if(thin).alias("n_thin"), F.min("support").alias("worst"))
    t = videos.join(r, key, "left").join(c, key, "left").fillna(0, ["n", "length", "n_clock", "n_thin"])
    ratio = F.when(F.col("frames") > 0, F.col("valid_frames") / F.col("frames")).otherwise(0.0)
    reason = (
        F.when(F.col("n") == 0, F.when(F.col("frames") > 0, NO_ROUNDS).otherwise(EMPTY))
        .when(ratio < MIN_VALID, F.format_string(LOW_RATIO, ratio))
        .when(F.col("length") < MIN_FIGHT * fps, F.format_string(TOO_SHORT, F.col("length") / fps))
        .otherwise("")
    )
    percent = F.bround(F.coalesce("timer_coverage", F.lit(0.0)) * 100).cast("int")
    review = (
        F.when(F.col("reason") != "", GATE_FAILED)
        .when(~F.col("source").eqNullSafe("clock"), F.format_string(NO_CLOCK, percent))
        .when(F.col("n_thin") > 0, F.format_string(THIN, "n_thin", "n_clock", "worst"))
        .otherwise("")
    )
    t = t.withColumn("reason", reason).withColumn("review_reason", review)
    return t.select(key, "n", (F.col("reason") == "").alias("is_valid"), "reason", (F.col("review_reason") != "").alias("needs_review"), "review_reason")


def merged_runs(readings: DataFrame, fps: int, *keys: str, down: bool = True) -> DataFrame:
    """Fitted runs after those that tell of one round are joined: keys, run (the first
    of them), runs (their number), intercept, inliers, highest, lowest, number.

    ``readings``: keys, run, frame, secs, round_num. Runs with fewer than MIN_SAMPLES
    readings near their median are left out. In order, a run joins the one before if
    their intercepts differ by at most MAX_RESIDUAL and the sets of numbers read do not
    contradict each other; what is joined is fitted anew, so that the next run meets
    the new intercept. ``number`` is the one read most often (ties: first), or null.
    The fold sees one row a run, and holds one run's readings.
    """
    v = F.col("secs") * fps + F.col("frame") if down else F.col("frame") - F.col("secs") * fps
    t = readings.where("secs is not null").select(*keys, "run", "frame", "secs", "round_num", v.alias("_v"))
    t = t.join(t.groupBy(*keys, "run").agg(F.median("_v").alias("_centre")), [*keys, "run"]).where(F.abs(F.col("_v") - F.col("_centre")) <= MAX_RESIDUAL * fps)
    row = F.struct("frame", F.col("secs").cast("double").alias("secs"), F.coalesce(F.col("round_num").cast("double"), F.lit(float("nan"))).alias("num"), F.col("_v").cast("double").alias("v"))
    t = t.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(row)).alias("_r")).where(F.size("_r") >= MIN_SAMPLES)
    t = t.select(*keys, "run", *(F.col(f"_r.{c}").alias(f"_{c}") for c in ("secs", "num", "v")))

    def step(state, c):
        out = []
        for run, secs, num, v in zip(c["run"].tolist(), c["_secs"], c["_num"], c["_v"], strict=True):
            now = (np.asarray(secs, float), np.asarray(num, float), np.asarray(v, float))
            centre, first, n = float(np.median(now[2])), run, 1
            if state is not None:
                before, at = state[0], state[1]
                numbers = [set(x[1][~np.isnan(x[1])].tolist()) for x in (before, now)]
                if abs(centre - at) <= MAX_RESIDUAL * fps and not (all(numbers) and numbers[0] != numbers[1]):
                    now = tuple(map(np.concatenate, zip(before, now, strict=True)))
                    centre, first, n = float(np.median(now[2])), state[2], state[3] + 1
                    near = np.abs(now[2] - centre) <= MAX_RESIDUAL * fps
                    if not near.all():
                        now = tuple(x[near] for x in now)
                        centre = float(np.median(now[2])) if near.any() else centre
            state = (now, centre, first, n)
            read = now[1][~np.isnan(now[1])].tolist()
            size = len(now[0])
            out.append((first, n, round(centre / fps, 6), size, float(now[0].max()) if size else None, float(now[0].min()) if size else None, int(Counter(read).most_common(1)[0][0]) if read else None))
        return state, list(zip(*out, strict=True))

    new = ["first", "runs", "intercept", "inliers", "highest", "lowest", "number"]
    t = fold_arrays(t, step, ["run", "_secs", "_num", "_v"], "first long, runs long, intercept double, inliers long, highest double, lowest double, number long", *keys, order=["run"])
    last = t.groupBy(*keys, "first").agg(F.max_by(F.struct(*new[1:]), "run").alias("_s"))
    return last.select(*keys, F.col("first").alias("run"), "_s.*")


def numbered_rounds(runs: DataFrame, *keys: str) -> DataFrame:
    """Add ``round_number`` and ``numbered``: a run's own number; else counted off from
    the key's first run that has one, but at least 1; else its place in order."""
    w = Window.partitionBy(*keys).orderBy("run")
    place = F.row_number().over(w)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = F.first(F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("n"), F.col("_place").alias("p"))), ignorenulls=True).over(all_)
    t = runs.withColumn("_place", place).withColumn("_anchor", anchor)
    counted = F.when(F.col("_anchor").isNotNull(), F.greatest(F.lit(1), F.col("_anchor.n") + F.col("_place") - F.col("_anchor.p")))
    return t.withColumns({"round_number": F.coalesce("number", counted, "_place").cast("long"), "numbered": F.col("number").isNotNull()}).drop("_place", "_anchor")
