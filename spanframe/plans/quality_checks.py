"""Checks without labels, and scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanframe.functions.vocabulary import PREDICTED_FAMILY, share, sql_lookup
from spanframe.operators.intervals import contained
from spanframe.operators.matching import match, peaks
from spanframe.operators.runs import upper_median
from spanframe.plans.events import is_specific, label_rows, predicted_rows
from spanframe.plans.registry import query
from spanframe.sources.testdata import FPS

MINUTES = 3 * 13200 / FPS / 60
PS_SQL = f"ps AS (SELECT * FROM ev WHERE source = 'prediction' AND {sql_lookup(PREDICTED_FAMILY, 'action')} IS NOT NULL)"
OUT_SQL = PS_SQL + ", o AS (SELECT ps.*, NOT EXISTS (FROM rounds r WHERE r.fight_id = ps.fight_id AND ps.frame BETWEEN r.start_frame AND r.end_frame) AS out FROM ps)"


def _strikes(m) -> DataFrame:
    return predicted_rows(m.events, m.fights).where("row_kind = 'strike'").select("fight_id", "event_id", "frame", "fighter", "action", "family", "zone", "success", "value", "corner")


@query("A-14", f"SELECT fight_id, round(sum(end_frame - start_frame + 1) / {FPS} / 60, 6) AS minutes FROM rounds GROUP BY fight_id")
def _(m):
    return m.rounds.groupBy("fight_id").agg(F.round(F.sum(F.col("end_frame") - F.col("start_frame") + 1) / FPS / 60, 6).alias("minutes"))


def outside_rounds(strikes: DataFrame, rounds: DataFrame) -> DataFrame:
    out = contained(strikes, rounds, how="left_anti").groupBy("fight_id").agg(F.count(F.lit(1)).alias("n_out"))
    t = strikes.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n")).join(out, "fight_id", "left").fillna(0)
    ratio = share(F.col("n_out"), F.col("n"))
    return t.select("fight_id", "n", "n_out", F.round(ratio, 6).alias("ratio"), (ratio <= 0).alias("passed"))


@query("A-15", OUT_SQL + " SELECT fight_id, count(*) AS n, count(*) FILTER (WHERE out) AS n_out, round(count(*) FILTER (WHERE out) / count(*), 6) AS ratio, count(*) FILTER (WHERE out) = 0 AS passed FROM o GROUP BY fight_id")
def _(m):
    return outside_rounds(_strikes(m), m.rounds)


@query("T-04", OUT_SQL + " SELECT action, count(*) AS n, count(*) FILTER (WHERE out) AS n_out FROM o GROUP BY action")
def _(m):
    s = _strikes(m)
    out = contained(s, m.rounds, how="left_anti").groupBy("action").agg(F.count(F.lit(1)).alias("n_out"))
    return s.groupBy("action").agg(F.count(F.lit(1)).alias("n")).join(out, "action", "left").fillna(0).orderBy(F.desc("n"), "action")


@query("A-16", PS_SQL + ", f AS (SELECT fight_id, frame // 60 AS slot, count(DISTINCT corner) AS who FROM ps GROUP BY ALL), t AS (SELECT fight_id, count(*) AS n FROM ps GROUP BY fight_id) SELECT t.fight_id, count(slot) AS frames, round(2 * count(slot) / any_value(n), 6) AS ratio FROM t LEFT JOIN f ON f.fight_id = t.fight_id AND who = 2 GROUP BY t.fight_id")
def _(m):
    # slots of 60 frames: with minutes as frames hardly two strikes share one
    s = _strikes(m)
    both = s.groupBy("fight_id", F.floor(F.col("frame") / 60).alias("slot")).agg(F.count_distinct("fighter").alias("who")).where("who = 2").groupBy("fight_id").agg(F.count(F.lit(1)).alias("frames"))
    t = s.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n")).join(both, "fight_id", "left").fillna(0)
    return t.select("fight_id", "frames", F.round(share(F.col("frames") * 2, F.col("n")), 6).alias("ratio"))


@query("A-17", PS_SQL + ", g AS (SELECT fight_id, frame // 500 AS slot, corner, action, count(*) AS n FROM ps GROUP BY ALL) SELECT fight_id, sum(n - 1)::BIGINT AS duplicates, sum(n - 1) = 0 AS passed FROM g GROUP BY fight_id")
def _(m):
    g = _strikes(m).groupBy("fight_id", F.floor(F.col("frame") / 500), "corner", "action").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("fight_id").agg(F.sum(F.col("n") - 1).alias("duplicates")).withColumn("passed", F.col("duplicates") == 0)


@query(
    "A-18",
    f"""c AS (SELECT fight_id, (frame - lag(frame) OVER (PARTITION BY fight_id ORDER BY frame, event_id)) / {FPS} AS d FROM ev WHERE source = 'prediction' AND state IS NOT NULL)
    SELECT fight_id, round(count(*) / {MINUTES}, 6) AS per_min, round(list_sort(list(d) FILTER (WHERE d IS NOT NULL))[count(d) // 2 + 1], 6) AS median_dwell, count(*) FILTER (WHERE d < 0.5) AS short FROM c GROUP BY fight_id""",
)
def _(m):
    w = Window.partitionBy("fight_id").orderBy("frame", "event_id")
    t = m.events.where("source = 'prediction' and state is not null").withColumn("d", (F.col("frame") - F.lag("frame").over(w)) / FPS)
    return t.groupBy("fight_id").agg(F.round(F.count(F.lit(1)) / MINUTES, 6).alias("per_min"), F.round(upper_median(F.collect_list("d")), 6).alias("median_dwell"), F.count_if(F.col("d") < 0.5).alias("short"))


@query("A-19", OUT_SQL + f" SELECT fight_id, round(count(*) FILTER (WHERE NOT out) / {MINUTES}, 6) AS per_min, count(*) FILTER (WHERE NOT out) / {MINUTES} BETWEEN 5 AND 60 AS passed FROM o GROUP BY fight_id")
def _(m):
    s = _strikes(m)
    inside = contained(s, m.rounds).groupBy("fight_id").agg(F.count(F.lit(1)).alias("n"))
    t = s.select("fight_id").distinct().join(inside, "fight_id", "left").fillna(0)
    return t.select("fight_id", F.round(F.col("n") / MINUTES, 6).alias("per_min"), (F.col("n") / MINUTES).between(5, 60).alias("passed"))


# The same checks as the rules have them: exact frames, minutes of the rounds, verdicts.

#: Largest share of strikes in frames where both strike; most state changes a minute;
#: shortest median dwell in seconds; least and most strikes a minute.
MAX_MUTUAL, MAX_CHANGES, MIN_DWELL, STRIKE_RATE = 0.02, 15, 1, (5, 60)
MINUTES_SQL = f"""fr AS (SELECT fight_id, max(frame) AS frames FROM ev GROUP BY fight_id), kr AS (SELECT * FROM rounds WHERE (fight_id + round_number) % 3 > 0 AND fight_id % 4 > 0),
    mi AS (SELECT fight_id, coalesce(sum(end_frame - start_frame + 1), any_value(frames)) / {FPS} / 60 AS minutes, count(start_frame) AS n_rounds FROM fr LEFT JOIN kr USING (fight_id) GROUP BY fight_id)"""


def round_minutes(rounds: DataFrame, frames: DataFrame, fps: int) -> DataFrame:
    """Minutes of a fight's rounds; of a fight without any, of its whole video."""
    length = F.sum(F.col("end_frame") - F.col("start_frame") + 1)
    t = frames.join(rounds.groupBy("fight_id").agg(length.alias("_in"), F.count(F.lit(1)).alias("n_rounds")), "fight_id", "left")
    return t.select("fight_id", (F.coalesce("_in", "frames") / fps / 60).alias("minutes"), F.coalesce("n_rounds", F.lit(0)).alias("n_rounds"))


def some_rounds(m) -> DataFrame:
    """Rounds of differing number; every fourth fight has none."""
    return m.rounds.where("(fight_id + round_number) % 3 > 0 and fight_id % 4 > 0")


def minutes(m) -> DataFrame:
    return round_minutes(some_rounds(m), m.events.groupBy("fight_id").agg(F.max("frame").alias("frames")), FPS)


@query("A-14-video", MINUTES_SQL + " SELECT fight_id, round(minutes, 6) AS minutes, n_rounds FROM mi")
def _(m):
    return minutes(m).withColumn("minutes", F.round("minutes", 6))


@query(
    "A-16-frames",
    PS_SQL + f", f AS (SELECT fight_id, frame, count(*) AS n, count(DISTINCT corner) AS who FROM ps GROUP BY ALL) SELECT fight_id, count(*) FILTER (WHERE who = 2) AS frames, round(2 * count(*) FILTER (WHERE who = 2) / sum(n), 6) AS ratio, 2 * count(*) FILTER (WHERE who = 2) / sum(n) <= {MAX_MUTUAL} AS passed FROM f GROUP BY fight_id",
)
def _(m):
    f = _strikes(m).groupBy("fight_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fighter").alias("who"))
    t = f.groupBy("fight_id").agg(F.count_if(F.col("who") == 2).alias("frames"), F.sum("n").alias("n"))
    ratio = F.col("frames") * 2 / F.col("n")
    return t.select("fight_id", "frames", F.round(ratio, 6).alias("ratio"), (ratio <= MAX_MUTUAL).alias("passed"))


@query("A-17-exact", PS_SQL + ", g AS (SELECT fight_id, frame, corner, action, count(*) AS n FROM ps GROUP BY ALL) SELECT fight_id, sum(n - 1)::BIGINT AS duplicates, sum(n - 1) = 0 AS passed FROM g GROUP BY fight_id")
def _(m):
    g = _strikes(m).groupBy("fight_id", "frame", "corner", "action").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("fight_id").agg(F.sum(F.col("n") - 1).alias("duplicates")).withColumn("passed", F.col("duplicates") == 0)


@query(
    "A-18-rounds",
    MINUTES_SQL
    + f""", c AS (SELECT fight_id, (frame - lag(frame) OVER (PARTITION BY fight_id ORDER BY frame, event_id)) / {FPS} AS d FROM ev WHERE source = 'prediction' AND state IS NOT NULL),
    g AS (SELECT fight_id, count(*) / any_value(minutes) AS per_min, list_sort(list(d) FILTER (WHERE d IS NOT NULL))[count(d) // 2 + 1] AS dwell, count(*) FILTER (WHERE d < 0.5) AS short FROM c JOIN mi USING (fight_id) GROUP BY fight_id)
    SELECT fight_id, round(per_min, 6) AS per_min, per_min <= {MAX_CHANGES} AS rate_passed, round(dwell, 6) AS median_dwell, dwell >= {MIN_DWELL} AS dwell_passed, short FROM g""",
)
def _(m):
    w = Window.partitionBy("fight_id").orderBy("frame", "event_id")
    t = m.events.where("source = 'prediction' and state is not null").withColumn("d", (F.col("frame") - F.lag("frame").over(w)) / FPS)
    t = t.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n"), upper_median(F.collect_list("d")).alias("dwell"), F.count_if(F.col("d") < 0.5).alias("short")).join(minutes(m), "fight_id")
    rate = F.col("n") / F.col("minutes")
    return t.select("fight_id", F.round(rate, 6).alias("per_min"), (rate <= MAX_CHANGES).alias("rate_passed"), F.round("dwell", 6).alias("median_dwell"), (F.col("dwell") >= MIN_DWELL).alias("dwell_passed"), "short")


@query(
    "A-19-rounds",
    MINUTES_SQL
    + f""", {PS_SQL}, i AS (SELECT fight_id, count(*) FILTER (WHERE n_rounds = 0 OR EXISTS (FROM kr WHERE kr.fight_id = ps.fight_id AND ps.frame BETWEEN kr.start_frame AND kr.end_frame)) / any_value(minutes) AS rate FROM ps JOIN mi USING (fight_id) GROUP BY fight_id)
    SELECT fight_id, round(rate, 6) AS per_min, rate BETWEEN {STRIKE_RATE[0]} AND {STRIKE_RATE[1]} AS passed FROM i""",
)
def _(m):
    s = _strikes(m)
    inside = contained(s, some_rounds(m)).groupBy("fight_id").agg(F.count(F.lit(1)).alias("n_in"))
    t = s.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n")).join(inside, "fight_id", "left").join(minutes(m), "fight_id")
    rate = F.when(F.col("n_rounds") == 0, F.col("n")).otherwise(F.coalesce("n_in", F.lit(0))) / F.col("minutes")
    return t.select("fight_id", F.round(rate, 6).alias("per_min"), rate.between(*STRIKE_RATE).alias("passed"))


@query(
    "A-49-rounds",
    MINUTES_SQL + ", c AS (SELECT fight_id, count(*) FILTER (WHERE source = 'prediction' AND state IS NOT NULL) / any_value(minutes) AS p, count(*) FILTER (WHERE source = 'label' AND starts_with(action, 'state_')) / any_value(minutes) AS g FROM ev JOIN mi USING (fight_id) GROUP BY fight_id) SELECT fight_id, p > 3 * greatest(g, 0.1) AS flapping FROM c",
)
def _(m):
    t = m.events.groupBy("fight_id").agg(F.count_if((F.col("source") == "prediction") & F.col("state").isNotNull()).alias("p"), F.count_if((F.col("source") == "label") & F.col("action").startswith("state_")).alias("g"))
    t = t.join(minutes(m), "fight_id")
    return t.select("fight_id", (F.col("p") / F.col("minutes") > 3 * F.greatest(F.col("g") / F.col("minutes"), F.lit(0.1))).alias("flapping"))


def round_structure(rounds: DataFrame, frames: DataFrame, fps: int, min_round: float = 60.0, min_break: float = 30.0) -> DataFrame:
    """Short rounds before the last, gaps too short to be breaks, and whether the
    video can hold that many rounds."""
    w = Window.partitionBy("fight_id").orderBy("start_frame")
    t = rounds.withColumn("_next", F.lead("start_frame").over(w))
    length = (F.col("end_frame") - F.col("start_frame") + 1) / fps
    t = t.groupBy("fight_id").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.count_if(F.col("_next").isNotNull() & (length < min_round)).alias("short_interior"),
        F.count_if((F.col("_next") - F.col("end_frame")) / fps < min_break).alias("tight_gaps"),
    )
    most = F.greatest(F.lit(1).cast("long"), F.floor((F.col("frames") / fps + min_break) / (min_round + min_break)))
    return t.join(frames, "fight_id").select("fight_id", "n_rounds", "short_interior", "tight_gaps", (F.col("n_rounds") <= most).alias("fits"))


@query(
    "A-20",
    f"""w AS (SELECT *, lead(start_frame) OVER (PARTITION BY fight_id ORDER BY start_frame) AS nxt FROM rounds), m AS (SELECT fight_id, max(frame) AS frames FROM ev GROUP BY fight_id)
    SELECT fight_id, count(*) AS n_rounds, count(*) FILTER (WHERE nxt IS NOT NULL AND (end_frame - start_frame + 1) / {FPS} < 60) AS short_interior, count(*) FILTER (WHERE (nxt - end_frame) / {FPS} < 30) AS tight_gaps,
           count(*) <= greatest(1, floor((any_value(frames) / {FPS} + 30) / 90)) AS fits FROM w JOIN m USING (fight_id) GROUP BY fight_id""",
)
def _(m):
    return round_structure(m.rounds, m.events.groupBy("fight_id").agg(F.max("frame").alias("frames")), FPS)


@query("A-22", "SELECT fight_id, coalesce(max(frame) FILTER (WHERE k > 98), 0) AS last_frame FROM ev GROUP BY fight_id")
def _(m):
    return m.events.groupBy("fight_id").agg(F.coalesce(F.max(F.when(F.col("k") > 98, F.col("frame"))), F.lit(0)).alias("last_frame"))


# ---------------------------------------------------------------- scores

TOLERANCE = 300


def matched(m) -> DataFrame:
    truth = label_rows(m.events).where("row_kind = 'strike'")
    return match(truth, _strikes(m), TOLERANCE, "fight_id")


@query("M-01")
def _(m):
    return matched(m)


@query("M-02")
def _(m):
    return peaks(_strikes(m).withColumnRenamed("value", "score"), 600, "fight_id", "corner")


def prf(pairs: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, and the median offset and absolute offset."""
    a, b = F.col("truth_id").isNotNull(), F.col("found_id").isNotNull()
    t = pairs.groupBy(*keys).agg(F.count_if(a & b).alias("tp"), F.count_if(~a).alias("fp"), F.count_if(~b).alias("fn"), F.median("offset").alias("bias"), F.median(F.abs("offset")).alias("jitter"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.withColumn("precision", p).withColumn("recall", r).withColumn("f1", share(2 * p * r, p + r))


@query("A-07")
def _(m):
    return prf(matched(m), "fight_id")


def pair_accuracy(pairs: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """Numerators and denominators over matched pairs: fighter (where known),
    family (specific predictions), target (known), landed (both known)."""
    t = pairs.where("truth_id is not null and found_id is not null")
    t = t.join(truth.select(F.col("event_id").alias("truth_id"), *(F.col(c).alias(f"t_{c}") for c in ("fighter", "family", "zone", "success"))), "truth_id")
    t = t.join(found.select(F.col("event_id").alias("found_id"), *(F.col(c).alias(f"f_{c}") for c in ("fighter", "family", "zone", "success"))), "found_id")
    c = F.col
    specific = is_specific(c("f_family"), c("f_zone"))
    conds = {"fighter": c("f_fighter") != "unknown", "family": specific, "zone": specific & (c("t_zone") != "unknown"), "success": c("t_success").isNotNull() & c("f_success").isNotNull()}
    n = [x for k, cond in conds.items() for x in (F.count_if(cond).alias(f"{k}_total"), F.count_if(cond & (c(f"t_{k}") == c(f"f_{k}"))).alias(f"{k}_correct"))]
    return t.groupBy("fight_id").agg(*n, F.count_if(~specific).alias("nonspecific"))


@query("A-08")
def _(m):
    return pair_accuracy(matched(m), label_rows(m.events).where("row_kind = 'strike'"), _strikes(m))


def confusion(m) -> DataFrame:
    """Families of matched pairs with a specific prediction: gt, pred, n."""
    truth, found = label_rows(m.events).where("row_kind = 'strike'"), _strikes(m)
    t = matched(m).join(truth.select(F.col("event_id").alias("truth_id"), F.col("family").alias("gt")), "truth_id").join(found.where(is_specific(F.col("family"), F.col("zone"))).select(F.col("event_id").alias("found_id"), F.col("family").alias("pred")), "found_id")
    return t.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("A-09")
def _(m):
    return confusion(m)


@query("T-03")
def _(m):
    return confusion(m).orderBy(F.desc("n"), "gt", "pred").limit(10)


@query("T-02", PS_SQL + " SELECT fight_id, event_id, frame FROM ps QUALIFY row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) <= 8")
def _(m):
    w = Window.partitionBy("fight_id").orderBy("frame", "event_id")
    return _strikes(m).withColumn("_r", F.row_number().over(w)).where("_r <= 8").select("fight_id", "event_id", "frame")


def agreement(one: DataFrame, other: DataFrame, tolerance: int, *keys: str) -> DataFrame:
    """How well two labelling passes agree: keys, tolerance, tp, fp, fn and f1. Neither is
    the truth, and F1 is the same either way round."""
    t = prf(match(one, other, tolerance, *keys), *keys)
    return t.select(*keys, F.lit(tolerance).alias("tolerance"), "tp", "fp", "fn", "f1")


def ceilings(scores: DataFrame, agreements: DataFrame, *keys: str) -> DataFrame:
    """Add ``ceiling`` to scores (keys, tolerance): the agreement's F1 if it was measured at the
    same tolerance, else null; and ``comparable`` (null without an agreement)."""
    a = agreements.select(*keys, F.col("tolerance").alias("_tolerance"), F.col("f1").alias("_f1"))
    t = scores.join(a, list(keys), "left").withColumn("comparable", F.col("_tolerance") == F.col("tolerance"))
    return t.withColumn("ceiling", F.when(F.col("comparable"), F.col("_f1"))).drop("_tolerance", "_f1")


@query("A-44")
def _(m):
    """The labels against a second pass that has moved some and left out others."""
    one = label_rows(m.events).where("row_kind = 'strike'")
    other = one.where("k % 7 > 0").withColumn("frame", F.col("frame") + (F.col("k") % 5 - 2) * 40)
    agreements = agreement(one, other, 60, "fight_id")
    scores = m.fights.select("fight_id", F.when(F.col("fight_id") % 3 > 0, 60).otherwise(12).alias("tolerance"))
    return ceilings(scores, agreements, "fight_id")
