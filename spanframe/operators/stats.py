"""Fighter statistics over scopes, pace and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import CLINCH_ACTIONS, GROUND_ACTIONS, STATE_MARK, half_up, lookup
from spanframe.operators.asof import asof

PREDICTION = "prediction"


def is_strike(action: Column) -> Column:
    """Strikes are all actions but marks, grappling and endings; null is none."""
    other = action.startswith("round_") | action.startswith("state_") | action.startswith("takedown_") | action.isin("clinch_initiated", "submission_attempt", "fight_end")
    return F.coalesce(~other, F.lit(False))


def attributed(source: Column, corner: Column, fighter_id: Column, red_id: Column) -> Column:
    """red or blue: predictions by fighter (any but red's is blue), labels by corner."""
    by_fighter = F.when(fighter_id.isNull(), None).when(fighter_id == red_id, "red").otherwise("blue")
    return F.when(source == PREDICTION, by_fighter).when(corner == 0, "red").when(corner == 1, "blue")


def target_of(target: Column, action: Column) -> Column:
    by_name = F.when(action.endswith("_head") | (action == "head_kick"), "head").when(action.endswith("_body") | (action == "middle_kick"), "body").when(action == "low_kick", "leg")
    return F.when(target.isin("head", "body", "leg"), target).otherwise(by_name)


def has_landed(source: Column, action: Column, success: Column) -> Column:
    return (source == "label") | action.isin(*CLINCH_ACTIONS, *GROUND_ACTIONS) | success.eqNullSafe(True)


def strikes(events: DataFrame, fights: DataFrame) -> DataFrame:
    """Strikes with side, range (clinch, ground or distance), target and landed.

    A labelled knee is a clinch strike if the labelled state there is CLINCH.
    """
    marks = events.where(F.col("source") == "label").withColumn("mark_state", lookup(STATE_MARK, "action")).where("mark_state is not null")
    hit = events.where(is_strike(F.col("action")) & ~((F.col("source") == PREDICTION) & F.col("state").isNotNull()))
    t = asof(hit, marks, ["mark_state"]).join(fights.select("fight_id", "red_fighter_id"), "fight_id")
    side = attributed(F.col("source"), F.col("corner"), F.col("fighter_id"), F.col("red_fighter_id"))
    knee = (F.col("source") == "label") & (F.col("action") == "knee") & F.col("mark_state").eqNullSafe("CLINCH")
    t = t.withColumn("side", side).where("side is not null")
    t = t.withColumn("range", F.when(F.col("action").isin(*CLINCH_ACTIONS) | knee, "clinch").when(F.col("action").isin(*GROUND_ACTIONS), "ground").otherwise("distance"))
    return t.withColumn("zone", target_of(F.col("target"), F.col("action"))).withColumn("landed", has_landed(F.col("source"), F.col("action"), F.col("success")))


def control(events: DataFrame, fights: DataFrame, scopes: DataFrame) -> DataFrame:
    """fight_id, scope, side, seconds of ground control and takedowns.

    Per scope: predicted state rows inside it; a ground span starts at the first
    GROUND row, belongs to that row's side, and ends at the next row with another
    state; one that is still open ends at the scope's end, or at the last event
    inside an unbounded scope (null end_frame).
    """
    e = events.join(scopes, "fight_id").where((F.col("frame") >= F.col("start_frame")) & (F.col("end_frame").isNull() | (F.col("frame") <= F.col("end_frame"))))
    e = e.join(fights.select("fight_id", "fps", "red_fighter_id"), "fight_id")
    e = e.withColumn("_last", F.max("frame").over(Window.partitionBy("fight_id", "scope")))
    rows = e.where((F.col("source") == PREDICTION) & F.col("state").isNotNull())
    rows = rows.withColumn("side", attributed(F.col("source"), F.col("corner"), F.col("fighter_id"), F.col("red_fighter_id")))
    w = Window.partitionBy("fight_id", "scope").orderBy("frame", "event_id")
    ground = F.col("state") == "GROUND"
    rows = rows.withColumn("_opens", ground & ~F.coalesce(F.lag(ground).over(w), F.lit(False)))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_close", F.min(F.when(~ground, F.col("frame"))).over(after))
    end = F.coalesce("_close", "end_frame", "_last")
    seconds = F.when(F.col("_opens"), (end - F.col("frame")) / F.col("fps"))
    t = rows.groupBy("fight_id", "scope", "side").agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("_s"), F.count_if(F.col("action").eqNullSafe("takedown_initiated")).alias("takedowns"))
    return t.select("fight_id", "scope", "side", half_up(F.round("_s", 6)).alias("control_secs"), "takedowns")


def scoped_stats(events: DataFrame, fights: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row per fight, scope and side, zero-filled.

    ``scopes``: fight_id, scope, start_frame, end_frame (null: unbounded). A
    knockdown is a strike as well; submissions are no strikes, so ``sub`` is 0.
    """
    t = strikes(events, fights).join(scopes, "fight_id").where((F.col("frame") >= F.col("start_frame")) & (F.col("end_frame").isNull() | (F.col("frame") <= F.col("end_frame"))))
    n = lambda cond: F.count_if(cond)
    landed, r, z = F.col("landed"), F.col("range"), F.col("zone")
    hits = t.groupBy("fight_id", "scope", "side").agg(
        n(landed).alias("sig_landed"),
        F.count(F.lit(1)).alias("sig_thrown"),
        n(landed & (r == "distance") & (z == "head")).alias("head"),
        n(landed & (r == "distance") & (z == "body")).alias("body"),
        n(landed & (r == "distance") & (z == "leg")).alias("leg"),
        n(landed & (r == "distance")).alias("distance"),
        n(landed & (r == "clinch")).alias("clinch"),
        n(landed & (r == "ground")).alias("ground"),
        n(F.col("action") == "knockdown").alias("kd"),
    )
    sides = scopes.select("fight_id", "scope", F.explode(F.array(F.lit("red"), F.lit("blue"))).alias("side"))
    keys = ["fight_id", "scope", "side"]
    out = sides.join(hits, keys, "left").join(control(events, fights, scopes), keys, "left").fillna(0)
    acc = F.when(F.col("sig_thrown") > 0, half_up(F.col("sig_landed") / F.col("sig_thrown") * 100)).otherwise(F.lit(0))
    return out.withColumn("acc", acc.cast("long"))


def scopes_of(fights: DataFrame, rounds: DataFrame, live_frame: int) -> DataFrame:
    """The whole fight, the live part up to ``live_frame``, and each round."""
    whole = fights.select("fight_id", F.lit("fight").alias("scope"), F.lit(0).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"))
    live = fights.select("fight_id", F.lit("live").alias("scope"), F.lit(0).cast("long").alias("start_frame"), F.lit(live_frame).cast("long").alias("end_frame"))
    each = rounds.select("fight_id", F.concat(F.lit("round "), F.col("round_number")).alias("scope"), "start_frame", "end_frame")
    return whole.unionByName(live).unionByName(each)


def pace(events: DataFrame, fights: DataFrame, seconds: float, bucket: int = 30) -> DataFrame:
    """Landed strikes per side in tumbling buckets, zero-filled: at least two
    buckets, as many as ``seconds`` or the last event need; later ones go to the last."""
    t = events.join(fights.select("fight_id", "fps", "red_fighter_id"), "fight_id")
    last = t.groupBy("fight_id").agg(F.max(F.col("frame") / F.col("fps")).alias("_last"))
    n = F.greatest(F.lit(2), F.ceil(F.greatest(F.lit(float(seconds)), F.coalesce("_last", F.lit(0.0))) / bucket)).cast("int")
    slots = fights.join(last, "fight_id", "left").select("fight_id", n.alias("_n"))
    hit = t.where(is_strike(F.col("action")) & has_landed(F.col("source"), F.col("action"), F.col("success")))
    hit = hit.withColumn("side", attributed(F.col("source"), F.col("corner"), F.col("fighter_id"), F.col("red_fighter_id"))).where("side is not null")
    hit = hit.join(slots, "fight_id").withColumn("bucket", F.least(F.col("_n") - 1, F.floor(F.col("frame") / F.col("fps") / bucket)).cast("int"))
    counts = hit.groupBy("fight_id", "bucket").agg(F.count_if(F.col("side") == "red").alias("red"), F.count_if(F.col("side") == "blue").alias("blue"))
    grid = slots.select("fight_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("bucket"))
    return grid.join(counts, ["fight_id", "bucket"], "left").fillna(0)
