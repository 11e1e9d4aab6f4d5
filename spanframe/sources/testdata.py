"""The event model over the star schema: adapter views in Spark and in SQL.

A "fight" is a user of ``events``; a frame is a minute since 2024-01-01, read as
1/50 s, so that a month makes a fight of 43,200 frames. Even ``k`` are predicted
events, odd ones labels. Rounds are three fixed spans for each fight.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import STATE_MARK
from spanframe.sources.files import shared_folder

FPS = 50
ROUND_FRAMES = 14_400
ROUND_COUNT = 3
#: Frames of a fight.
FRAMES = ROUND_FRAMES * ROUND_COUNT

#: (source, event type) -> the action for each (k div 2) % 4.
ACTIONS = {
    ("prediction", "click"): ("jab_head", "cross_body", "uppercut_head", "clinch_punch"),
    ("prediction", "view"): ("hook_body", "hook_head", "ground_punch", "knee"),
    ("prediction", "purchase"): ("low_kick", "middle_kick", "head_kick", "clinch_knee"),
    ("prediction", "error"): ("takedown_initiated", "clinch_initiated", "takedown_initiated", "clinch_initiated"),
    ("label", "click"): ("jab", "cross", "left_uppercut", "knee"),
    ("label", "view"): ("left_hook", "right_hook", "ground_punch", "elbow"),
    ("label", "purchase"): ("low_kick", "calf_kick", "high_kick", "knockdown"),
    ("label", "error"): ("takedown_landed", "takedown_attempt", "takedown_defended", "submission_attempt"),
}
_FIXED_TARGET = {"low_kick": "leg", "calf_kick": "leg", "high_kick": "head"}
_AIMED = ("jab", "cross", "left_uppercut", "left_hook", "right_hook", "elbow")


@dataclass(frozen=True, eq=False)
class Model:
    """The views of one data directory; each is a lazy DataFrame.

    With ``stored`` the decoded events and the fights are written once to the shared
    folder and read from there, for queries that use them many times: the log is then
    scanned and its JSON parsed once, and the copy has its columns as they are used."""

    spark: SparkSession
    sf_dir: str
    stored: bool = False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _kept(self, view: DataFrame, name: str) -> DataFrame:
        if not self.stored:
            return view
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        view.write.parquet(path)
        return self.spark.read.schema(view.schema).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        """fight_id, event_id, frame, k, source, corner, fighter_id, action, state, target, success, value."""
        frame = F.expr("cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 6e7) as bigint) + 1").alias("frame")
        k = F.get_json_object("props", "$.k").cast("int").alias("k")
        # a generator of one row: else the optimizer parses the JSON anew for every use of k
        t = self.table("events").select(F.col("user_id").cast("long").alias("fight_id"), F.col("event_id").cast("long").alias("event_id"), F.inline(F.array(F.struct(frame, k))), "event_type", "value")
        t = t.withColumn("source", F.when(F.col("k") % 2 == 0, "prediction").otherwise("label"))
        place = F.expr("(k div 2) % 4").cast("int") + 1
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), place)
        third = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("k") % 3 + 1).cast("int"))
        action = F.when((F.col("source") == "label") & (F.col("event_type") == "signup"), third(STATE_MARK))
        for (source, kind), values in ACTIONS.items():
            action = action.when((F.col("source") == source) & (F.col("event_type") == kind), pick(values))
        t = t.withColumn("action", action)
        state = (
            F.when((F.col("source") == "prediction") & (F.col("event_type") == "signup"), third(STATE_MARK.values()))
            .when(F.col("action") == "takedown_initiated", "GROUND")
            .when(F.col("action") == "clinch_initiated", "CLINCH")
        )
        label = F.col("source") == "label"
        target = F.when(label & F.col("action").isin(*_AIMED), third(("head", "body", None)))
        for name, fixed in _FIXED_TARGET.items():
            target = target.when(label & (F.col("action") == name), fixed)
        success = F.when(~label & F.col("state").isNull(), third((True, False, None))).when(F.col("action").isin("knockdown", "takedown_landed"), True)
        corner = (F.col("event_id") % 2).cast("int")
        t = t.select(
            "fight_id", "event_id", "frame", "k", "source", corner.alias("corner"), (F.col("fight_id") * 2 + corner).alias("fighter_id"),
            "action", state.alias("state"), target.alias("target"), success.alias("success"), "value",
        )
        return self._kept(t, "events")

    @cached_property
    def fights(self) -> DataFrame:
        """fight_id, fps, red_fighter_id, blue_fighter_id, purpose, state."""
        log = self.events.select("fight_id") if self.stored else self.table("events").select(F.col("user_id").cast("long").alias("fight_id"))
        f = log.distinct()
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("fight_id") % len(values) + 1).cast("int"))
        f = f.select(
            "fight_id",
            F.lit(FPS).alias("fps"),
            (F.col("fight_id") * 2).alias("red_fighter_id"),
            (F.col("fight_id") * 2 + 1).alias("blue_fighter_id"),
            pick(("training_data", "reference", "ai_labeled")).alias("purpose"),
            pick(("complete", "labeling", "failed", "ready_to_label", "processing")).alias("state"),
        )
        return self._kept(f, "fights")

    @cached_property
    def rounds(self) -> DataFrame:
        """fight_id, round_number, start_frame, end_frame."""
        n = F.explode(F.sequence(F.lit(1), F.lit(ROUND_COUNT)))
        r = self.fights.select("fight_id", n.alias("round_number"))
        start, end = (F.col("round_number") - 1) * ROUND_FRAMES + 601, F.col("round_number") * ROUND_FRAMES - 600
        return r.select("fight_id", "round_number", start.cast("long").alias("start_frame"), end.cast("long").alias("end_frame"))

    def _spans(self, kind: str, least: int, length: int) -> DataFrame:
        names = ACTIONS["label", kind]
        e = self.events.where((F.col("source") == "label") & F.col("action").isin(*names) & (F.col("k") >= least))
        return e.select("fight_id", "event_id", F.col("frame").alias("start_frame"), (F.col("frame") + length).alias("end_frame"))

    @cached_property
    def excluded(self) -> DataFrame:
        """Spans left out of scoring: fight_id, event_id, start_frame, end_frame."""
        return self._spans("error", 80, 720)

    @cached_property
    def swaps(self) -> DataFrame:
        """Spans in which the corners are swapped."""
        return self._spans("view", 90, 900)


def _actions_sql() -> str:
    arms = [f"WHEN source = '{s}' AND event_type = '{t}' THEN {list(v)!r}[(k // 2) % 4 + 1]" for (s, t), v in ACTIONS.items()]
    return "CASE WHEN source = 'label' AND event_type = 'signup' THEN " + f"{list(STATE_MARK)!r}[k % 3 + 1] " + " ".join(arms) + " END"


#: The same views for DuckDB, to be put after WITH.
SQL_VIEWS = f"""
ev0 AS (
    SELECT user_id::BIGINT AS fight_id, event_id::BIGINT AS event_id,
           floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 6e7)::BIGINT + 1 AS frame,
           json_extract_string(props, '$.k')::INT AS k, event_type, value,
           CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'prediction' ELSE 'label' END AS source
    FROM events
), ev1 AS (SELECT *, {_actions_sql()} AS action FROM ev0),
ev AS (
    SELECT fight_id, event_id, frame, k, source, (event_id % 2)::INT AS corner, fight_id * 2 + event_id % 2 AS fighter_id, action,
           CASE WHEN source = 'prediction' AND event_type = 'signup' THEN {list(STATE_MARK.values())!r}[k % 3 + 1]
                WHEN action = 'takedown_initiated' THEN 'GROUND' WHEN action = 'clinch_initiated' THEN 'CLINCH' END AS state,
           CASE WHEN source = 'label' AND action IN ('jab', 'cross', 'left_uppercut', 'left_hook', 'right_hook', 'elbow') THEN ['head', 'body', NULL][k % 3 + 1]
                WHEN source = 'label' AND action IN ('low_kick', 'calf_kick') THEN 'leg'
                WHEN source = 'label' AND action = 'high_kick' THEN 'head' END AS target,
           CASE WHEN source = 'prediction' AND event_type NOT IN ('signup', 'error') THEN [true, false, NULL][k % 3 + 1]
                WHEN action IN ('knockdown', 'takedown_landed') THEN true END AS success,
           value
    FROM ev1
), fights AS (
    SELECT fight_id, {FPS} AS fps, fight_id * 2 AS red_fighter_id, fight_id * 2 + 1 AS blue_fighter_id,
           ['training_data', 'reference', 'ai_labeled'][fight_id % 3 + 1] AS purpose,
           ['complete', 'labeling', 'failed', 'ready_to_label', 'processing'][fight_id % 5 + 1] AS state
    FROM (SELECT DISTINCT user_id::BIGINT AS fight_id FROM events)
), rounds AS (
    SELECT fight_id, n::INT AS round_number, (n - 1) * {ROUND_FRAMES} + 601 AS start_frame, n * {ROUND_FRAMES} - 600 AS end_frame
    FROM fights, range(1, {ROUND_COUNT + 1}) t(n)
), excluded AS (
    SELECT fight_id, event_id, frame AS start_frame, frame + 720 AS end_frame FROM ev
    WHERE source = 'label' AND k >= 80 AND action IN ('takedown_landed', 'takedown_attempt', 'takedown_defended', 'submission_attempt')
), swaps AS (
    SELECT fight_id, event_id, frame AS start_frame, frame + 900 AS end_frame FROM ev
    WHERE source = 'label' AND k >= 90 AND action IN ('left_hook', 'right_hook', 'ground_punch', 'elbow')
)"""
