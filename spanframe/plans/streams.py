"""Streams run over the whole log; their results equal those of a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanframe.plans import machines
from spanframe.plans.registry import query
from spanframe.streaming import changes, live
from spanframe.streaming import machines as live_machines


def _home(spark):
    return f"{live.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("ST-06", "SELECT user_id::BIGINT AS fight_id, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k')::INT % 2 = 1) AS labels FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def _(m):
    totals = live.live_totals(live.event_stream(m.spark, m.sf_dir), "2024-01-20 00:00:00")
    return live.as_of_last(live.run_to_table(totals, _home(m.spark), "update"), "fight_id")


@query("ST-07", "SELECT user_id::BIGINT AS fight_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(m):
    buckets = live.live_buckets(live.event_stream(m.spark, m.sf_dir))
    return live.as_of_last(live.run_to_table(buckets, _home(m.spark), "update"), "fight_id", "day")


@query("ST-05", machines.SEGMENT_SQL)
def _(m):
    spark = live.stateful(m.spark)
    frame = F.expr("cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 6e7) as bigint) + 1")
    at = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")
    frames = machines.seen_frames(live.event_stream(spark, m.sf_dir).withColumns({"frame": frame, "at": at}), "at")
    # a fight is over after 90 days without frames, longer than the log
    emitted = live_machines.live_rounds(frames, machines.RULES, idle_ms=90 * 86_400_000)
    return live_machines.rounds_so_far(live.run_to_table(emitted, _home(spark)))


# ---------------------------------------------------------------- changes of state

# a predicted signup writes a fight's state; every seventh writes none
WRITES_SQL = """wr AS (SELECT user_id::BIGINT AS fight_id, ts AS t, event_id::BIGINT AS seq, json_extract_string(props, '$.k')::INT AS k FROM events),
    ws AS (SELECT fight_id, t, seq, CASE WHEN k % 7 > 0 THEN ['queued', 'processing', 'ready_to_label', 'failed'][k % 4 + 1] END AS state FROM wr WHERE k % 2 = 0)"""


def state_writes(events):
    """fight_id, state, at, seq of events with fight_id, ts, event_id, k."""
    k = F.col("k")
    state = F.when(k % 7 > 0, F.element_at(F.array(*map(F.lit, ("queued", "processing", "ready_to_label", "failed"))), k % 4 + 1))
    return events.where(k % 2 == 0).select("fight_id", state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query("ST-01", WRITES_SQL + """ SELECT fight_id, seq, '{"id":' || fight_id || ',"state":' || coalesce('"' || state || '"', 'null') || '}' AS payload FROM ws""")
def _(m):
    feed = changes.change_feed(state_writes(live.event_stream(m.spark, m.sf_dir)))
    return live.run_to_table(feed, _home(m.spark)).drop("batch")


@query("ST-03", WRITES_SQL + " SELECT fight_id, coalesce(state, '') AS state, seq FROM ws QUALIFY row_number() OVER (PARTITION BY fight_id ORDER BY t DESC, seq DESC) = 1")
def _(m):
    # the snapshot was taken in the middle of the month; the stream has all of it
    spark = m.spark
    events = m.table("events").select(F.col("user_id").cast("long").alias("fight_id"), "ts", F.col("event_id").cast("long").alias("event_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    snapshot = changes.latest(state_writes(events.where("ts < timestamp_ntz'2024-01-16 00:00:00'")))
    emitted = live.run_to_table(changes.deltas(state_writes(live.event_stream(spark, m.sf_dir)), snapshot), _home(spark), "update")
    return changes.current(snapshot, emitted).select("fight_id", F.coalesce("state", F.lit("")).alias("state"), "seq")
