"""Interval algebra, joins on the frame axis, runs and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import STATE_MARK, lookup, sql_lookup
from spanframe.operators import intervals, runs
from spanframe.operators.asof import asof, nearest
from spanframe.plans.events import LABELS_SQL
from spanframe.plans.registry import query
from spanframe.plans.statistics import MARKS_SQL
from spanframe.sources.testdata import FPS, FRAMES

S, E = "start_frame", "end_frame"
IN_ROUND_SQL = "inr AS (SELECT DISTINCT r.fight_id, t.f AS frame FROM rounds r, range(1, 43201) t(f) WHERE t.f BETWEEN r.start_frame AND r.end_frame)"


def _spans(m, kind: str) -> DataFrame:
    """Labelled or predicted clicks as spans of varying length."""
    e = m.events.where((F.col("source") == kind) & (F.col("k") < 60))
    return e.select("fight_id", "event_id", F.col("frame").alias(S), (F.col("frame") + F.col("k") * 20).alias(E))


SPANS_SQL = "sp AS (SELECT fight_id, event_id, source, frame AS s, frame + k * 20 AS e FROM ev WHERE k < 60), lsp AS (SELECT * FROM sp WHERE source = 'label'), psp AS (SELECT * FROM sp WHERE source = 'prediction')"


@query("I-02", SPANS_SQL + " SELECT l.event_id AS a, p.event_id AS b, least(l.e, p.e) - greatest(l.s, p.s) + 1 AS shared, round((least(l.e, p.e) - greatest(l.s, p.s) + 1) / ((l.e - l.s + 1) + (p.e - p.s + 1) - (least(l.e, p.e) - greatest(l.s, p.s) + 1)), 6) AS iou FROM lsp l JOIN psp p ON l.fight_id = p.fight_id AND l.s <= p.e AND p.s <= l.e")
def _(m):
    a, b = _spans(m, "label").alias("l"), _spans(m, "prediction").alias("p")
    c = F.col
    t = a.join(b, (c("l.fight_id") == c("p.fight_id")) & (c("l.start_frame") <= c("p.end_frame")) & (c("p.start_frame") <= c("l.end_frame")))
    x, y = (c("l.start_frame"), c("l.end_frame")), (c("p.start_frame"), c("p.end_frame"))
    return t.select(c("l.event_id").alias("a"), c("p.event_id").alias("b"), intervals.overlap(x, y).alias("shared"), F.round(intervals.iou(x, y), 6).alias("iou"))


_UNION_SQL = """f AS (SELECT DISTINCT fight_id, t.f AS frame FROM {0}, range(1, 60000) t(f) WHERE t.f BETWEEN s AND e),
    g AS (SELECT fight_id, frame, frame - row_number() OVER (PARTITION BY fight_id ORDER BY frame) AS grp FROM f)"""


@query("I-04", SPANS_SQL + ", " + _UNION_SQL.format("lsp") + " SELECT fight_id, min(frame) AS start_frame, max(frame) AS end_frame FROM g GROUP BY fight_id, grp")
def _(m):
    return intervals.coalesced(_spans(m, "label"), "fight_id")


@query(
    "I-01",
    """f AS (SELECT r.fight_id, r.round_number, t.f AS frame FROM rounds r, range(1, 43201) t(f) WHERE t.f BETWEEN r.start_frame AND r.end_frame
              AND NOT EXISTS (FROM excluded x WHERE x.fight_id = r.fight_id AND t.f BETWEEN x.start_frame AND x.end_frame)),
    g AS (SELECT *, frame - row_number() OVER (PARTITION BY fight_id, round_number ORDER BY frame) AS grp FROM f)
    SELECT fight_id, round_number, min(frame) AS start_frame, max(frame) AS end_frame FROM g GROUP BY fight_id, round_number, grp""",
)
def _(m):
    return intervals.subtracted(m.rounds, m.excluded, "fight_id", carry=["round_number"])


@query(
    "I-03",
    IN_ROUND_SQL + " SELECT fight_id, count(*)::BIGINT AS frames FROM inr i WHERE NOT EXISTS (FROM excluded x WHERE x.fight_id = i.fight_id AND i.frame BETWEEN x.start_frame AND x.end_frame) GROUP BY fight_id",
)
def _(m):
    t = intervals.scored_spans(m.rounds, m.excluded, "fight_id")
    return t.groupBy("fight_id").agg(F.sum(F.col(E) - F.col(S) + 1).alias("frames"))


@query("U-03", IN_ROUND_SQL + " SELECT fight_id, frame FROM inr WHERE frame % 100 = 0 EXCEPT SELECT x.fight_id, t.f FROM excluded x, range(1, 45000) t(f) WHERE t.f BETWEEN x.start_frame AND x.end_frame")
def _(m):
    # frames of every 100th place only, as the SQL has it; U-03-frames has them all
    step = F.lit(100).cast("long")
    grid = lambda t: intervals.spread(t, "fight_id", S).select("fight_id", F.explode(F.filter(F.sequence(F.ceil(F.col(S) / 100) * 100, F.greatest(F.col(E), F.ceil(F.col(S) / 100) * 100), step), lambda f: f <= F.col(E))).alias("frame"))
    return grid(m.rounds).subtract(grid(m.excluded))


@query("U-03-frames", IN_ROUND_SQL + " SELECT fight_id, frame FROM inr EXCEPT SELECT x.fight_id, t.f FROM excluded x, range(1, 45000) t(f) WHERE t.f BETWEEN x.start_frame AND x.end_frame")
def _(m):
    # the whole difference of U-03, by intervals; only what remains is exploded
    left = intervals.spread(intervals.scored_spans(m.rounds, m.excluded, "fight_id"), "fight_id", S)
    return left.select("fight_id", F.explode(F.sequence(S, E)).alias("frame"))


@query("I-08", f"SELECT fight_id, greatest(1, floor((max(frame) / {FPS} + 30) / 90))::BIGINT AS max_rounds FROM ev GROUP BY fight_id")
def _(m):
    return m.events.groupBy("fight_id").agg(F.greatest(F.lit(1).cast("long"), F.floor((F.max("frame") / FPS + 30) / 90)).alias("max_rounds"))


def split_round(rounds: DataFrame, at: DataFrame) -> DataFrame:
    """Cut the round that holds frame ``at`` in two and number all by time."""
    t = rounds.join(at.select("fight_id", F.col("frame").alias("_at")), "fight_id", "left")
    inside = F.col("_at").isNotNull() & (F.col("_at") > F.col(S)) & (F.col("_at") <= F.col(E))
    whole = F.array(F.struct(F.col(S).alias("s"), F.col(E).alias("e")))
    parts = F.array(F.struct(F.col(S).alias("s"), (F.col("_at") - 1).alias("e")), F.struct(F.col("_at").alias("s"), F.col(E).alias("e")))
    t = t.select("fight_id", F.explode(F.when(inside, parts).otherwise(whole)).alias("_p"))
    return t.select("fight_id", F.row_number().over(Window.partitionBy("fight_id").orderBy("_p.s")).alias("round_number"), F.col("_p.s").alias(S), F.col("_p.e").alias(E))


@query(
    "I-09",
    """a AS (SELECT fight_id, max(frame) AS x FROM ev GROUP BY fight_id), p AS (
        SELECT r.fight_id, start_frame AS s, CASE WHEN x > start_frame AND x <= end_frame THEN x - 1 ELSE end_frame END AS e FROM rounds r JOIN a USING (fight_id)
        UNION ALL SELECT r.fight_id, x, end_frame FROM rounds r JOIN a USING (fight_id) WHERE x > start_frame AND x <= end_frame)
    SELECT fight_id, row_number() OVER (PARTITION BY fight_id ORDER BY s)::INT AS round_number, s AS start_frame, e AS end_frame FROM p""",
)
def _(m):
    return split_round(m.rounds, m.events.groupBy("fight_id").agg(F.max("frame").alias("frame")))


@query(
    "I-10",
    f"""a AS (SELECT fight_id, max(frame) AS x FROM ev WHERE source = 'label' GROUP BY fight_id)
    SELECT a.fight_id, x + 1 AS start_frame, {FRAMES}::BIGINT AS end_frame, 'post fight_end' AS reason FROM a WHERE x < {FRAMES} AND NOT EXISTS (FROM excluded e WHERE e.fight_id = a.fight_id AND x + 1 BETWEEN e.start_frame AND e.end_frame)""",
)
def _(m):
    end = m.events.where("source = 'label'").groupBy("fight_id").agg((F.max("frame") + 1).alias("frame")).where(F.col("frame") <= FRAMES)
    tail = intervals.contained(end, m.excluded, how="left_anti")
    return tail.select("fight_id", F.col("frame").alias(S), F.lit(FRAMES).cast("long").alias(E), F.lit("post fight_end").alias("reason"))


@query("I-11", "SELECT event_id, least(frame, frame + k * 10 - 400) AS start_frame, greatest(frame, frame + k * 10 - 400) AS end_frame FROM ev")
def _(m):
    other = F.col("frame") + F.col("k") * 10 - 400
    return m.events.select("event_id", F.least("frame", other).alias(S), F.greatest("frame", other).alias(E))


@query("I-12", "SELECT r.fight_id, r.round_number, r.start_frame, r.end_frame FROM rounds r WHERE NOT EXISTS (FROM ev e WHERE e.fight_id = r.fight_id AND e.source = 'label' AND e.k > 90)")
def _(m):
    has_own = m.events.where("source = 'label' and k > 90").select("fight_id")
    return m.rounds.join(has_own, "fight_id", "left_anti")


STATE_SPANS_SQL = (
    LABELS_SQL
    + f""", spn AS (
        SELECT fight_id, event_id, mark_state, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY fight_id ORDER BY frame, event_id) - 1,
               (SELECT min(end_frame) FROM rounds r WHERE r.fight_id = lab.fight_id AND lab.frame BETWEEN r.start_frame AND r.end_frame), {FRAMES}) AS end_frame
        FROM lab WHERE row_kind = 'state'
    )"""
)


def state_spans(m) -> DataFrame:
    marks = m.events.where("source = 'label'").withColumn("mark_state", lookup(STATE_MARK, "action")).where("mark_state is not null")
    return intervals.spans_of_marks(marks.select("fight_id", "event_id", "frame", "mark_state"), m.rounds, FRAMES)


@query("W-01", STATE_SPANS_SQL + " SELECT fight_id, event_id, mark_state, start_frame, end_frame FROM spn")
def _(m):
    return state_spans(m).select("fight_id", "event_id", "mark_state", S, E)


@query("I-13", STATE_SPANS_SQL + ", cap AS (SELECT fight_id, 35000 - fight_id % 100 AS c FROM fights) SELECT s.fight_id, event_id, mark_state, start_frame, least(end_frame, c) AS end_frame FROM spn s JOIN cap USING (fight_id) WHERE start_frame <= c")
def _(m):
    t = state_spans(m).withColumn("_cap", F.lit(35000) - F.col("fight_id") % 100).where(F.col(S) <= F.col("_cap"))
    return t.select("fight_id", "event_id", "mark_state", S, F.least(E, "_cap").alias(E))


@query("I-14", "SELECT event_id, CASE WHEN EXISTS (FROM swaps s WHERE s.fight_id = ev.fight_id AND ev.frame BETWEEN s.start_frame AND s.end_frame) THEN 1 - corner ELSE corner END AS corner FROM ev")
def _(m):
    hit = intervals.contained(m.events, m.swaps).select("event_id", F.lit(True).alias("_in"))
    return m.events.join(hit, "event_id", "left").select("event_id", F.when(F.col("_in"), 1 - F.col("corner")).otherwise(F.col("corner")).alias("corner"))


# ---------------------------------------------------------------- state agreement


PRED_SQL = "pst AS (SELECT fight_id, frame, arg_max(state, event_id) AS ps FROM ev WHERE source = 'prediction' AND state IS NOT NULL GROUP BY fight_id, frame)"
FRAME_STATES_SQL = f"""{MARKS_SQL}, {PRED_SQL}, {IN_ROUND_SQL}, sc AS (
        SELECT * FROM inr i WHERE NOT EXISTS (FROM excluded x WHERE x.fight_id = i.fight_id AND i.frame BETWEEN x.start_frame AND x.end_frame)
    ), g AS (SELECT sc.fight_id, sc.frame, m.mark_state AS gt FROM sc ASOF LEFT JOIN marks m ON sc.fight_id = m.fight_id AND sc.frame >= m.frame),
    gp AS (SELECT g.fight_id, g.frame, gt, coalesce(p.ps, 'STRIKING') AS pr FROM g ASOF LEFT JOIN pst p ON g.fight_id = p.fight_id AND g.frame >= p.frame)"""


def state_segments(m) -> DataFrame:
    """Scored stretches in which neither the labelled nor the predicted state
    changes: fight_id, start_frame, end_frame, gt (null: not labelled), pr."""
    scored = intervals.scored_spans(m.rounds, m.excluded, "fight_id")
    labels = m.events.where("source = 'label'").withColumn("gt", lookup(STATE_MARK, "action")).where("gt is not null")
    preds = m.events.where("source = 'prediction' and state is not null").withColumn("pr", F.col("state"))
    point = lambda t: t.select("fight_id", F.col("frame").alias(S), (F.col("frame") - 1).alias(E))  # noqa: E731  a cut before each change
    cells = intervals.elementary(scored.unionByName(point(labels)).unionByName(point(preds)), "fight_id")
    cells = intervals.contained(cells.withColumn("frame", F.col(S)), scored.select("fight_id", S, E)).withColumn("event_id", F.lit(0).cast("long"))
    t = asof(cells, labels, ["gt"]).drop("mark_frame")
    return asof(t, preds, ["pr"]).select("fight_id", S, E, "gt", F.coalesce("pr", F.lit("STRIKING")).alias("pr"))


@query("I-05", FRAME_STATES_SQL + " SELECT fight_id, gt, pr, count(*)::BIGINT AS frames FROM gp WHERE gt IS NOT NULL GROUP BY ALL")
def _(m):
    return state_segments(m).where("gt is not null").groupBy("fight_id", "gt", "pr").agg(F.sum(F.col(E) - F.col(S) + 1).alias("frames"))


@query("A-10", FRAME_STATES_SQL + " SELECT fight_id, count(*)::BIGINT AS frames_scored, count(*) FILTER (WHERE gt = pr)::BIGINT AS frames_correct, round(count(*) FILTER (WHERE gt = pr) / count(*), 6) AS accuracy FROM gp WHERE gt IS NOT NULL GROUP BY ALL")
def _(m):
    n = F.col(E) - F.col(S) + 1
    t = state_segments(m).where("gt is not null").groupBy("fight_id").agg(F.sum(n).alias("frames_scored"), F.sum(F.when(F.col("gt") == F.col("pr"), n).otherwise(0)).alias("frames_correct"))
    return t.withColumn("accuracy", F.round(F.col("frames_correct") / F.col("frames_scored"), 6))


@query(
    "A-12",
    FRAME_STATES_SQL
    + f""", mins AS (SELECT fight_id, count(*) / {FPS} / 60 AS minutes FROM sc GROUP BY fight_id),
    i AS (SELECT fight_id, frame, pr, lag(pr) OVER (PARTITION BY fight_id ORDER BY frame) IS DISTINCT FROM pr AS n FROM gp),
    r AS (SELECT fight_id, sum(n::INT) OVER (PARTITION BY fight_id ORDER BY frame) AS run FROM i),
    d AS (SELECT fight_id, run, count(*) AS len FROM r GROUP BY ALL)
    SELECT d.fight_id, round((count(*) - 1) / any_value(minutes), 6) AS transitions_per_min, round(median(len) / {FPS}, 6) AS median_dwell FROM d JOIN mins USING (fight_id) GROUP BY d.fight_id""",
)
def _(m):
    t = runs.with_run(state_segments(m), "pr", "fight_id", order=[S]).groupBy("fight_id", "run").agg(F.sum(F.col(E) - F.col(S) + 1).alias("len"))
    out = t.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("frames"), F.median("len").alias("dwell"))
    return out.select("fight_id", F.round((F.col("n") - 1) / (F.col("frames") / FPS / 60), 6).alias("transitions_per_min"), F.round(F.col("dwell") / FPS, 6).alias("median_dwell"))


@query("A-49", "c AS (SELECT fight_id, count(*) FILTER (WHERE source = 'prediction' AND state IS NOT NULL) AS p, count(*) FILTER (WHERE source = 'label' AND starts_with(coalesce(action, ''), 'state_')) AS g FROM ev GROUP BY fight_id) SELECT fight_id, p / 13.2 > 3 * greatest(g / 13.2, 0.1) AS flapping FROM c")
def _(m):
    t = m.events.groupBy("fight_id").agg(F.count_if((F.col("source") == "prediction") & F.col("state").isNotNull()).alias("p"), F.count_if((F.col("source") == "label") & F.coalesce("action", F.lit("")).startswith("state_")).alias("g"))
    return t.select("fight_id", (F.col("p") / 13.2 > 3 * F.greatest(F.col("g") / 13.2, F.lit(0.1))).alias("flapping"))


# ---------------------------------------------------------------- joins


@query("J-02", "SELECT event_id, fight_id, fps, purpose FROM ev JOIN fights USING (fight_id) WHERE source = 'label' AND purpose = 'training_data'")
def _(m):
    return m.events.where("source = 'label'").join(m.fights.where("purpose = 'training_data'"), "fight_id").select("event_id", "fight_id", "fps", "purpose")


@query("J-04", PRED_SQL + " SELECT e.event_id, e.fight_id, e.frame, coalesce(p.ps, 'STRIKING') AS state_at FROM (SELECT * FROM ev WHERE source = 'label') e ASOF LEFT JOIN pst p ON e.fight_id = p.fight_id AND e.frame >= p.frame")
def _(m):
    marks = m.events.where("source = 'prediction' and state is not null").withColumn("ps", F.col("state"))
    t = asof(m.events.where("source = 'label'").select("event_id", "fight_id", "frame"), marks, ["ps"], block=8192)
    return t.select("event_id", "fight_id", "frame", F.coalesce("ps", F.lit("STRIKING")).alias("state_at"))


@query("J-05", "SELECT e.event_id, r.round_number FROM ev e JOIN rounds r ON r.fight_id = e.fight_id AND e.frame BETWEEN r.start_frame AND r.end_frame")
def _(m):
    return intervals.banded(m.events.select("event_id", "fight_id", "frame"), m.rounds, 4096, extra=["round_number"]).select("event_id", "round_number")


def band_pairs(left: DataFrame, right: DataFrame, tol: int, *keys: str) -> DataFrame:
    """Pairs of one key whose frames differ by at most ``tol``: both sides meet in
    cells of tol + 1 frames, the right one in its cell and both neighbours."""
    cell = F.floor(F.col("frame") / (tol + 1))
    a = left.select(*keys, F.col("event_id").alias("left_id"), F.col("frame").alias("left_frame"), cell.alias("_cell"))
    b = right.select(*keys, F.col("event_id").alias("right_id"), F.col("frame").alias("right_frame"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col("left_frame") - F.col("right_frame")) <= tol).drop("_cell")


@query("J-06", "SELECT a.fight_id, a.corner, a.event_id AS left_id, b.event_id AS right_id, a.frame AS left_frame, b.frame AS right_frame FROM ev a JOIN ev b ON a.fight_id = b.fight_id AND a.corner = b.corner AND abs(a.frame - b.frame) <= 300 WHERE a.source = 'label' AND b.source = 'prediction'")
def _(m):
    return band_pairs(m.events.where("source = 'label'"), m.events.where("source = 'prediction'"), 300, "fight_id", "corner")


@query("J-07", SPANS_SQL + " SELECT r.fight_id, r.round_number, min(p.s) AS first_start, max(p.e) AS last_end, count(*) AS n FROM rounds r JOIN psp p ON p.fight_id = r.fight_id AND p.e >= r.start_frame AND p.s <= r.end_frame GROUP BY ALL")
def _(m):
    p = _spans(m, "prediction").select(F.col("fight_id").alias("_f"), F.col(S).alias("_s"), F.col(E).alias("_e"))
    t = m.rounds.join(p, (F.col("fight_id") == F.col("_f")) & (F.col("_e") >= F.col(S)) & (F.col("_s") <= F.col(E)))
    return t.groupBy("fight_id", "round_number").agg(F.min("_s").alias("first_start"), F.max("_e").alias("last_end"), F.count(F.lit(1)).alias("n"))


def best_overlaps(truth: DataFrame, found: DataFrame, *, key: str = "fight_id", name: str = "event_id", id: str | None = None) -> DataFrame:
    """Each truth span with the found span of highest IoU (of ties the one that
    starts first); spans without overlap are left out, found ones may repeat. ``id``
    tells truth spans of a key apart; without it those with equal bounds are one."""
    p = found.select(F.col(key).alias("_f"), F.col(name).alias("found_id"), F.col(S).alias("_s"), F.col(E).alias("_e"))
    t = truth.join(p, (F.col(key) == F.col("_f")) & (F.col("_e") >= F.col(S)) & (F.col("_s") <= F.col(E)))
    t = t.withColumn("iou", intervals.iou((F.col(S), F.col(E)), (F.col("_s"), F.col("_e"))))
    w = Window.partitionBy(key, *([id] if id else []), S, E).orderBy(F.desc("iou"), "_s", "found_id")
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("start_offset", F.col("_s") - F.col(S)).withColumn("end_offset", F.col("_e") - F.col(E)).drop("_r", "_f", "_s", "_e")


BEST_SQL = (
    SPANS_SQL
    + """, c AS (
        SELECT r.fight_id, r.round_number, p.event_id AS found_id, p.s - r.start_frame AS start_offset, p.e - r.end_frame AS end_offset, p.s,
               (least(r.end_frame, p.e) - greatest(r.start_frame, p.s) + 1) / ((r.end_frame - r.start_frame + 1) + (p.e - p.s + 1) - (least(r.end_frame, p.e) - greatest(r.start_frame, p.s) + 1)) AS iou
        FROM rounds r JOIN psp p ON p.fight_id = r.fight_id AND p.e >= r.start_frame AND p.s <= r.end_frame
    ), best AS (SELECT *, row_number() OVER (PARTITION BY fight_id, round_number ORDER BY iou DESC, s, found_id) AS n FROM c)"""
)


@query("J-08", BEST_SQL + " SELECT fight_id, round_number, found_id, round(iou, 9) AS iou, start_offset, end_offset FROM best WHERE n = 1")
def _(m):
    return best_overlaps(m.rounds, _spans(m, "prediction"), id="round_number").select("fight_id", "round_number", "found_id", F.round("iou", 9).alias("iou"), "start_offset", "end_offset")


@query("A-13", BEST_SQL + ", cnt AS (SELECT fight_id, count(*) AS found FROM psp GROUP BY fight_id) SELECT b.fight_id, round(avg(iou), 6) AS mean_iou, 3 = any_value(found) AS count_correct FROM best b JOIN cnt USING (fight_id) WHERE n = 1 GROUP BY b.fight_id")
def _(m):
    spans = _spans(m, "prediction")
    t = best_overlaps(m.rounds, spans).groupBy("fight_id").agg(F.round(F.avg("iou"), 6).alias("mean_iou"))
    counts = m.rounds.groupBy("fight_id").agg(F.count(F.lit(1)).alias("_t")).join(spans.groupBy("fight_id").agg(F.count(F.lit(1)).alias("_p")), "fight_id")
    return t.join(counts, "fight_id").select("fight_id", "mean_iou", (F.col("_t") == F.col("_p")).alias("count_correct"))


@query(
    "J-09",
    SPANS_SQL + ", c AS (SELECT fight_id, event_id, greatest(least(e, 21000) - greatest(s, 20000) + 1, 0) AS shared FROM psp), b AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY shared DESC, event_id) AS n FROM c WHERE shared > 0) SELECT fight_id, event_id, shared FROM b WHERE n = 1",
)
def _(m):
    t = _spans(m, "prediction").withColumn("shared", intervals.overlap((F.col(S), F.col(E)), (F.lit(20000), F.lit(21000)))).where("shared > 0")
    return t.groupBy("fight_id").agg(F.max(F.struct("shared", (-F.col("event_id")).alias("_e"))).alias("_m")).select("fight_id", (-F.col("_m._e")).alias("event_id"), F.col("_m.shared").alias("shared"))


NEAR_SQL = """one AS (SELECT fight_id, frame, max(event_id) AS mark_id, min(event_id) AS low_id FROM ev WHERE source = 'prediction' GROUP BY fight_id, frame),
    c AS (SELECT e.event_id, e.fight_id, e.frame, o.frame AS mark_frame, abs(o.frame - e.frame) AS distance, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(o.frame - e.frame), o.frame{0}) AS r
          FROM (SELECT * FROM ev WHERE source = 'label') e LEFT JOIN one o ON o.fight_id = e.fight_id)"""


@query("J-10", NEAR_SQL.format("") + " SELECT event_id, CASE WHEN distance < 200 THEN mark_frame END AS mark_frame, CASE WHEN distance < 200 THEN distance END AS distance FROM c WHERE r = 1")
def _(m):
    p = m.events.where("source = 'prediction'")
    return nearest(m.events.where("source = 'label'").select("event_id", "fight_id", "frame"), p, ["k"], within=200).select("event_id", "mark_frame", "distance")


@query("J-11", NEAR_SQL.format(" DESC") + " SELECT event_id, mark_frame, distance FROM c WHERE r = 1")
def _(m):
    p = m.events.where("source = 'prediction'")
    return nearest(m.events.where("source = 'label'").select("event_id", "fight_id", "frame"), p, ["k"], later_wins=True, block=10000).select("event_id", "mark_frame", "distance")


@query(
    "J-12",
    """b AS (SELECT DISTINCT fight_id, frame FROM ev WHERE state IS NOT NULL), c AS (SELECT r.fight_id, r.round_number, end_frame, b.frame, row_number() OVER (PARTITION BY r.fight_id, r.round_number ORDER BY abs(b.frame - r.end_frame), b.frame) AS n FROM rounds r LEFT JOIN b ON b.fight_id = r.fight_id)
    SELECT fight_id, round_number, CASE WHEN abs(frame - end_frame) <= 750 THEN frame ELSE end_frame END AS end_frame FROM c WHERE n = 1""",
)
def _(m):
    bounds = m.events.where("state is not null").select("fight_id", "frame", "event_id", F.col("k").alias("_k"))
    ends = m.rounds.select("fight_id", "round_number", F.col(E).alias("frame"), F.col("round_number").cast("long").alias("event_id"))
    t = nearest(ends, bounds, ["_k"], within=751)
    return t.select("fight_id", "round_number", F.coalesce("mark_frame", "frame").alias(E))


@query("J-13", NEAR_SQL.format("") + " SELECT event_id FROM c WHERE r = 1 AND (distance IS NULL OR distance > 500)")
def _(m):
    p = m.events.where("source = 'prediction'")
    t = nearest(m.events.where("source = 'label'").select("event_id", "fight_id", "frame"), p, ["k"])
    return t.where("distance is null or distance > 500").select("event_id")


@query("J-14", "SELECT fight_id, frame, max(CASE WHEN corner = 0 THEN value END) AS red, max(CASE WHEN corner = 1 THEN value END) AS blue FROM ev GROUP BY fight_id, frame")
def _(m):
    pick = lambda c: F.max(F.when(F.col("corner") == c, F.col("value")))
    return m.events.groupBy("fight_id", "frame").agg(pick(0).alias("red"), pick(1).alias("blue"))


@query("J-15", "SELECT fight_id, round_number, fight_id % 2 = 0 OR round_number <> 2 AS seeded FROM rounds")
def _(m):
    # labelled rounds: in fights with odd ids the second one was moved
    moved = F.when((F.col("fight_id") % 2 != 0) & (F.col("round_number") == 2), 5).otherwise(0)
    labelled = m.rounds.withColumn(S, F.col(S) + moved)
    ai = m.rounds.select("fight_id", "round_number", F.col(S).alias("_s"), F.col(E).alias("_e"))
    t = labelled.join(ai, ["fight_id", "round_number"], "left")
    return t.select("fight_id", "round_number", F.coalesce((F.col(S) == F.col("_s")) & (F.col(E) == F.col("_e")), F.lit(False)).alias("seeded"))


@query("J-16", "SELECT event_id, (SELECT min(round_number) FROM rounds r WHERE r.fight_id = ev.fight_id AND ev.frame BETWEEN r.start_frame AND r.end_frame) AS round_number FROM ev")
def _(m):
    r = m.rounds.select(F.col("fight_id").alias("_f"), S, E, "round_number")
    t = m.events.join(r, (F.col("fight_id") == F.col("_f")) & F.col("frame").between(F.col(S), F.col(E)), "left")
    return t.groupBy("event_id").agg(F.min("round_number").alias("round_number"))


@query("J-18", "SELECT fight_id FROM fights WHERE fight_id NOT IN (SELECT fight_id FROM ev WHERE k > 95)")
def _(m):
    return m.fights.join(m.events.where("k > 95").select("fight_id"), "fight_id", "left_anti").select("fight_id")


# ---------------------------------------------------------------- runs and versions


@query(
    "W-05",
    f"""x AS (SELECT fight_id, frame, event_id, {sql_lookup(STATE_MARK, "action")} AS st FROM ev WHERE source = 'label' AND {sql_lookup(STATE_MARK, "action")} IS NOT NULL),
    i AS (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY fight_id ORDER BY frame, event_id) IS NOT DISTINCT FROM st THEN 0 ELSE 1 END AS n FROM x),
    r AS (SELECT *, sum(n) OVER (PARTITION BY fight_id ORDER BY frame, event_id)::BIGINT AS run FROM i)
    SELECT fight_id, run, any_value(st) AS st, count(*) AS n, min(frame) AS first, max(frame) AS last FROM r GROUP BY fight_id, run""",
)
def _(m):
    t = m.events.where("source = 'label'").withColumn("st", lookup(STATE_MARK, "action"))
    return runs.run_lengths(t, "st", "fight_id", order=["frame", "event_id"])


@query(
    "W-06",
    """x AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) - row_number() OVER (PARTITION BY fight_id, corner ORDER BY frame, event_id) AS g FROM ev)
    SELECT fight_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM x WHERE corner = 1 GROUP BY fight_id, g HAVING count(*) >= 3""",
)
def _(m):
    return runs.flagged_runs(m.events, F.col("corner") == 1, 3, "fight_id", order=["frame", "event_id"])


@query("W-07", "x AS (SELECT fight_id, event_id, corner, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS i FROM ev) SELECT x.fight_id, x.event_id, sum(y.corner)::BIGINT AS blue FROM x JOIN x y ON y.fight_id = x.fight_id AND y.i > x.i - (3 + x.fight_id % 5) AND y.i <= x.i GROUP BY ALL")
def _(m):
    return runs.rolling_sum(m.events, "corner", (F.lit(3) + F.col("fight_id") % 5).cast("int"), "fight_id", order=["frame", "event_id"], out="blue").select("fight_id", "event_id", "blue")


@query(
    "W-08",
    """x AS (SELECT fight_id, event_id, CASE WHEN k % 4 <> 0 THEN k % 3 + 1 END AS r, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS i FROM ev),
    w AS (SELECT x.fight_id, x.event_id, y.r, count(*) AS n, min(y.i) AS first FROM x JOIN x y ON y.fight_id = x.fight_id AND y.i BETWEEN x.i - 2 AND x.i + 2 AND y.r IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS z FROM w)
    SELECT x.fight_id, x.event_id, b.r AS smoothed FROM x LEFT JOIN b ON b.event_id = x.event_id AND b.z = 1""",
)
def _(m):
    t = m.events.withColumn("r", F.when(F.col("k") % 4 != 0, F.col("k") % 3 + 1))
    return runs.rolling_mode(t, "r", 2, "fight_id", order=["frame", "event_id"], out="smoothed").select("fight_id", "event_id", "smoothed")


@query("W-04", "SELECT fight_id, event_id, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id)::INT AS number FROM ev WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) <> k % 5")
def _(m):
    t = m.events.where("state is not null").withColumn("number", F.row_number().over(Window.partitionBy("fight_id").orderBy("frame", "event_id")))
    return t.where(F.col("number") != F.col("k") % 5).select("fight_id", "event_id", "number")


RUNS_SQL = "ru AS (SELECT fight_id AS reference_id, fighter_id % 7 AS scored_id, frame AS generated_at, event_id AS run_id, k / 100 AS f1, k % 2 AS tol FROM ev WHERE source = 'prediction')"


def eval_runs(m) -> DataFrame:
    """A log of scorings: reference_id, scored_id, generated_at, run_id, f1, tol."""
    e = m.events.where("source = 'prediction'")
    return e.select(F.col("fight_id").alias("reference_id"), (F.col("fighter_id") % 7).alias("scored_id"), F.col("frame").alias("generated_at"), F.col("event_id").alias("run_id"), (F.col("k") / 100).alias("f1"), (F.col("k") % 2).alias("tol"))


def latest_versions(runs_: DataFrame) -> DataFrame:
    """The latest scoring of each scored fight, with its dense version number."""
    w = Window.partitionBy("reference_id", "scored_id").orderBy(F.desc("generated_at"), F.desc("run_id"))
    t = runs_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return t.withColumn("version", F.dense_rank().over(Window.partitionBy("reference_id").orderBy("scored_id")))


LATEST_SQL = RUNS_SQL + ", la AS (SELECT *, dense_rank() OVER (PARTITION BY reference_id ORDER BY scored_id)::INT AS version FROM (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY reference_id, scored_id ORDER BY generated_at DESC, run_id DESC) = 1))"


@query("W-03", LATEST_SQL + " SELECT reference_id, scored_id, run_id, version FROM la")
def _(m):
    return latest_versions(eval_runs(m)).select("reference_id", "scored_id", "run_id", "version")


@query("A-23", RUNS_SQL + " SELECT run_id, dense_rank() OVER (PARTITION BY reference_id ORDER BY scored_id)::INT AS version FROM ru")
def _(m):
    return eval_runs(m).select("run_id", F.dense_rank().over(Window.partitionBy("reference_id").orderBy("scored_id")).alias("version"))


@query("W-02", LATEST_SQL + " SELECT reference_id, version, run_id, lag(run_id) OVER (PARTITION BY reference_id ORDER BY version) AS previous FROM la")
def _(m):
    return latest_versions(eval_runs(m)).select("reference_id", "version", "run_id", F.lag("run_id").over(Window.partitionBy("reference_id").orderBy("version")).alias("previous"))


@query("A-43", LATEST_SQL + " SELECT reference_id, version, round(f1 - lag(f1) OVER w, 6) AS delta, coalesce(tol = lag(tol) OVER w, false) AS comparable FROM la WINDOW w AS (PARTITION BY reference_id ORDER BY version)")
def _(m):
    w = Window.partitionBy("reference_id").orderBy("version")
    t = latest_versions(eval_runs(m))
    return t.select("reference_id", "version", F.round(F.col("f1") - F.lag("f1").over(w), 6).alias("delta"), F.coalesce(F.col("tol") == F.lag("tol").over(w), F.lit(False)).alias("comparable"))


@query("W-16", LATEST_SQL + " SELECT reference_id, version, coalesce(tol <> lag(tol) OVER (PARTITION BY reference_id ORDER BY version), false) AS changed FROM la")
def _(m):
    w = Window.partitionBy("reference_id").orderBy("version")
    return latest_versions(eval_runs(m)).select("reference_id", "version", F.coalesce(F.col("tol") != F.lag("tol").over(w), F.lit(False)).alias("changed"))


@query("S-28", RUNS_SQL + " SELECT reference_id, scored_id, run_id, generated_at FROM ru WHERE scored_id = 3")
def _(m):
    return eval_runs(m).where("scored_id = 3").orderBy("reference_id", "generated_at", "run_id").select("reference_id", "scored_id", "run_id", "generated_at")


@query("W-15", "SELECT e.event_id, count(o.event_id) AS inside FROM ev e LEFT JOIN ev o ON o.fight_id = e.fight_id AND o.frame BETWEEN greatest(1, e.frame - 75) AND e.frame + 75 WHERE e.source = 'label' GROUP BY e.event_id")
def _(m):
    clips = m.events.where("source = 'label'").select("fight_id", "event_id", F.greatest(F.lit(1), F.col("frame") - 75).alias(S), (F.col("frame") + 75).alias(E))
    t = intervals.banded(m.events.select("fight_id", "frame", F.col("event_id").alias("_o")), clips, 512, extra=["event_id"])
    return t.groupBy("event_id").agg(F.count("_o").alias("inside"))


# ---------------------------------------------------------------- injected swaps


def swap_recall(injected: DataFrame, swaps: DataFrame) -> DataFrame:
    """For each injected window of a fight the labelled swap that overlaps it most
    (ties: the earlier entry), if any does, and how far its edges are off."""
    s = swaps.select("fight_id", F.col("event_id").alias("_id"), F.col(S).alias("_s"), F.col(E).alias("_e"))
    t = injected.join(s, "fight_id").withColumn("_n", F.least("_e", E) - F.greatest("_s", S) + 1).where("_n > 0")
    best = F.max(F.struct("_n", -F.col("_id"), "_s", "_e")).alias("_best")
    t = injected.join(t.groupBy("fight_id", S, E).agg(best), ["fight_id", S, E], "left")
    b = F.col("_best")
    return t.select("fight_id", S, E, b.isNotNull().alias("detected"), (b["_s"] - F.col(S)).alias("start_error"), (b["_e"] - F.col(E)).alias("end_error"))


@query(
    "M-21",
    f"""ij AS (SELECT fight_id, 9000 + fight_id % 50 * 300 AS {S}, 12000 + fight_id % 50 * 350 AS {E} FROM fights),
    bo AS (SELECT ij.*, w.{S} AS s, w.{E} AS e, least(w.{E}, ij.{E}) - greatest(w.{S}, ij.{S}) + 1 AS n, event_id FROM ij LEFT JOIN swaps w ON w.fight_id = ij.fight_id AND w.{E} >= ij.{S} AND w.{S} <= ij.{E})
    SELECT fight_id, {S}, {E}, s IS NOT NULL AS detected, s - {S} AS start_error, e - {E} AS end_error FROM bo QUALIFY row_number() OVER (PARTITION BY fight_id ORDER BY n DESC, event_id) = 1""",
)
def _(m):
    at = F.col("fight_id") % 50
    injected = m.fights.select("fight_id", (at * 300 + 9000).alias(S), (at * 350 + 12000).alias(E))
    return swap_recall(injected, m.swaps)


def changed_rules(versions: DataFrame) -> DataFrame:
    """Add ``changed``: whether a version was scored with another tolerance, or by other
    constants, than the one before it; without a hash on either side the constants
    count as the same."""
    w = Window.partitionBy("reference_id").orderBy("version")
    differs = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))
    return versions.withColumns({"tolerance_changed": differs("tol"), "constants_changed": differs("constants")})


@query(
    "W-16-constants",
    LATEST_SQL + ", lc AS (SELECT *, CASE WHEN run_id % 6 > 0 THEN 'c' || run_id % 3 END AS constants FROM la) SELECT reference_id, version, coalesce(tol <> lag(tol) OVER w, false) AS tolerance_changed, coalesce(constants <> lag(constants) OVER w, false) AS constants_changed FROM lc WINDOW w AS (PARTITION BY reference_id ORDER BY version)",
)
def _(m):
    constants = F.when(F.col("run_id") % 6 > 0, F.concat(F.lit("c"), (F.col("run_id") % 3).cast("string")))
    return changed_rules(latest_versions(eval_runs(m)).withColumn("constants", constants)).select("reference_id", "version", "tolerance_changed", "constants_changed")


@query("A-33-best", LATEST_SQL + " SELECT reference_id, version, f1 FROM la QUALIFY row_number() OVER (ORDER BY f1 DESC, reference_id, version) = 1")
def _(m):
    """The best measurable fixture: the latest scoring with the highest F1 (ties: first)."""
    best = F.max_by(F.struct("reference_id", "version", "f1"), F.struct("f1", -F.col("reference_id"), -F.col("version")))
    return latest_versions(eval_runs(m)).agg(best.alias("_b")).select("_b.*")


@query(
    "A-21-scored",
    IN_ROUND_SQL
    + f""", sf AS (SELECT fight_id, count(*) AS frames FROM inr i WHERE NOT EXISTS (FROM excluded x WHERE x.fight_id = i.fight_id AND i.frame BETWEEN x.start_frame AND x.end_frame) GROUP BY fight_id), sx AS (SELECT fight_id, count(*) AS n FROM excluded GROUP BY fight_id),
    sl AS (SELECT fight_id, count(*) FILTER (WHERE starts_with(action, 'state_')) AS states, count(*) FILTER (WHERE action = 'takedown_landed') AS takedowns FROM ev WHERE source = 'label' GROUP BY fight_id)
    SELECT f.fight_id, round(coalesce(frames, 0) / {FPS} / 60, 6) AS minutes, (SELECT count(*) FROM rounds r WHERE r.fight_id = f.fight_id) AS rounds, coalesce(states, 0) AS state_spans, coalesce(sx.n, 0) AS excluded, coalesce(takedowns, 0) AS takedowns FROM fights f LEFT JOIN sf USING (fight_id) LEFT JOIN sx USING (fight_id) LEFT JOIN sl USING (fight_id)""",
)
def _(m):
    """Minutes that count and the numbers of spans, of every fight."""
    frames = intervals.scored_spans(m.rounds, m.excluded, "fight_id").groupBy("fight_id").agg(F.sum(F.col(E) - F.col(S) + 1).alias("frames"))
    marks = m.events.where("source = 'label'").groupBy("fight_id").agg(F.count_if(F.col("action").startswith("state_")).alias("state_spans"), F.count_if(F.col("action") == "takedown_landed").alias("takedowns"))
    t = m.fights.select("fight_id")
    for part in (frames, m.rounds.groupBy("fight_id").agg(F.count(F.lit(1)).alias("rounds")), m.excluded.groupBy("fight_id").agg(F.count(F.lit(1)).alias("excluded")), marks):
        t = t.join(part, "fight_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return t.select("fight_id", F.round(F.coalesce("frames", F.lit(0)) / FPS / 60, 6).alias("minutes"), *map(n, ("rounds", "state_spans", "excluded", "takedowns")))
