"""Machines that turn frames into fights, states, tracks and corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import geometry, readings
from spanframe.functions.vocabulary import LABEL_FAMILY, lookup, sql_lookup
from spanframe.operators import corners, hysteresis, runs, segmentation, selection, tracks, training
from spanframe.operators.segmentation import BLOCK, Rules, number_rows
from spanframe.plans.registry import query

RULES = Rules()

# ---------------------------------------------------------------- fights and rounds

# an event is a frame of a slow camera; in every other quarter of a fight little is seen
FRAMES_SQL = """sg0 AS (SELECT fight_id, frame, event_id, k, frame // 10800 % 2 = 1 AS low, CASE WHEN fight_id % 2 = 1 THEN 0.4 ELSE 0.8 END::DOUBLE AS fps FROM ev),
    sg AS (SELECT fight_id, frame, event_id, fps, CASE WHEN low OR k % 5 = 0 THEN (NOT low OR k % 9 = 0)::INT * 2 / 3 + (k % 4 > 0)::INT / 3 ELSE 0.7 * CASE WHEN k % 11 = 0 THEN 0 ELSE 0.9 END + 0.2 * (NOT low OR k % 9 = 0)::INT + 0.1 * (k % 4 > 0)::INT END >= 0.5 AS hit FROM sg0)"""


def seen_frames(events: DataFrame, *more: str) -> DataFrame:
    """fight_id, frame, event_id, fps, hit of events with fight_id, frame, event_id, k."""
    low, k = F.floor(F.col("frame") / 10800) % 2 == 1, F.col("k")
    signal = F.when(low | (k % 5 == 0), -1.0).when(k % 11 == 0, 0.0).otherwise(0.9)
    prob = readings.fused(signal, ~low | (k % 9 == 0), k % 4 > 0)
    return events.select("fight_id", "frame", "event_id", F.when(F.col("fight_id") % 2 == 1, 0.4).otherwise(0.8).alias("fps"), (prob >= 0.5).alias("hit"), *more)


def rounds(m) -> DataFrame:
    return segmentation.segment(seen_frames(m.events), RULES, order=("frame", "event_id"))


SEGMENT_SQL = (
    FRAMES_SQL
    + f""", sx AS (SELECT *, floor({RULES.presence} * fps)::INT AS w1, floor({RULES.fight_gap} * fps)::INT AS g1, floor({RULES.engagement} * fps)::INT AS w2, floor({RULES.round_gap} * fps)::INT AS g2,
        row_number() OVER w AS i, sum(hit::INT) OVER w AS p FROM sg WINDOW w AS (PARTITION BY fight_id ORDER BY frame, event_id)),
    sp AS (SELECT fight_id, list(p ORDER BY i) AS ps, max(frame) AS last_frame, any_value(fps) AS fps FROM sx GROUP BY fight_id),
    sr AS (SELECT * FROM (WITH RECURSIVE acc AS (
        SELECT fight_id, 0::BIGINT AS i, false AS fight, 0::BIGINT AS ei, NULL::BIGINT AS fc, 0 AS fk, NULL::BIGINT AS rs, NULL::BIGINT AS rc, 0 AS rk, NULL::BIGINT AS s, NULL::BIGINT AS e FROM sp
        UNION ALL
        SELECT fight_id, i, inside, ei, CASE WHEN inside THEN fc END, CASE WHEN inside THEN fk ELSE 0 END,
               CASE WHEN NOT inside OR gone THEN NULL WHEN rs IS NULL AND back THEN frame - w2 + 1 ELSE rs END,
               CASE WHEN inside AND NOT gone AND low2 THEN coalesce(rc, frame) END, CASE WHEN inside AND NOT gone AND low2 THEN rk + 1 ELSE 0 END,
               CASE WHEN leaving OR gone THEN rs END, CASE WHEN leaving THEN fc WHEN gone THEN coalesce(rc, frame) END
        FROM (SELECT *, inside AND rs IS NOT NULL AND eng <= {RULES.disengaged} AS low2, inside AND rs IS NOT NULL AND eng <= {RULES.disengaged} AND rk + 1 >= g2 AS gone, inside AND i - ei + 1 >= w2 AND eng >= {RULES.engaged} AS back
            FROM (SELECT *, (p - CASE WHEN greatest(ei - 1, i - w2) > 0 THEN ps[greatest(ei - 1, i - w2)] ELSE 0 END) / least(i - ei + 1, w2) AS eng
                FROM (SELECT * REPLACE (CASE WHEN entering THEN i ELSE ei END AS ei, CASE WHEN entering THEN frame - w1 + 1 ELSE rs END AS rs), fight AND fk >= g1 AS leaving, entering OR (fight AND fk < g1) AS inside
                    FROM (SELECT *, NOT fight AND i >= w1 AND pres >= {RULES.enter} AS entering
                        FROM (SELECT * REPLACE (CASE WHEN fight AND pres <= {RULES.leave} THEN coalesce(fc, frame) END AS fc, CASE WHEN fight AND pres <= {RULES.leave} THEN fk + 1 ELSE 0 END AS fk)
                            FROM (SELECT x.fight_id, x.i, x.frame, x.p, x.w1, x.g1, x.w2, x.g2, ps, fight, ei, fc, fk, rs, rc, rk, (x.p - CASE WHEN x.i > x.w1 THEN ps[x.i - x.w1] ELSE 0 END) / least(x.i, x.w1) AS pres
                                FROM acc a JOIN sx x ON x.fight_id = a.fight_id AND x.i = a.i + 1 JOIN sp ON sp.fight_id = a.fight_id))))))
        ) SELECT * FROM acc)),
    se AS (SELECT fight_id, s, e FROM sr WHERE s IS NOT NULL UNION ALL SELECT fight_id, arg_max(CASE WHEN fight THEN coalesce(rs, -1) ELSE -1 END, i), any_value(last_frame) FROM sr JOIN sp USING (fight_id) GROUP BY fight_id)
    SELECT fight_id, s AS start_frame, e AS end_frame FROM se JOIN sp USING (fight_id) WHERE s <> -1 AND e >= s AND e - s + 1 >= floor({RULES.shortest} * fps)"""
)


@query("M-06", SEGMENT_SQL)
def _(m):
    return rounds(m)


# ---------------------------------------------------------------- states

STATE_ROWS_SQL = f"""mv0 AS (SELECT fight_id, frame, event_id, k, frame // 4000 % 3 AS phase, 10 + fight_id % 3 * 6 AS fps, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS pos FROM ev),
    mv1 AS (SELECT *, CASE WHEN k % 6 > 0 THEN CASE WHEN (phase = 0) = (k % 8 > 0) THEN 20 + k % 5 ELSE k % 5 END END AS distance, 60 + k % 11 AS sa, CASE WHEN k % 13 > 0 THEN 55 + event_id % 9 END AS sb, (phase = 2) = (k % 5 > 0) AS grounded FROM mv0),
    mv AS (SELECT *, CASE WHEN distance >= {hysteresis.GRAPPLING_RATIO} * (sa + sb) / 2 THEN 'STRIKING' WHEN distance < {hysteresis.GRAPPLING_RATIO} * (sa + sb) / 2 THEN CASE WHEN grounded THEN 'GROUND' ELSE 'CLINCH' END END AS v,
        greatest(1, round_even(fps * {hysteresis.VOTE_SECONDS}, 0)::INT) AS width, greatest(1, round_even(fps * {hysteresis.DWELL_SECONDS}, 0)::INT) AS dwell FROM mv1)"""


def state_rows(m) -> DataFrame:
    """One row an event: fight_id, frame, at, v (what it speaks for), width, dwell."""
    k, phase, fps = F.col("k"), F.floor(F.col("frame") / 4000) % 3, F.col("fps")
    t = number_rows(m.events.select("fight_id", "frame", "event_id", "k"), "fight_id", order=["frame", "event_id"], block=BLOCK, out="at").withColumn("fps", F.lit(10) + F.col("fight_id") % 3 * 6)
    distance = F.when(k % 6 > 0, F.when((phase == 0) == (k % 8 > 0), 20 + k % 5).otherwise(k % 5))
    v = hysteresis.fight_state(distance, 60 + k % 11, F.when(k % 13 > 0, 55 + F.col("event_id") % 9), (phase == 2) == (k % 5 > 0))
    frames = lambda seconds: F.greatest(F.lit(1), F.bround(fps * seconds).cast("int"))
    return t.select("fight_id", "frame", "at", v.alias("v"), frames(F.lit(hysteresis.VOTE_SECONDS)).alias("width"), frames(F.lit(hysteresis.DWELL_SECONDS)).alias("dwell"))


@query(
    "M-05",
    STATE_ROWS_SQL
    + """, mn AS (SELECT *, row_number() OVER w AS n, list(v) OVER w AS vs FROM mv WHERE v IS NOT NULL WINDOW w AS (PARTITION BY fight_id ORDER BY pos)),
    mw AS (SELECT fight_id, pos, vs[greatest(n - width + 1, 1):n] AS vs FROM mn),
    mt AS (SELECT fight_id, pos, list_sort([{'n': -len(list_filter(vs, lambda x: x = s)), 'p': list_position(vs, s), 's': s} FOR s IN ['STRIKING', 'CLINCH', 'GROUND']])[1].s AS vote FROM mw),
    ms AS (SELECT mv.fight_id, mv.pos, frame, dwell, last_value(vote IGNORE NULLS) OVER (PARTITION BY mv.fight_id ORDER BY mv.pos) AS target FROM mv LEFT JOIN mt USING (fight_id, pos))
    SELECT fight_id, frame, state FROM (WITH RECURSIVE acc AS (
        SELECT DISTINCT fight_id, 0::BIGINT AS pos, 0::BIGINT AS frame, 'STRIKING' AS state, 1000000 AS since, false AS turned FROM ms
        UNION ALL
        SELECT s.fight_id, s.pos, s.frame, CASE WHEN target <> state AND since + 1 >= dwell THEN target ELSE state END, CASE WHEN target <> state AND since + 1 >= dwell THEN 0 ELSE since + 1 END, coalesce(target <> state AND since + 1 >= dwell, false)
        FROM acc a JOIN ms s ON s.fight_id = a.fight_id AND s.pos = a.pos + 1
    ) SELECT * FROM acc) WHERE turned""",
)
def _(m):
    rows = state_rows(m)
    found = hysteresis.settled(rows, "fight_id", "at", "v", "width", "dwell", "STRIKING")
    return found.join(rows.select("fight_id", "at", "frame"), ["fight_id", "at"]).select("fight_id", "frame", "state")


# ---------------------------------------------------------------- corners

SLOTS_SQL = """sl0 AS (SELECT fight_id, frame // 1200 AS frame, corner AS slot, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM ev GROUP BY ALL),
    sl AS (SELECT *, CASE WHEN fight_id % 4 = 0 THEN k % 13 WHEN (fight_id + slot) % 2 = 0 THEN k % 13 - 4 ELSE 4 - k % 11 END / 20 AS net_red, k % 17 AS tape,
        CASE WHEN k % 10 > 0 THEN [k % 5, (k + slot * 2) % 7, slot * 3 + event_id % 3, 1]::DOUBLE[] END AS hist, CASE WHEN k % 12 > 0 THEN k * 2 ELSE 0 END AS weight FROM sl0)"""


def slots(m) -> DataFrame:
    """What is seen of each slot in a frame: fight_id, frame, slot, event_id, net_red, tape, hist, weight."""
    t = m.events.groupBy("fight_id", F.floor(F.col("frame") / 1200).alias("frame"), F.col("corner").alias("slot")).agg(F.max("event_id").alias("event_id"), F.max_by("k", "event_id").alias("k"))
    k, slot = F.col("k"), F.col("slot")
    red = F.when(F.col("fight_id") % 4 == 0, k % 13).when((F.col("fight_id") + slot) % 2 == 0, k % 13 - 4).otherwise(4 - k % 11) / 20
    hist = F.when(k % 10 > 0, F.array(*(c.cast("double") for c in (k % 5, (k + slot * 2) % 7, slot * 3 + F.col("event_id") % 3, F.lit(1)))))
    return t.select("fight_id", "frame", "slot", "event_id", red.alias("net_red"), (k % 17).alias("tape"), hist.alias("hist"), F.when(k % 12 > 0, k * 2).otherwise(0).alias("weight"))


def slot_pairs(seen: DataFrame) -> DataFrame:
    """One row a frame: each slot's columns with _0 and _1, null where it is not seen."""
    of = lambda s, c: F.max_by(c, F.when(F.col("slot") == s, 1)).alias(f"{c}_{s}")
    return seen.groupBy("fight_id", "frame").agg(*(of(s, c) for s in (0, 1) for c in ("event_id", "net_red", "tape", "hist", "weight")))


@query(
    "A-36",
    SLOTS_SQL
    + f""", vp AS (SELECT a.fight_id, a.net_red - b.net_red AS d FROM sl a JOIN sl b ON b.fight_id = a.fight_id AND b.frame = a.frame AND a.slot = 0 AND b.slot = 1),
    vv AS (SELECT fight_id, count(*) FILTER (WHERE d > 0 AND abs(d) >= {corners.VOTE_MARGIN}) AS votes_0, count(*) FILTER (WHERE d < 0 AND abs(d) >= {corners.VOTE_MARGIN}) AS votes_1 FROM fights LEFT JOIN vp USING (fight_id) GROUP BY fight_id)
    SELECT *, votes_0 + votes_1 >= 10 AS decided, CASE WHEN votes_0 + votes_1 >= 10 AND votes_0 < votes_1 THEN 1 ELSE 0 END AS corner_0 FROM vv""",
)
def _(m):
    return corners.tape_votes(slot_pairs(slots(m)), least=10)


TEMPLATES_SQL = (
    SLOTS_SQL
    + f""", tm AS (SELECT fight_id, slot, avg(net_red) AS r FROM sl GROUP BY ALL), tb AS (SELECT fight_id, slot, b, sum(hist[b] * weight) / sum(weight) AS v FROM sl, range(1, 5) t(b) WHERE hist IS NOT NULL AND weight > 0 GROUP BY ALL),
    th AS (SELECT fight_id, slot, list(v ORDER BY b) AS h FROM tb GROUP BY ALL), tn AS (SELECT fight_id, slot, CASE WHEN list_sum(h) > 0 THEN list_transform(h, lambda x: x / list_sum(h)) ELSE h END AS h FROM th),
    tw AS (SELECT f.fight_id, a.r AS r0, b.r AS r1, x.h AS h0, y.h AS h1 FROM fights f LEFT JOIN tm a ON a.fight_id = f.fight_id AND a.slot = 0 LEFT JOIN tm b ON b.fight_id = f.fight_id AND b.slot = 1 LEFT JOIN tn x ON x.fight_id = f.fight_id AND x.slot = 0 LEFT JOIN tn y ON y.fight_id = f.fight_id AND y.slot = 1),
    tg AS (SELECT *, 0.5 * least(1, abs(r0 - r1) / {corners.FULL_GAP}) + 0.5 * coalesce(sqrt(greatest(0, 1 - list_sum([sqrt(h0[i] * h1[i]) FOR i IN range(1, 5)]) / sqrt(list_sum(h0) * list_sum(h1)))), 0) AS separation FROM tw),
    tp AS (SELECT *, CASE WHEN r0 >= 0 THEN 0 ELSE 1 END AS corner_0, CASE WHEN r0 IS NULL THEN '{corners.NO_FRAMES % 0}' WHEN r1 IS NULL THEN '{corners.NO_FRAMES % 1}' WHEN r0 >= 0 AND r1 >= 0 THEN '{corners.AMBIGUOUS % "red"}' WHEN r0 < 0 AND r1 < 0 THEN '{corners.AMBIGUOUS % "blue"}'
        WHEN separation < {corners.MIN_SEPARATION} THEN printf('{corners.LOW_SEPARATION}', separation, {corners.MIN_SEPARATION}::DOUBLE) END AS reason FROM tg)"""
)


@query("A-37", TEMPLATES_SQL + " SELECT fight_id, round(separation, 6) AS separation, corner_0, reason, [round(x, 6) FOR x IN h0] AS hist_0, [round(x, 6) FOR x IN h1] AS hist_1 FROM tp")
def _(m):
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return corners.templates(slots(m), m.fights).select("fight_id", F.round("separation", 6).alias("separation"), "corner_0", "reason", rounded("hist_0"), rounded("hist_1"))


_TAPE = "CASE WHEN (s.net_red >= 0) = (c = 0) THEN 0.5 - 0.5 * least(s.tape, 8) / 8 ELSE 0.5 + 0.5 * least(s.tape, 8) / 8 END"
_KIT = "CASE WHEN s.hist IS NULL OR th IS NULL THEN 0.5 ELSE 0.5 + (least(1, sqrt(greatest(0, 1 - list_sum([sqrt(s.hist[i] * th[i]) FOR i IN range(1, 5)]) / sqrt(list_sum(s.hist) * list_sum(th))))) - 0.5) * least(s.weight, 150) / 150 END"


@query(
    "M-07",
    TEMPLATES_SQL
    + f""", ct AS (SELECT fight_id, c, CASE WHEN c = corner_0 THEN h0 ELSE h1 END AS th FROM tp, range(2) t(c) WHERE reason IS NULL),
    cc AS (SELECT s.fight_id, s.frame, s.slot, s.event_id, c, {corners.TAPE_WEIGHT} * {_TAPE} + {corners.KIT_WEIGHT} * {_KIT} AS cost FROM sl s JOIN ct ON ct.fight_id = s.fight_id),
    cf AS (SELECT fight_id, frame, arg_min(slot, event_id) AS first, max(cost) FILTER (WHERE slot = 0 AND c = 0) AS c00, max(cost) FILTER (WHERE slot = 0 AND c = 1) AS c01, max(cost) FILTER (WHERE slot = 1 AND c = 0) AS c10, max(cost) FILTER (WHERE slot = 1 AND c = 1) AS c11 FROM cc GROUP BY ALL),
    cs AS (SELECT fight_id, frame, 1 + fight_id % 3 AS need, row_number() OVER (PARTITION BY fight_id ORDER BY frame) AS i, CASE WHEN c00 IS NULL OR c10 IS NULL THEN c00 IS NOT NULL ELSE first = 0 END AS tie, CASE WHEN c00 IS NOT NULL AND c10 IS NOT NULL THEN 2 * {corners.TURN_COST} ELSE {corners.TURN_COST} END AS cost,
        CASE WHEN c10 IS NULL THEN c01 - c00 WHEN c00 IS NULL THEN c10 - c11 ELSE (c01 + c10) - (c00 + c11) END AS saved FROM cf)
    SELECT fight_id, frame, swapped FROM (WITH RECURSIVE acc AS (
        SELECT DISTINCT fight_id, 0::BIGINT AS i, 0::BIGINT AS frame, false AS swapped, 0 AS n, false AS turned FROM cs
        UNION ALL
        SELECT fight_id, i, frame, swapped <> (n + 1 >= need AND flips), CASE WHEN flips AND n + 1 < need THEN n + 1 ELSE 0 END, flips AND n + 1 >= need FROM (
            SELECT s.*, a.swapped, a.n, CASE WHEN a.swapped THEN saved - cost > 0 OR (saved - cost = 0 AND tie) ELSE NOT (saved + cost > 0 OR (saved + cost = 0 AND tie)) END AS flips
            FROM acc a JOIN cs s ON s.fight_id = a.fight_id AND s.i = a.i + 1)
    ) SELECT * FROM acc) WHERE turned""",
)
def _(m):
    seen = slots(m)
    kit = corners.templates(seen, m.fights).where("reason is null").select("fight_id", F.when(F.col("corner_0") == 0, F.col("hist_0")).otherwise(F.col("hist_1")).alias("red_kit"), F.when(F.col("corner_0") == 0, F.col("hist_1")).otherwise(F.col("hist_0")).alias("blue_kit"))
    t = slot_pairs(seen).join(kit, "fight_id")
    c = F.col
    cost = lambda s, sign, k: F.when(c(f"event_id_{s}").isNotNull(), corners.label_cost(c(f"net_red_{s}"), c(f"tape_{s}"), c(f"hist_{s}"), c(f"weight_{s}"), F.lit(sign), c(k)))
    first = F.when(c("event_id_0") < c("event_id_1"), 0).when(c("event_id_1").isNull(), 0).otherwise(1)
    frames = t.select("fight_id", "frame", (c("fight_id") % 3 + 1).alias("need"), first.alias("first"), *(cost(s, sign, k).alias(f"c{s}{n}") for s in (0, 1) for n, sign, k in ((0, 1, "red_kit"), (1, -1, "blue_kit"))))
    return corners.turns(frames)


# ---------------------------------------------------------------- tracks

TRACK_FPS = 10
WAIT = max(1, round(TRACK_FPS * tracks.LOST_SECONDS))
DETECTIONS_SQL = """dt0 AS (SELECT fight_id, frame // 300 AS frame, corner, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM ev GROUP BY ALL),
    dt AS (SELECT fight_id, frame, (row_number() OVER (PARTITION BY fight_id, frame ORDER BY event_id) - 1)::INT AS no, [60 * corner + frame * 3 % 40 + k % 5, k % 7, 60 * corner + frame * 3 % 40 + k % 5 + 30 + k % 4, k % 7 + 60]::DOUBLE[] AS b FROM dt0)"""


def detections(m) -> DataFrame:
    """Boxes of up to two people a frame: fight_id, frame, no, x1, y1, x2, y2, fps."""
    t = m.events.groupBy("fight_id", F.floor(F.col("frame") / 300).alias("frame"), "corner").agg(F.max("event_id").alias("event_id"), F.max_by("k", "event_id").alias("k"))
    no = (F.row_number().over(Window.partitionBy("fight_id", "frame").orderBy("event_id")) - 1).alias("no")
    x, k = F.col("corner") * 60 + F.col("frame") * 3 % 40 + F.col("k") % 5, F.col("k")
    box = {"x1": x, "y1": k % 7, "x2": x + 30 + k % 4, "y2": k % 7 + 60}
    return t.select("fight_id", "frame", no, *(c.cast("double").alias(n) for n, c in box.items()), F.lit(TRACK_FPS).alias("fps"))


def _overlap_sql(a: str, b: str) -> str:
    common = f"greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2]))"
    return f"({common}) / (({a}[3] - {a}[1]) * ({a}[4] - {a}[2]) + ({b}[3] - {b}[1]) * ({b}[4] - {b}[2]) - {common})"


def _cost_sql(ahead: str, seen: str) -> str:
    far = f"sqrt((({ahead}[1] + {ahead}[3]) / 2 - ({seen}[1] + {seen}[3]) / 2) ** 2 + (({ahead}[2] + {ahead}[4]) / 2 - ({seen}[2] + {seen}[4]) / 2) ** 2)"
    size = f"greatest(1, sqrt(({seen}[3] - {seen}[1]) ** 2 + ({seen}[4] - {seen}[2]) ** 2))"
    return f"{tracks.OVERLAP_WEIGHT} * (1 - {_overlap_sql(ahead, seen)}) + {tracks.DISTANCE_WEIGHT} * {far} / {size}"


def _moved_sql(p: str, n: str) -> str:
    return f"[{p}[1] + {n} * {p}[5], {p}[2] + {n} * {p}[6], {p}[3] + {n} * {p}[5], {p}[4] + {n} * {p}[6], {p}[5], {p}[6], {p}[7] + {n}]"


def _kept_sql(p: str, seen: str) -> str:
    lost = f"CASE WHEN {p}[7] + 1 <= {WAIT} THEN {_moved_sql(p, '1')} END"
    centre = lambda b, i: f"({b}[{i}] + {b}[{i + 2}]) / 2"
    speed = ", ".join(f"CASE WHEN {p} IS NULL THEN 0 WHEN frozen THEN {p}[{i + 4}] ELSE {centre(seen, i)} - {centre(p, i)} END" for i in (1, 2))
    return f"CASE WHEN {seen} IS NULL THEN {lost} ELSE [{seen}[1], {seen}[2], {seen}[3], {seen}[4], {speed}, 0] END"


@query(
    "M-03",
    DETECTIONS_SQL
    + f""", tf0 AS (SELECT fight_id, frame, max(b) FILTER (WHERE no = 0) AS d0, max(b) FILTER (WHERE no = 1) AS d1 FROM dt GROUP BY ALL), tf AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY frame) AS i FROM tf0),
    ta AS (SELECT * FROM (WITH RECURSIVE acc AS (
        SELECT DISTINCT fight_id, 0::BIGINT AS i, NULL::BIGINT AS frame, NULL::DOUBLE[] AS a, NULL::DOUBLE[] AS b, NULL::INT AS s0, NULL::INT AS s1 FROM tf
        UNION ALL
        SELECT fight_id, i, frame, {_kept_sql("a", "da")}, {_kept_sql("b", "db")}, s0, CASE WHEN d1 IS NOT NULL THEN 1 - s0 END FROM (
            SELECT *, CASE WHEN s0 = 0 THEN d0 ELSE d1 END AS da, CASE WHEN s0 = 1 THEN d0 ELSE d1 END AS db, coalesce({_overlap_sql("d0", "d1")} > {tracks.TANGLED}, false) AS frozen FROM (
            SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN d1 IS NULL THEN CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN 1 WHEN ca0 <= cb0 THEN 0 ELSE 1 END
                WHEN b IS NULL THEN CASE WHEN ca0 <= ca1 THEN 0 ELSE 1 END WHEN a IS NULL THEN CASE WHEN cb0 <= cb1 THEN 1 ELSE 0 END WHEN ca0 + cb1 <= ca1 + cb0 THEN 0 ELSE 1 END AS s0 FROM (
            SELECT *, {_cost_sql("ea", "d0")} AS ca0, {_cost_sql("ea", "d1")} AS ca1, {_cost_sql("eb", "d0")} AS cb0, {_cost_sql("eb", "d1")} AS cb1 FROM (
            SELECT *, {_moved_sql("a", "1")} AS ea, {_moved_sql("b", "1")} AS eb FROM (
            SELECT f.fight_id, f.i, f.frame, f.d0, f.d1, CASE WHEN x.a[7] + f.frame - x.frame - 1 <= {WAIT} THEN {_moved_sql("x.a", "(f.frame - x.frame - 1)")} END AS a, CASE WHEN x.b[7] + f.frame - x.frame - 1 <= {WAIT} THEN {_moved_sql("x.b", "(f.frame - x.frame - 1)")} END AS b
            FROM acc x JOIN tf f ON f.fight_id = x.fight_id AND f.i = x.i + 1)))))
    ) SELECT * FROM acc WHERE i > 0))
    SELECT fight_id, frame, 0 AS no, s0 AS slot FROM ta UNION ALL SELECT fight_id, frame, 1, s1 FROM ta WHERE s1 IS NOT NULL""",
)
def _(m):
    return tracks.track(detections(m), "fight_id")


BOXES_SQL = """bx0 AS (SELECT fight_id, corner, frame // 300 AS frame, max(event_id) AS event_id, arg_max(k, event_id) AS k FROM ev GROUP BY ALL),
    bx1 AS (SELECT *, frame * 2 + k % 7 + CASE WHEN k % 19 = 0 THEN 60 ELSE 0 END AS cx, 100 + frame % 11 + k % 3 AS cy, 40 + k % 5 AS w, 80 + k % 9 AS h FROM bx0),
    bx AS (SELECT *, CASE WHEN k % 4 > 0 THEN [[cx - 15 + i * 13 % 31, cy - 35 + i * 17 % 71, (2 + (k + i) % 7) / 10] FOR i IN range(17)]::DOUBLE[][] END AS p FROM bx1)"""


def people(m) -> DataFrame:
    """Boxes and skeletons: fight_id, corner, frame, box, skeleton."""
    t = m.events.groupBy("fight_id", "corner", F.floor(F.col("frame") / 300).alias("frame")).agg(F.max_by("k", "event_id").alias("k"))
    k, f = F.col("k"), F.col("frame")
    t = t.withColumns({"cx": f * 2 + k % 7 + F.when(k % 19 == 0, 60).otherwise(0), "cy": f % 11 + k % 3 + 100, "w": k % 5 + 40, "h": k % 9 + 80})
    joint = lambda i: F.array((F.col("cx") - 15 + i * 13 % 31).cast("double"), (F.col("cy") - 35 + i * 17 % 71).cast("double"), (2 + (k + i) % 7) / 10)
    cornered = geometry.cornered(F.struct(*(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h"))))
    return t.select("fight_id", "corner", "frame", cornered.alias("box"), F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), F.lit(16)), joint)).alias("skeleton"))


SMOOTH_FPS = 50.0
_MEDIAN, _FIT = tracks.odd_frames(tracks.MEDIAN_SECONDS, SMOOTH_FPS), tracks.odd_frames(tracks.FIT_SECONDS, SMOOTH_FPS)
_GAP = max(1, round(SMOOTH_FPS * tracks.GAP_SECONDS))


@query(
    "M-13",
    BOXES_SQL
    + f""", bs0 AS (SELECT *, coalesce(frame - lag(frame) OVER w > {_GAP}, true) AS new FROM bx WINDOW w AS (PARTITION BY fight_id, corner ORDER BY frame)),
    bs1 AS (SELECT *, sum(new::INT) OVER (PARTITION BY fight_id, corner ORDER BY frame) AS seg FROM bs0), bs AS (SELECT *, count(*) OVER (PARTITION BY fight_id, corner, seg) AS rows FROM bs1),
    bn AS (SELECT *, lead(frame) OVER w AS nf, {", ".join(f"lead({c}) OVER w AS n_{c}" for c in ("cx", "cy", "w", "h"))} FROM bs WHERE rows > 1 WINDOW w AS (PARTITION BY fight_id, corner, seg ORDER BY frame)),
    bd AS (SELECT fight_id, corner, seg, f, f > frame AS filled, CASE WHEN f = frame THEN p END AS p, CASE WHEN f = frame THEN [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2] END AS o, {", ".join(f"CASE WHEN f = frame THEN {c} ELSE (n_{c} - {c}) / (nf - frame) * (f - frame) + {c} END::DOUBLE AS {c}" for c in ("cx", "cy", "w", "h"))}, event_id
        FROM (SELECT *, unnest(range(frame, coalesce(nf, frame + 1))) AS f FROM bn)),
    bl AS (SELECT fight_id, corner, seg, count(*) AS n, list(f ORDER BY f) AS fs, {", ".join(f"list({c} ORDER BY f) AS l_{c}" for c in ("cx", "cy", "w", "h"))} FROM bd GROUP BY ALL),
    bm AS (SELECT fight_id, corner, seg, n, fs, least({_FIT}, n - 1 + n % 2) AS win, {", ".join(f"CASE WHEN n < 3 THEN l_{c} ELSE [list_sort([l_{c}[greatest(1, least(n, i + d))] FOR d IN range(-(least({_MEDIAN}, n - 1 + n % 2) // 2), least({_MEDIAN}, n - 1 + n % 2) // 2 + 1)])[least({_MEDIAN}, n - 1 + n % 2) // 2 + 1] FOR i IN range(1, n + 1)] END AS m_{c}" for c in ("cx", "cy", "w", "h"))} FROM bl),
    bi AS (SELECT *, unnest(range(1, n + 1)) AS i FROM bm), bj AS (SELECT *, least(greatest(i - 1 - win // 2, 0), n - win) AS s FROM bi),
    bf AS (SELECT fight_id, corner, seg, fs[i] AS f, {", ".join(f"CASE WHEN win > 2 THEN list_sum([({[[[0.0]], *(tracks.fit_weights(w) for w in range(3, _FIT + 1, 2))]})[(win + 1) // 2][i - s][j] * m_{c}[s + j] FOR j IN range(1, win + 1)]) ELSE m_{c}[i] END AS s_{c}" for c in ("cx", "cy", "w", "h"))} FROM bj),
    bt AS (SELECT bd.*, bf.* EXCLUDE (fight_id, corner, seg, f), [p[i] FOR i IN [6, 7, 12, 13] IF p[i][3] >= 0.4] AS t FROM bd JOIN bf USING (fight_id, corner, seg, f)),
    bu AS (SELECT *, [s_cx - s_w / 2, s_cy - s_h / 2, s_cx + s_w / 2, s_cy + s_h / 2] AS q, list_avg([j[1] FOR j IN t]) AS tx, list_avg([j[2] FOR j IN t]) AS ty FROM bt),
    bv AS (SELECT *, CASE WHEN len(t) >= 2 AND sqrt(greatest(q[1] - tx, tx - q[3], 0) ** 2 + greatest(q[2] - ty, ty - q[4], 0) ** 2) / greatest(1, sqrt((q[3] - q[1]) ** 2 + (q[4] - q[2]) ** 2)) > {tracks.DRIFT_RATIO} THEN o ELSE q END AS b,
        sqrt((p[6][1] - p[7][1]) ** 2 + (p[6][2] - p[7][2]) ** 2) AS sw, sqrt(((p[6][1] + p[7][1]) / 2 - (p[12][1] + p[13][1]) / 2) ** 2 + ((p[6][2] + p[7][2]) / 2 - (p[12][2] + p[13][2]) / 2) ** 2) AS sl, [j FOR j IN p IF j[3] >= 0.4] AS js, [p[i] FOR i IN [10, 11, 16, 17] IF p[i][3] >= 0.4] AS es FROM bu),
    bw AS (SELECT *, CASE WHEN least(p[6][3], p[7][3], p[12][3], p[13][3]) >= 0.4 AND sl >= 0.5 * sw THEN greatest(sl, 10) WHEN least(p[6][3], p[7][3]) >= 0.4 AND sw > 0 THEN greatest(sw, 10) END AS scale, list_min([j[1] FOR j IN js]) AS hx1, list_min([j[2] FOR j IN js]) AS hy1, list_max([j[1] FOR j IN js]) AS hx2, list_max([j[2] FOR j IN js]) AS hy2 FROM bv),
    by_ AS (SELECT *, coalesce(len(js) >= 4 AND greatest(hx2 - hx1, hy2 - hy1) <= 6 * scale, false) AS ok, 0.2 * scale AS pad FROM bw)
    SELECT fight_id, corner, f AS frame, filled, round(CASE WHEN ok THEN least(b[1], hx1, coalesce(list_min([j[1] FOR j IN es]) - pad, hx1)) ELSE b[1] END, 6) AS x1, round(CASE WHEN ok THEN least(b[2], hy1, coalesce(list_min([j[2] FOR j IN es]) - pad, hy1)) ELSE b[2] END, 6) AS y1,
        round(CASE WHEN ok THEN greatest(b[3], hx2, coalesce(list_max([j[1] FOR j IN es]) + pad, hx2)) ELSE b[3] END, 6) AS x2, round(CASE WHEN ok THEN greatest(b[4], hy2, coalesce(list_max([j[2] FOR j IN es]) + pad, hy2)) ELSE b[4] END, 6) AS y2 FROM by_
    UNION ALL SELECT fight_id, corner, frame, false, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2 FROM bs WHERE rows = 1""",
)
def _(m):
    t = tracks.smooth_boxes(people(m), "fight_id", "corner", fps=SMOOTH_FPS)
    return t.select("fight_id", "corner", "frame", "filled", *(F.round(f"box.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


# ---------------------------------------------------------------- training data

SAMPLE_SQL = (
    BOXES_SQL
    + f""", lb AS (SELECT fight_id, frame // 300 AS frame, corner, event_id, target, {sql_lookup(LABEL_FAMILY, "action")} AS family FROM ev WHERE source = 'label' AND {sql_lookup(LABEL_FAMILY, "action")} IS NOT NULL),
    lp AS (SELECT *, list_position({list(training.CLASSES)!r}, family) - 1 AS f, coalesce(list_position({list(training.TARGETS)!r}, target), 0) - 1 AS t FROM lb),
    ps AS (SELECT * FROM bx WHERE p IS NOT NULL), po AS (SELECT lp.* FROM lp SEMI JOIN ps USING (fight_id, corner, frame) WHERE f > 0)"""
)
FRAME_SECONDS = 1.0


def sample_labels(m) -> DataFrame:
    """Label strikes on the people's frames: fight_id, frame, corner, family, target, event_id, fps."""
    t = m.events.where("source = 'label'").withColumn("family", lookup(LABEL_FAMILY, "action")).where("family is not null")
    return t.select("fight_id", F.floor(F.col("frame") / 300).alias("frame"), "corner", "family", "target", "event_id", F.lit(FRAME_SECONDS).alias("fps"))


def _coarse(spans: DataFrame) -> DataFrame:
    return spans.select("fight_id", *(F.floor(F.col(c) / 300).alias(c) for c in ("start_frame", "end_frame")))


@query(
    "M-18",
    SAMPLE_SQL
    + """, ha AS (SELECT fight_id, frame, 1 - corner AS corner FROM po), fr AS (SELECT fight_id, corner, frame FROM ps),
    nl AS (SELECT DISTINCT fight_id, corner, frame + d AS frame FROM lb, range(-1, 2) t(d)),
    hn AS (SELECT ha.* FROM ha ANTI JOIN nl USING (fight_id, corner, frame) SEMI JOIN ps USING (fight_id, corner, frame)),
    fn AS (SELECT fr.*, md5('5:' || fight_id || ':' || corner || ':' || frame) AS h FROM fr ANTI JOIN nl USING (fight_id, corner, frame)
        WHERE EXISTS (FROM rounds r WHERE r.fight_id = fr.fight_id AND fr.frame BETWEEN r.start_frame // 300 AND r.end_frame // 300) AND NOT EXISTS (FROM excluded x WHERE x.fight_id = fr.fight_id AND fr.frame BETWEEN x.start_frame // 300 AND x.end_frame // 300)),
    fw AS (SELECT fight_id, count(*) AS want FROM po GROUP BY fight_id), fp AS (SELECT fn.*, row_number() OVER (PARTITION BY fight_id ORDER BY h) AS i FROM fn)
    SELECT fight_id, frame, corner, 'label' AS kind, f::INT AS family, t::INT AS target, event_id FROM po UNION ALL SELECT fight_id, frame, corner, 'hard_neg', 0, -1, NULL FROM hn UNION ALL SELECT fight_id, frame, corner, 'rand_neg', 0, -1, NULL FROM fp JOIN fw USING (fight_id) WHERE i <= want""",
)
def _(m):
    return training.samples(sample_labels(m), people(m), _coarse(m.rounds), _coarse(m.excluded), seed=5)


_FEATS = "[CASE WHEN q[3] >= 0.4 THEN greatest(-8, least(8, CASE WHEN flip THEN -1 ELSE 1 END * (q[1] - ax) / scale)) ELSE 0 END, CASE WHEN q[3] >= 0.4 THEN greatest(-8, least(8, (q[2] - ay) / scale)) ELSE 0 END, q[3]]"
_SWAP = [*range(1, 18)]
for _a, _b in training.MIRRORED:
    _SWAP[_a], _SWAP[_b] = _b + 1, _a + 1


def _person_sql(p: str) -> str:
    zeros = f"[0.0 FOR i IN range({training.PERSON_CHANNELS})]"
    return f"CASE WHEN {p} IS NULL THEN {zeros} ELSE flatten(list_transform([{p}[CASE WHEN flip THEN {_SWAP!r}[i] ELSE i END] FOR i IN range(1, 18)], lambda q: {_FEATS})) || [1.0] END"


@query(
    "M-17",
    SAMPLE_SQL
    + f""", wa0 AS (SELECT *, [p[i] FOR i IN [6, 7, 12, 13] IF p[i][3] >= 0.4] AS t, sqrt((p[6][1] - p[7][1]) ** 2 + (p[6][2] - p[7][2]) ** 2) AS sw, sqrt(((p[6][1] + p[7][1]) / 2 - (p[12][1] + p[13][1]) / 2) ** 2 + ((p[6][2] + p[7][2]) / 2 - (p[12][2] + p[13][2]) / 2) ** 2) AS sl FROM ps),
    wa AS (SELECT fight_id, corner, frame, p, CASE WHEN len(t) >= 2 THEN (list_min([j[1] FOR j IN t]) + list_max([j[1] FOR j IN t])) / 2 ELSE cx END AS ax, CASE WHEN len(t) >= 2 THEN (list_min([j[2] FOR j IN t]) + list_max([j[2] FOR j IN t])) / 2 ELSE cy END AS ay,
        CASE WHEN least(p[6][3], p[7][3], p[12][3], p[13][3]) >= 0.4 AND sl >= 0.5 * sw THEN greatest(sl, 10) WHEN least(p[6][3], p[7][3]) >= 0.4 AND sw > 0 THEN greatest(sw, 10) ELSE greatest(h / 3, 10) END AS scale FROM wa0),
    wn AS (SELECT fight_id, max(frame) // 300 + 1 AS n FROM ev GROUP BY fight_id), wr AS (SELECT po.event_id, po.fight_id, po.corner, po.frame, n, ax, ay, scale FROM po JOIN wa USING (fight_id, corner, frame) JOIN wn USING (fight_id)),
    wg AS (SELECT *, greatest(0, least(n - 1, round_even(frame + (step - {(training.TOTAL - 1) // 2}) / {training.HERTZ} * 10, 0)::BIGINT)) AS f FROM (SELECT *, unnest(range({training.TOTAL})) AS step FROM wr)),
    wj AS (SELECT g.*, a.p AS ap, o.p AS op, o.ax AS ox FROM wg g LEFT JOIN wa a ON a.fight_id = g.fight_id AND a.corner = g.corner AND a.frame = g.f LEFT JOIN wa o ON o.fight_id = g.fight_id AND o.corner = 1 - g.corner AND o.frame = g.f),
    wf AS (SELECT event_id, arg_min(ox, abs(f - frame) * 100 + step) FILTER (WHERE ox IS NOT NULL) AS ox FROM wj GROUP BY event_id),
    wl AS (SELECT wj.* EXCLUDE (ox), coalesce(coalesce(o.ax, wf.ox) < wj.ax, false) AS flip FROM wj JOIN wf USING (event_id) LEFT JOIN wa o ON o.fight_id = wj.fight_id AND o.corner = 1 - wj.corner AND o.frame = wj.frame),
    wc AS (SELECT event_id, unnest({_person_sql("ap")} || {_person_sql("op")}) AS v, unnest(range({training.CHANNELS})) AS c FROM wl), ws AS (SELECT event_id, c, sum(v) AS s, max(v) AS m FROM wc GROUP BY ALL)
    SELECT event_id, {training.TOTAL} AS steps, list(round(s, 4) ORDER BY c) AS sums, list(round(m, 4) ORDER BY c) AS most FROM ws GROUP BY event_id""",
)
def _(m):
    frames = m.events.groupBy("fight_id").agg((F.floor(F.max("frame") / 300) + 1).alias("n_frames"))
    asked = sample_labels(m).where(F.col("family").isin(*training.CLASSES[1:])).join(frames, "fight_id").select(F.col("event_id").alias("id"), "fight_id", "frame", "corner", F.lit(10.0).alias("fps"), "n_frames")
    t = training.windows(asked, people(m))
    total = lambda ch: F.round(F.aggregate(ch, F.lit(0.0), lambda a, v: a + v), 4)
    return t.select(F.col("id").alias("event_id"), F.size(F.get("window", F.lit(0))).alias("steps"), F.transform("window", total).alias("sums"), F.transform("window", lambda ch: F.round(F.array_max(ch), 4)).alias("most"))


# ---------------------------------------------------------------- who is who

# the colours that a check of the corners sees
VOTES_SQL = SLOTS_SQL + """, vt0 AS (SELECT fight_id, frame, max(CASE WHEN slot = 0 THEN k END) AS k0, max(CASE WHEN slot = 1 THEN k END) AS k1 FROM sl GROUP BY ALL HAVING count(*) = 2),
    vt AS (SELECT fight_id, frame, CASE WHEN k0 % 9 > 0 THEN (k0 % 4 > 0)::INT END AS v0, CASE WHEN k1 % 7 > 0 THEN (k1 % 5 = 0)::INT END AS v1 FROM vt0), vd AS (SELECT fight_id, frame, v0 = 1 AS ok FROM vt WHERE v0 <> v1)"""


def colour_votes(m) -> DataFrame:
    """Frames with both corners: fight_id, frame, vote_0, vote_1."""
    t = m.events.groupBy("fight_id", F.floor(F.col("frame") / 1200).alias("frame"), "corner").agg(F.max_by("k", "event_id").alias("k"))
    of = lambda s: F.max(F.when(F.col("corner") == s, F.col("k")))
    t = t.groupBy("fight_id", "frame").agg(of(0).alias("k0"), of(1).alias("k1")).where("k0 is not null and k1 is not null")
    return t.select("fight_id", "frame", F.when(F.col("k0") % 9 > 0, (F.col("k0") % 4 > 0).cast("int")).alias("vote_0"), F.when(F.col("k1") % 7 > 0, (F.col("k1") % 5 == 0).cast("int")).alias("vote_1"))


@query("A-35", VOTES_SQL + " SELECT fight_id, count(ok) AS decisive, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / nullif(count(ok), 0), 6) AS accuracy FROM fights LEFT JOIN vd USING (fight_id) GROUP BY fight_id")
def _(m):
    return corners.accuracy(colour_votes(m), m.fights).withColumn("accuracy", F.round("accuracy", 6))


@query("A-35-runs", VOTES_SQL + ", vn AS (SELECT *, ok IS DISTINCT FROM lag(ok) OVER (PARTITION BY fight_id ORDER BY frame) AS new FROM vd), vr AS (SELECT *, sum(new::INT) OVER (PARTITION BY fight_id ORDER BY frame)::BIGINT AS run FROM vn) SELECT fight_id, run, any_value(ok) AS right, count(*) AS n, min(frame) AS first, max(frame) AS last FROM vr GROUP BY fight_id, run")
def _(m):
    return runs.run_lengths(corners.decisive(colour_votes(m)), "right", "fight_id", order=["frame"])


# three people at most and two masks a frame: the best pair of people is found by looking at all
PEOPLE_SQL = """pl0 AS (SELECT fight_id, frame // 600 AS frame, event_id, k, row_number() OVER (PARTITION BY fight_id, frame // 600 ORDER BY event_id) - 1 AS no FROM ev),
    pl AS (SELECT *, [k % 20 * 3 + no * 15, k % 5, k % 20 * 3 + no * 15 + 30 + event_id % 7 + event_id / 65536, k % 5 + 60]::DOUBLE[] AS b, (k * 7 + event_id) % 1009 AS c FROM pl0 WHERE no < 3),
    mk AS (SELECT fight_id, frame, no, [b[1] + event_id % 13 - 6, b[2] + 2, b[3] + event_id % 11 - 5, b[4] - k % 9]::DOUBLE[] AS r FROM pl WHERE no < 2)"""


@query(
    "M-04",
    PEOPLE_SQL
    + f""", mo AS (SELECT pl.fight_id, pl.frame, pl.no AS p, mk.no AS r, {_overlap_sql("b", "r")} AS o, c FROM pl JOIN mk USING (fight_id, frame)),
    m1 AS (SELECT fight_id, frame, p AS p0, NULL AS p1, o AS total FROM mo WHERE r = 0 UNION ALL SELECT fight_id, frame, NULL, p, o FROM mo WHERE r = 1 UNION ALL SELECT a.fight_id, a.frame, a.p, b.p, a.o + b.o FROM mo a JOIN mo b ON b.fight_id = a.fight_id AND b.frame = a.frame AND a.r = 0 AND b.r = 1 AND a.p <> b.p),
    mb AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY fight_id, frame ORDER BY total DESC) = 1),
    mh AS (SELECT mo.* FROM mb JOIN mo ON mo.fight_id = mb.fight_id AND mo.frame = mb.frame AND ((r = 0 AND p = p0) OR (r = 1 AND p = p1)) WHERE o >= {selection.LEAST_OVERLAP})
    SELECT fight_id, frame, p AS no, row_number() OVER (PARTITION BY fight_id, frame ORDER BY c DESC, p) AS rank FROM mh""",
)
def _(m):
    t = m.events.withColumn("frame", F.floor(F.col("frame") / 600))
    t = t.withColumn("no", F.row_number().over(Window.partitionBy("fight_id", "frame").orderBy("event_id")) - 1).where("no < 3")
    k, e = F.col("k"), F.col("event_id")
    x = k % 20 * 3 + F.col("no") * 15
    t = t.select("fight_id", "frame", "no", "k", "event_id", x.alias("x1"), (k % 5).alias("y1"), (x + 30 + e % 7 + e / 65536).alias("x2"), (k % 5 + 60).alias("y2"), ((k * 7 + e) % 1009).alias("confidence"))
    masks = t.where("no < 2").select("fight_id", "frame", "no", (F.col("x1") + e % 13 - 6).alias("x1"), (F.col("y1") + 2).alias("y1"), (F.col("x2") + e % 11 - 5).alias("x2"), (F.col("y2") - k % 9).alias("y2"))
    return selection.select_people(t, masks)
