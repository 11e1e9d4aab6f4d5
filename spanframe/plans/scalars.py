"""Scalar functions over readings, boxes and skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import geometry as geo
from spanframe.functions import readings
from spanframe.plans.registry import query

# ---------------------------------------------------------------- readings

TEXTS_SQL = """tx AS (SELECT event_id, frame, k, [
    'R1 4:32 BLUE', 'ROUND ' || (k % 7), (k % 20) || ':' || lpad((k % 70)::VARCHAR, 2, '0'), '2 0' || (k % 10) || lpad((event_id % 60)::VARCHAR, 2, '0') || ' KSF',
    '0' || (k % 10) || 'x' || lpad((event_id % 60)::VARCHAR, 2, '0'), '04408', 'PURSE 3.85M', 'KSW 2024', 'SUPER 5 ENERGY', 'rd' || (k % 7) || ' 12.' || lpad((event_id % 70)::VARCHAR, 2, '0'),
    'runda 2; 1;05', 'r-' || (k % 6) || ' 080012', '|' || (k % 6) || '|'][event_id % 13 + 1] AS text FROM ev)"""


def texts(m) -> DataFrame:
    """A text as a scoreboard might show it for every event."""
    k, e = F.col("k"), F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    kinds = [
        F.lit("R1 4:32 BLUE"), F.concat(F.lit("ROUND "), k % 7), F.concat(k % 20, F.lit(":"), two(k % 70)), F.concat(F.lit("2 0"), k % 10, two(e % 60), F.lit(" KSF")),
        F.concat(F.lit("0"), k % 10, F.lit("x"), two(e % 60)), F.lit("04408"), F.lit("PURSE 3.85M"), F.lit("KSW 2024"), F.lit("SUPER 5 ENERGY"), F.concat(F.lit("rd"), k % 7, F.lit(" 12."), two(e % 70)),
        F.lit("runda 2; 1;05"), F.concat(F.lit("r-"), k % 6, F.lit(" 080012")), F.concat(F.lit("|"), k % 6, F.lit("|")),
    ]
    return m.events.select("event_id", "frame", "k", F.element_at(F.array(*kinds), (e % 13 + 1).cast("int")).alias("text"))


def _timer_sql(text: str) -> str:
    first, second = (f"regexp_extract({text}, '{readings.CLOCK}', {i})::INT" for i in (1, 2))
    a, b = (f"regexp_extract({text}, '{readings.LOST_SEPARATOR}', {i})::INT" for i in (1, 2))
    return f"CASE WHEN regexp_matches({text}, '{readings.CLOCK}') THEN CASE WHEN {first} <= 59 AND {second} <= 59 THEN {first} * 60 + {second} END WHEN regexp_matches({text}, '{readings.LOST_SEPARATOR}') THEN {a} * 60 + {b} END"


def _round_sql(text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(upper({text}), '{p}', 1), '')::INT" for p in readings.ROUND_PREFIXES) + ")"


@query("E-01", TEXTS_SQL + f" SELECT event_id, text, {_timer_sql('text')} AS seconds FROM tx")
def _(m):
    return texts(m).select("event_id", "text", readings.timer_seconds(F.col("text")).alias("seconds"))


@query("E-02", TEXTS_SQL + f" SELECT event_id, {_round_sql('text')} AS round FROM tx")
def _(m):
    return texts(m).select("event_id", readings.round_number(F.col("text")).alias("round"))


@query(
    "E-03",
    f"""bx AS (SELECT event_id, i, ((event_id * (i + 3)) % 120)::DOUBLE AS x1, ((k * (i + 1)) % 24)::DOUBLE AS y1, x1 + 14 + (event_id % 7) * i AS x2, y1 + 9 + k % 5 AS y2,
            [ '4:' || lpad((k % 75)::VARCHAR, 2, '0'), '[' || (k % 7) || ']', CASE WHEN k % 10 = 0 THEN 'RD 2' ELSE ' ' || (event_id % 6) || ' ' END, '03x' || lpad((k % 66)::VARCHAR, 2, '0')][i] AS text,
            ((event_id * 3 + i * 37) % 100) / 100 AS conf FROM ev, range(1, 5) t(i)),
    u AS (SELECT *, {_timer_sql('text')} AS secs, {_round_sql('text')} AS rnd FROM bx WHERE conf >= 0.2),
    c AS (SELECT event_id, x1 AS tx1, y1 AS ty1, x2 AS tx2, y2 AS ty2 FROM u WHERE secs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY conf DESC, i) = 1),
    d AS (SELECT event_id, regexp_extract(trim(text), '{readings.ROUND_DIGIT}', 1)::INT AS digit FROM u JOIN c USING (event_id)
          WHERE regexp_matches(trim(text), '{readings.ROUND_DIGIT}') AND abs((y1 + y2) / 2 - (ty1 + ty2) / 2) <= 0.6 * (ty2 - ty1) AND greatest(0, tx1 - x2, x1 - tx2) <= 1.5 * (tx2 - tx1)
          QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY greatest(0, tx1 - x2, x1 - tx2), i) = 1),
    p AS (SELECT event_id, arg_min(rnd, i) AS rnd FROM u WHERE rnd IS NOT NULL GROUP BY event_id)
    SELECT e.event_id, coalesce(p.rnd, d.digit) AS round FROM ev e LEFT JOIN p USING (event_id) LEFT JOIN d USING (event_id)""",
)
def _(m):
    k, e = F.col("k"), F.col("event_id")
    said = [F.concat(F.lit("4:"), F.lpad((k % 75).cast("string"), 2, "0")), F.concat(F.lit("["), k % 7, F.lit("]")), F.when(k % 10 == 0, "RD 2").otherwise(F.concat(F.lit(" "), e % 6, F.lit(" "))), F.concat(F.lit("03x"), F.lpad((k % 66).cast("string"), 2, "0"))]
    boxes = []
    for i, text in enumerate(said, 1):
        x, y = ((e * (i + 3)) % 120).cast("double"), ((k * (i + 1)) % 24).cast("double")
        boxes.append(F.struct(x.alias("x1"), y.alias("y1"), (x + 14 + (e % 7) * i).alias("x2"), (y + 9 + k % 5).alias("y2"), text.alias("text"), (((e * 3 + i * 37) % 100) / 100).alias("conf")))
    return m.events.select("event_id", F.array(*boxes).alias("boxes")).select("event_id", readings.round_from_boxes(F.col("boxes"), 0.2).alias("round"))


@query(
    "E-04",
    """s AS (SELECT event_id, k % 3 = 0 AS present, k % 6 = 0 AS engaged, CASE WHEN k % 7 = 0 THEN -1 WHEN k % 11 = 0 THEN 0 WHEN k % 2 = 0 AND k % 5 > 0 THEN 1 WHEN k % 5 > 0 THEN 0.9 WHEN k % 2 = 0 THEN 0.6 ELSE -1 END::DOUBLE AS signal FROM ev)
    SELECT event_id, signal, round(CASE WHEN signal >= 0 THEN 0.7 * signal + 0.2 * present::INT + 0.1 * engaged::INT ELSE present::INT * 2 / 3 + engaged::INT / 3 END, 6) AS prob FROM s""",
)
def _(m):
    k = F.col("k")
    signal = readings.reading_signal(k % 7 != 0, F.when(k % 11 == 0, "low_confidence"), F.when(k % 2 == 0, 1), F.when(k % 5 > 0, 60))
    t = m.events.select("event_id", "k", signal.alias("signal"))
    return t.select("event_id", "signal", F.round(readings.fused(F.col("signal"), k % 3 == 0, k % 6 == 0), 6).alias("prob"))


@query("E-14", "SELECT event_id, (frame - 1) // 50 // 60 || ':' || lpad(((frame - 1) // 50 % 60)::VARCHAR, 2, '0') AS clock, frame // 3000 || ':' || lpad(printf('%.2f', (frame % 3000) / 50), 5, '0') AS exact FROM ev")
def _(m):
    return m.events.select("event_id", readings.frame_clock(F.col("frame"), F.lit(50)).alias("clock"), readings.exact_clock(F.col("frame"), F.lit(50)).alias("exact"))


@query("E-20", "d AS (SELECT event_id, round_even(value * k / 7, 0)::BIGINT AS s FROM ev) SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || 'h' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN s // 60 || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS text FROM d")
def _(m):
    return m.events.select("event_id", readings.duration(F.col("value") * F.col("k") / 7).alias("text"))


# ---------------------------------------------------------------- boxes


BOXES_SQL = """b2 AS (SELECT event_id, k, (event_id * 7 % 300)::DOUBLE AS ax1, (event_id * 11 % 200)::DOUBLE AS ay1, ax1 + k AS ax2, ay1 + k % 40 AS ay2, (k * 3 % 280)::DOUBLE AS bx1, (event_id * 5 % 190)::DOUBLE AS by1, bx1 + 30 + k % 60 AS bx2, by1 + event_id % 80 AS by2 FROM ev)"""


def boxes(m) -> DataFrame:
    """Two boxes a and b for every event."""
    k, e = F.col("k"), F.col("event_id")
    d = lambda c: c.cast("double")
    ax, ay, bx, by = d(e * 7 % 300), d(e * 11 % 200), d(k * 3 % 280), d(e * 5 % 190)
    return m.events.select("event_id", "k", geo.box(ax, ay, ax + k, ay + k % 40).alias("a"), geo.box(bx, by, bx + 30 + k % 60, by + e % 80).alias("b"))


@query("E-05", BOXES_SQL + ", o AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS i FROM b2) SELECT event_id, round(coalesce(i / nullif((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - i, 0), 0), 6) AS iou FROM o")
def _(m):
    return boxes(m).select("event_id", F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("E-06", BOXES_SQL + " SELECT event_id, CASE WHEN k % 9 > 0 THEN round(sqrt(greatest(0, greatest(ax1, bx1) - least(ax2, bx2)) ** 2 + greatest(0, greatest(ay1, by1) - least(ay2, by2)) ** 2), 6) END AS distance FROM b2")
def _(m):
    return boxes(m).select("event_id", F.round(geo.gap(F.when(F.col("k") % 9 > 0, F.col("a")), F.col("b")), 6).alias("distance"))


@query("E-11", BOXES_SQL + " SELECT event_id, k % 8 > 0 AS present, k % 8 > 0 AND abs((ax1 + ax2) / 2 - (bx1 + bx2) / 2) < 0.625 * 160 AS engaged FROM b2")
def _(m):
    flat = lambda b: F.array(*(F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2")))
    found = F.array(flat("a"), F.array(F.lit(1.0)), F.when(F.col("k") % 8 > 0, flat("b")).otherwise(F.array().cast("array<double>")))
    return boxes(m).select("event_id", geo.present_engaged(found, F.lit(160)).alias("s")).select("event_id", "s.present", "s.engaged")


@query("E-13", "SELECT event_id, round(CASE WHEN (k % 5 - 2 >= 0) = (event_id % 2 = 0) THEN 0.5 - 0.5 * least(k % 13, 8) / 8 ELSE 0.5 + 0.5 * least(k % 13, 8) / 8 END, 6) AS tape, round(0.5 + (sqrt(greatest(0, 1 - (sqrt((k % 4) * 2) + sqrt((k % 7) * 3) + sqrt(5.0 * (event_id % 3))) / sqrt((k % 4 + k % 7 + event_id % 3 + 1.0) * 10 ) )) - 0.5) * least(k * 3, 150) / 150, 6) AS hist FROM (SELECT * REPLACE (k % 100 AS k) FROM ev)")
def _(m):
    k, e = F.col("k") % 100, F.col("event_id")
    hist = F.array(*(c.cast("double") for c in (k % 4, k % 7, e % 3, F.lit(1))))
    template = F.array(*map(F.lit, (2.0, 3.0, 5.0, 0.0)))
    tape = geo.tape_distance(k % 5 - 2, k % 13, F.when(e % 2 == 0, 1).otherwise(-1))
    return m.events.select("event_id", F.round(tape, 6).alias("tape"), F.round(geo.histogram_distance(hist, k * 3, template), 6).alias("hist"))


# ---------------------------------------------------------------- skeletons

JOINT_SQL = "[((event_id * (2 * i + 3)) % 97 + i * 5)::DOUBLE, ((k * (i + 5) + event_id) % 61 + i * 9)::DOUBLE, ((event_id + i * 13 + k * 7) % {most} + {least}) / 10]"


def joints_sql(name: str, least: int) -> str:
    return f"[{JOINT_SQL.format(most=10 - least, least=least)} FOR i IN range(17)] AS {name}"


SKELETONS_SQL = f"sk AS (SELECT event_id, k, {joints_sql('p', 2)}, {joints_sql('q', 4)} FROM ev), jt AS (SELECT *, [p[i] FOR i IN [6, 7, 12, 13] IF p[i][3] >= 0.4] AS t FROM sk)"


def skeleton(least: int) -> Column:
    """17 joints whose confidence is ``least`` tenths or more."""
    k, e = F.col("k"), F.col("event_id")
    joint = lambda i: F.array(((e * (2 * i + 3)) % 97 + i * 5).cast("double"), ((k * (i + 5) + e) % 61 + i * 9).cast("double"), ((e + i * 13 + k * 7) % (10 - least) + least) / 10)
    return F.transform(F.sequence(F.lit(0), F.lit(16)), joint)


def skeletons(m) -> DataFrame:
    return m.events.select("event_id", "k", skeleton(2).alias("p"), skeleton(4).alias("q"))


SCALE_SQL = """sc AS (SELECT *, sqrt((p[6][1] - p[7][1]) ** 2 + (p[6][2] - p[7][2]) ** 2) AS w, sqrt(((p[6][1] + p[7][1]) / 2 - (p[12][1] + p[13][1]) / 2) ** 2 + ((p[6][2] + p[7][2]) / 2 - (p[12][2] + p[13][2]) / 2) ** 2) AS len,
    CASE WHEN least(p[6][3], p[7][3], p[12][3], p[13][3]) >= 0.4 AND len >= 0.5 * w THEN greatest(len, 10) WHEN least(p[6][3], p[7][3]) >= 0.4 AND w > 0 THEN greatest(w, 10) END AS scale FROM jt)"""


@query("E-07", SKELETONS_SQL + " SELECT event_id, CASE WHEN len(t) >= 2 THEN list_min([j[1] FOR j IN t]) END AS x1, CASE WHEN len(t) >= 2 THEN list_min([j[2] FOR j IN t]) END AS y1, CASE WHEN len(t) >= 2 THEN list_max([j[1] FOR j IN t]) END AS x2, CASE WHEN len(t) >= 2 THEN list_max([j[2] FOR j IN t]) END AS y2 FROM jt")
def _(m):
    return skeletons(m).select("event_id", geo.torso(F.col("p")).alias("t")).select("event_id", "t.x1", "t.y1", "t.x2", "t.y2")


@query("E-08", f"{SKELETONS_SQL}, {SCALE_SQL} SELECT event_id, round(scale, 6) AS scale FROM sc")
def _(m):
    return skeletons(m).select("event_id", F.round(geo.scale(F.col("p")), 6).alias("scale"))


@query(
    "E-09",
    f"""{SKELETONS_SQL}, {SCALE_SQL} SELECT event_id, degrees(atan2(abs((p[12][1] + p[13][1]) / 2 - (p[6][1] + p[7][1]) / 2), abs((p[12][2] + p[13][2]) / 2 - (p[6][2] + p[7][2]) / 2) + 1e-6)) > 50
    OR (least(p[1][3], p[16][3], p[17][3]) >= 0.4 AND coalesce((greatest(p[1][2], p[16][2], p[17][2]) - least(p[1][2], p[16][2], p[17][2])) / scale < 1.2, false)) AS grounded FROM sc""",
)
def _(m):
    return skeletons(m).select("event_id", geo.grounded(F.col("p")).alias("grounded"))


@query(
    "E-10",
    f"""{SKELETONS_SQL}, {SCALE_SQL}, h AS (SELECT *, [p[i] FOR i IN [1, 4, 5] IF p[i][3] >= 0.4] AS s FROM sc)
    SELECT event_id, round(CASE WHEN len(s) > 0 THEN list_avg([j[1] FOR j IN s]) ELSE (p[6][1] + p[7][1]) / 2 END, 6) AS x, round(CASE WHEN len(s) > 0 THEN list_avg([j[2] FOR j IN s]) ELSE (p[6][2] + p[7][2]) / 2 - 0.45 * coalesce(scale, 10) END, 6) AS y FROM h""",
)
def _(m):
    return skeletons(m).select("event_id", geo.head_centre(F.col("p")).alias("h")).select("event_id", F.round("h.x", 6).alias("x"), F.round("h.y", 6).alias("y"))


@query(
    "E-12",
    f"""{SKELETONS_SQL}, {SCALE_SQL}, {BOXES_SQL}, v AS (SELECT *, [j FOR j IN p IF j[3] >= 0.4] AS s, [p[i] FOR i IN [10, 11, 16, 17] IF p[i][3] >= 0.4] AS x FROM sc),
    u AS (SELECT *, list_min([j[1] FOR j IN s]) AS x1, list_min([j[2] FOR j IN s]) AS y1, list_max([j[1] FOR j IN s]) AS x2, list_max([j[2] FOR j IN s]) AS y2, 0.2 * scale AS pad FROM v),
    h AS (SELECT *, len(s) >= 4 AND greatest(x2 - x1, y2 - y1) <= 6 * scale AS ok, list_avg([j[1] FOR j IN t]) AS cx, list_avg([j[2] FOR j IN t]) AS cy FROM u)
    SELECT event_id, round(CASE WHEN ok THEN coalesce(least(x1, list_min([j[1] FOR j IN x]) - pad), x1) END, 6) AS x1, round(CASE WHEN ok THEN coalesce(greatest(y2, list_max([j[2] FOR j IN x]) + pad), y2) END, 6) AS y2,
           round(CASE WHEN len(t) >= 2 THEN sqrt(greatest(ax1 - cx, cx - ax2, 0) ** 2 + greatest(ay1 - cy, cy - ay2, 0) ** 2) / greatest(1, sqrt((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2)) ELSE 0 END, 6) AS drift,
           (ax1 + ax2) / 2 AS cx, ay2 - ay1 AS h, ax2 AS back FROM h JOIN b2 USING (event_id)""",
)
def _(m):
    t = boxes(m).withColumns({"p": skeleton(2), "c": geo.centred(F.col("a"))})
    t = t.withColumns({"hull": geo.skeleton_hull(F.col("p")), "back": geo.cornered(F.col("c"))})
    return t.select("event_id", F.round("hull.x1", 6).alias("x1"), F.round("hull.y2", 6).alias("y2"), F.round(geo.drift(F.col("a"), F.col("p")), 6).alias("drift"), "c.cx", "c.h", F.col("back.x2").alias("back"))


@query(
    "F-14",
    f"""{SKELETONS_SQL} SELECT event_id, coalesce(k % 10 > 0 AND ((list_bool_and([j[3] >= 0.4 FOR j IN list_select(p, [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17])]) AND true)
      OR CASE WHEN k % 3 > 0 THEN len([1 FOR j IN list_select(p, [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]) IF j[3] >= 0.4]) >= 6 ELSE least(p[1][3], p[6][3], p[7][3], p[12][3], p[13][3]) >= 0.4 END), false) AS usable FROM sk""",
)
def _(m):
    return skeletons(m).select("event_id", geo.usable(F.col("p"), F.when(F.col("k") % 10 > 0, F.col("q")), F.col("k") % 3 > 0).alias("usable"))
