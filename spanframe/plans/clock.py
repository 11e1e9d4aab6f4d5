"""Readings of the clock on screen and the round lists made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators import calibration, clock, smoothing
from spanframe.operators.clock import CONFIRM, MAX_BACKWARD, MAX_RESIDUAL, MIN_BREAK, MIN_INTERIOR, RESET_JUMP
from spanframe.plans.registry import query
from spanframe.sources.testdata import FPS, ROUND_FRAMES

# ---------------------------------------------------------------- adapter views

READ_SQL = f"""rd0 AS (SELECT fight_id, frame, max(k) AS k FROM ev GROUP BY ALL),
    rd AS (SELECT fight_id, frame, k, 300 - frame % {ROUND_FRAMES} // {FPS} + CASE WHEN k % 10 = 7 THEN 45 ELSE 0 END AS secs,
        CASE WHEN k % 3 > 0 THEN frame // {ROUND_FRAMES} + 1 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END END AS round_num FROM rd0)"""
FOUND_SQL = f"""fr AS (SELECT fight_id, max(frame) AS frames FROM ev GROUP BY fight_id), dt AS (SELECT fight_id, frame, max(k) AS k FROM ev WHERE source = 'label' AND k >= 60 GROUP BY ALL),
    dr AS (SELECT fight_id, frame AS start_frame, greatest(frame, least(frame + k * 60, coalesce(lead(frame) OVER (PARTITION BY fight_id ORDER BY frame) - 1, frame + k * 60))) AS end_frame FROM dt)"""
CLOCK_SQL = "ck AS (SELECT *, (fight_id + round_number) % 2 = 0 AS start_anchored, fight_id % 3 > 0 AS end_anchored, 5 + (fight_id + 3 * round_number) % 20 AS support FROM rounds WHERE fight_id % 4 > 0)"


def readings(m) -> DataFrame:
    """One a frame: fight_id, frame, k, secs, round_num (null: not read)."""
    f, k = F.col("frame"), F.col("k")
    t = m.events.groupBy("fight_id", "frame").agg(F.max("k").alias("k"))
    secs = F.lit(300) - F.floor(f % ROUND_FRAMES / FPS) + F.when(k % 10 == 7, 45).otherwise(0)
    num = F.floor(f / ROUND_FRAMES) + 1 + F.when(k % 17 == 0, 1).otherwise(0)
    return t.select("fight_id", "frame", "k", secs.alias("secs"), F.when(k % 3 > 0, num).alias("round_num"))


def lengths(m) -> DataFrame:
    return m.events.groupBy("fight_id").agg(F.max("frame").alias("frames"))


def found_rounds(m) -> DataFrame:
    """Rounds as a detector might cut them: many, some short, never overlapping."""
    t = m.events.where("source = 'label' and k >= 60").groupBy("fight_id", "frame").agg(F.max("k").alias("k"))
    end = F.expr("greatest(frame, least(frame + k * 60, coalesce(lead(frame) over (partition by fight_id order by frame) - 1, frame + k * 60)))")
    return t.select("fight_id", F.col("frame").alias("start_frame"), end.alias("end_frame"))


def clock_rounds(m) -> DataFrame:
    f, n = F.col("fight_id"), F.col("round_number")
    return m.rounds.where("fight_id % 4 > 0").withColumns({"start_anchored": (f + n) % 2 == 0, "end_anchored": f % 3 > 0, "support": 5 + (f + 3 * n) % 20})


# ---------------------------------------------------------------- readings

RUN_SQL = READ_SQL + f""", nw AS (SELECT *, coalesce(round_num <> lag(round_num) OVER w, false) OR coalesce(secs - lag(secs) OVER w > {RESET_JUMP}, false) AS new FROM rd WINDOW w AS (PARTITION BY fight_id ORDER BY frame)),
    rn AS (SELECT *, 1 + sum(new::INT) OVER (PARTITION BY fight_id ORDER BY frame)::BIGINT AS run FROM nw)"""


@query("W-10", RUN_SQL + " SELECT fight_id, run, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM rn GROUP BY ALL")
def _(m):
    t = clock.split_runs(readings(m), "fight_id")
    return t.groupBy("fight_id", "run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n"))


@query(
    "M-09",
    RUN_SQL
    + f""", iv AS (SELECT fight_id, run, secs * {FPS} + frame AS v FROM rn), md AS (SELECT fight_id, run, median(v) AS c FROM iv GROUP BY ALL), nr AS (SELECT *, abs(v - c) <= {MAX_RESIDUAL * FPS} AS near FROM iv JOIN md USING (fight_id, run))
    SELECT fight_id, run, round(coalesce(median(v) FILTER (WHERE near), any_value(c)) / {FPS}, 6) AS intercept, count(*) FILTER (WHERE near) AS inliers, count(*) FILTER (WHERE NOT near) AS rejected FROM nr GROUP BY fight_id, run""",
)
def _(m):
    return fits(m).select("fight_id", "run", "intercept", "inliers", "rejected")


def fits(m) -> DataFrame:
    return clock.fit_intercepts(clock.split_runs(readings(m), "fight_id"), FPS, "fight_id")


@query(
    "M-11",
    RUN_SQL
    + f""", iv AS (SELECT fight_id, run, secs, secs * {FPS} + frame AS v FROM rn), md AS (SELECT fight_id, run, median(v) AS c FROM iv GROUP BY ALL), fr AS (SELECT fight_id, max(frame) AS frames FROM ev GROUP BY fight_id),
    nr AS (SELECT fight_id, run, median(v) AS c, count(*) AS support, max(secs) AS hi, min(secs) AS lo FROM iv JOIN md USING (fight_id, run) WHERE abs(v - md.c) <= {MAX_RESIDUAL * FPS} GROUP BY fight_id, run HAVING count(*) >= {clock.MIN_SAMPLES}),
    le AS (SELECT *, CASE WHEN hi <= 200 THEN 180 WHEN hi <= 320 THEN 300 ELSE hi END AS length FROM nr JOIN fr USING (fight_id)),
    bd AS (SELECT *, greatest(1, round_even(c - length * {FPS}, 0)::BIGINT) AS start_frame, least(frames, round_even(c, 0)::BIGINT) AS end_frame FROM le)
    SELECT fight_id, run, start_frame, end_frame, length, support, hi >= length - {clock.LENGTH_TOLERANCE} AS start_anchored, lo <= {clock.LENGTH_TOLERANCE} AS end_anchored FROM bd WHERE end_frame > start_frame""",
)
def _(m):
    return clock.rounds_of_fits(fits(m), lengths(m), FPS, "fight_id")


@query(
    "W-11",
    READ_SQL
    + f""", nb AS (SELECT *, round_num IS DISTINCT FROM lag(round_num) OVER (PARTITION BY fight_id ORDER BY frame) AS new FROM rd WHERE round_num IS NOT NULL),
    nn AS (SELECT *, sum(new::INT) OVER (PARTITION BY fight_id ORDER BY frame) AS run FROM nb), isl AS (SELECT fight_id, run, any_value(round_num) AS num, min(frame) AS first, count(*) AS n FROM nn GROUP BY fight_id, run)
    SELECT fight_id, frame, round_num FROM (
        WITH RECURSIVE acc AS (
            SELECT fight_id, first AS frame, num AS round_num, true AS base FROM isl WHERE run = 1
            UNION ALL
            SELECT a.fight_id, min(i.first), a.round_num + 1, false FROM acc a JOIN isl i ON i.fight_id = a.fight_id AND i.num = a.round_num + 1 AND i.first > a.frame AND i.n >= {CONFIRM} GROUP BY a.fight_id, a.round_num
        ) SELECT * FROM acc) WHERE NOT base""",
)
def _(m):
    return clock.confirmed_increments(readings(m), "fight_id")


@query(
    "W-12",
    READ_SQL
    + f""", oi AS (SELECT fight_id, round_num, frame, secs, row_number() OVER w AS i, secs - lag(secs) OVER w AS d FROM rd WHERE round_num IS NOT NULL WINDOW w AS (PARTITION BY fight_id, round_num ORDER BY frame)),
    dn AS (SELECT fight_id, round_num, CASE WHEN count(*) FILTER (WHERE d < 0) >= count(*) FILTER (WHERE d > 0) THEN 1 ELSE -1 END AS way FROM oi GROUP BY ALL), od AS (SELECT * FROM oi JOIN dn USING (fight_id, round_num))
    SELECT fight_id, round_num, frame, secs, rejected FROM (
        WITH RECURSIVE acc AS (
            SELECT fight_id, round_num, frame, secs, i, secs AS last, false AS rejected FROM od WHERE i = 1
            UNION ALL
            SELECT o.fight_id, o.round_num, o.frame, o.secs, o.i, CASE WHEN (o.secs - a.last) * way > {MAX_BACKWARD} THEN a.last ELSE o.secs END, (o.secs - a.last) * way > {MAX_BACKWARD} FROM acc a JOIN od o ON o.fight_id = a.fight_id AND o.round_num = a.round_num AND o.i = a.i + 1
        ) SELECT * FROM acc)""",
)
def _(m):
    return clock.monotone(readings(m).where("round_num is not null"), "fight_id", "round_num").select("fight_id", "round_num", "frame", "secs", "rejected")


@query("A-38", READ_SQL + " SELECT fight_id, count(*) AS samples, round(count(*) FILTER (WHERE k % 4 > 0) / count(*), 6) AS timer_coverage, round(count(*) FILTER (WHERE round_num IS NOT NULL AND k % 5 > 0) / count(*), 6) AS round_coverage FROM rd GROUP BY fight_id")
def _(m):
    return coverage(ocr_samples(m))


def ocr_samples(m) -> DataFrame:
    return readings(m).select("fight_id", F.when(F.col("k") % 4 > 0, F.col("secs")).alias("secs"), "round_num", F.when(F.col("k") % 5 == 0, "low_confidence").alias("parse_error"))


def coverage(samples: DataFrame) -> DataFrame:
    """Shares of samples with a time, and with a number that was read, not only
    carried over by smoothing."""
    n = F.count(F.lit(1))
    genuine = F.col("round_num").isNotNull() & ~F.col("parse_error").eqNullSafe("low_confidence")
    return samples.groupBy("fight_id").agg(n.alias("samples"), F.round(F.count("secs") / n, 6).alias("timer_coverage"), F.round(F.count_if(genuine) / n, 6).alias("round_coverage"))


# ---------------------------------------------------------------- round lists

PLAUSIBLE_SQL = FOUND_SQL + f""", k6 AS (SELECT * FROM (SELECT *, lead(start_frame) OVER (PARTITION BY fight_id ORDER BY start_frame) AS nx FROM dr) WHERE nx IS NULL OR end_frame - start_frame + 1 >= {MIN_INTERIOR * FPS}),
    g6 AS (SELECT fight_id, start_frame, end_frame, start_frame - lag(end_frame) OVER (PARTITION BY fight_id ORDER BY start_frame) AS gap FROM k6), a6 AS (SELECT *, coalesce(gap >= {MIN_BREAK * FPS}, false) AS apart FROM g6),
    o6 AS (SELECT a6.*, 1 + sum(apart::INT) OVER (PARTITION BY fight_id) - greatest(1, floor((frames / {FPS} + {MIN_BREAK}) / {MIN_INTERIOR + MIN_BREAK})) AS excess, row_number() OVER (PARTITION BY fight_id, apart ORDER BY gap, start_frame) AS rk FROM a6 JOIN fr USING (fight_id)),
    n6 AS (SELECT *, sum((apart AND rk > excess)::INT) OVER (PARTITION BY fight_id ORDER BY start_frame) AS rno FROM o6), pl AS (SELECT fight_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM n6 GROUP BY fight_id, rno)"""
RECONCILED_SQL = PLAUSIBLE_SQL + f""", {CLOCK_SQL}, ov AS (SELECT ck.*, (SELECT min(start_frame) FROM pl p WHERE p.fight_id = ck.fight_id AND p.end_frame >= ck.start_frame AND p.start_frame <= ck.end_frame) AS s, (SELECT max(end_frame) FROM pl p WHERE p.fight_id = ck.fight_id AND p.end_frame >= ck.start_frame AND p.start_frame <= ck.end_frame) AS e FROM ck),
    cl AS (SELECT fight_id, greatest(1, CASE WHEN start_anchored THEN start_frame ELSE coalesce(s, start_frame) END) AS start_frame, least(frames, CASE WHEN end_anchored THEN end_frame ELSE coalesce(e, end_frame) END) AS end_frame FROM ov JOIN fr USING (fight_id)),
    rc AS (SELECT *, 'clock' AS source FROM cl WHERE end_frame > start_frame UNION ALL SELECT *, 'detection' FROM pl WHERE fight_id NOT IN (SELECT fight_id FROM cl WHERE end_frame > start_frame))"""


def plausible(m) -> DataFrame:
    return clock.plausible(found_rounds(m), lengths(m), FPS)


@query("I-06", PLAUSIBLE_SQL + " SELECT fight_id, start_frame, end_frame FROM pl")
def _(m):
    return plausible(m)


@query("I-07", RECONCILED_SQL + " SELECT fight_id, start_frame, end_frame, source FROM rc")
def _(m):
    return clock.reconciled(clock_rounds(m), plausible(m), lengths(m))


@query(
    "A-45",
    RECONCILED_SQL
    + f""", {READ_SQL}, cv AS (SELECT fight_id, count(*) FILTER (WHERE k % 4 > 0) / count(*) AS cov FROM rd GROUP BY fight_id), vi AS (SELECT fight_id, frames, frames * (fight_id % 10) // 10 AS valid_frames, cov FROM fr JOIN cv USING (fight_id)),
    ra AS (SELECT fight_id, count(*) AS n, sum(end_frame - start_frame + 1) AS length, any_value(source) AS source FROM rc GROUP BY fight_id), ca AS (SELECT fight_id, count(*) AS n_clock, count(*) FILTER (WHERE support < {clock.HEALTHY}) AS n_thin, min(support) AS worst FROM ck GROUP BY fight_id),
    re AS (SELECT *, CASE WHEN coalesce(n, 0) = 0 THEN '{clock.NO_ROUNDS}' WHEN valid_frames / frames < {clock.MIN_VALID} THEN printf('{clock.LOW_RATIO}', valid_frames / frames) WHEN length < {clock.MIN_FIGHT * FPS} THEN printf('{clock.TOO_SHORT}', length / {FPS}) ELSE '' END AS reason
        FROM vi LEFT JOIN ra USING (fight_id) LEFT JOIN ca USING (fight_id)),
    rv AS (SELECT *, CASE WHEN reason <> '' THEN '{clock.GATE_FAILED}' WHEN source <> 'clock' THEN printf('{clock.NO_CLOCK}', round_even(cov * 100, 0)::INT) WHEN n_thin > 0 THEN printf('{clock.THIN}', n_thin, n_clock, worst) ELSE '' END AS review_reason FROM re)
    SELECT fight_id, coalesce(n, 0) AS n, reason = '' AS is_valid, reason, review_reason <> '' AS needs_review, review_reason FROM rv""",
)
def _(m):
    rounds = clock.reconciled(clock_rounds(m), plausible(m), lengths(m))
    share = F.count("secs") / F.count(F.lit(1))
    videos = lengths(m).join(ocr_samples(m).groupBy("fight_id").agg(share.alias("timer_coverage")), "fight_id").withColumn("valid_frames", F.floor(F.col("frames") * (F.col("fight_id") % 10) / 10))
    return clock.verdicts(rounds, clock_rounds(m), videos, FPS)


# ---------------------------------------------------------------- smoothing

_W = "1 / (1 + 1 / (2 * pi() * {}) / dt)"


@query(
    "M-14",
    f"""pt AS (SELECT fight_id, corner, frame, arg_max(value, event_id) AS x, max(event_id) % 10 / 10 AS confidence FROM ev WHERE value IS NOT NULL GROUP BY ALL),
    su AS (SELECT *, row_number() OVER (PARTITION BY fight_id, corner ORDER BY frame) AS i, greatest(frame - lag(frame) OVER (PARTITION BY fight_id, corner ORDER BY frame), 1e-6) AS dt FROM pt WHERE confidence >= {smoothing.MIN_CONFIDENCE})
    SELECT fight_id, corner, frame, round(smooth, 6) AS smooth FROM (
        WITH RECURSIVE acc AS (
            SELECT fight_id, corner, frame, i, x::DOUBLE AS smooth, 0::DOUBLE AS speed FROM su WHERE i = 1
            UNION ALL
            SELECT fight_id, corner, frame, i, ({_W.format(f"({smoothing.MIN_CUTOFF} + {smoothing.BETA} * abs(v))")}) * x + (1 - {_W.format(f"({smoothing.MIN_CUTOFF} + {smoothing.BETA} * abs(v))")}) * before, v FROM (
                SELECT s.*, a.smooth AS before, ({_W.format(smoothing.D_CUTOFF)}) * (s.x - a.smooth) / dt + (1 - {_W.format(smoothing.D_CUTOFF)}) * a.speed AS v FROM acc a JOIN su s ON s.fight_id = a.fight_id AND s.corner = a.corner AND s.i = a.i + 1)
        ) SELECT * FROM acc)
    UNION ALL SELECT fight_id, corner, frame, round(x, 6) FROM pt WHERE confidence < {smoothing.MIN_CONFIDENCE}""",
)
def _(m):
    t = m.events.where("value is not null").groupBy("fight_id", "corner", "frame").agg(F.max_by("value", "event_id").cast("double").alias("x"), (F.max("event_id") % 10 / 10).alias("confidence"))
    return smoothing.one_euro(t, "fight_id", "corner").select("fight_id", "corner", "frame", F.round("smooth", 6).alias("smooth"))


# ---------------------------------------------------------------- joined runs

_MODE = "list_sort([{'n': -len(list_filter(l, lambda x: x.n = m)), 'p': list_position([x.n FOR x IN l], m), 'm': m} FOR m IN list_distinct([x.n FOR x IN l IF x.n IS NOT NULL])])[1].m"
MERGED_SQL = (
    RUN_SQL
    + f""", iv AS (SELECT fight_id, run, frame, secs, round_num, secs * {FPS} + frame AS v FROM rn), md AS (SELECT fight_id, run, median(v) AS c FROM iv GROUP BY ALL),
    rl0 AS (SELECT fight_id, run, list({{'s': secs, 'n': round_num, 'v': v}} ORDER BY frame) AS l FROM iv JOIN md USING (fight_id, run) WHERE abs(v - c) <= {MAX_RESIDUAL * FPS} GROUP BY ALL HAVING count(*) >= {clock.MIN_SAMPLES}),
    rl AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY run) AS i FROM rl0),
    mr AS (SELECT * FROM (WITH RECURSIVE acc AS (
        SELECT fight_id, i, run AS first, 1 AS runs, l, list_aggregate([x.v FOR x IN l], 'median') AS c FROM rl WHERE i = 1
        UNION ALL
        SELECT fight_id, i, first, runs, l, CASE WHEN joined AND len(l) < len(whole) AND len(l) > 0 THEN list_aggregate([x.v FOR x IN l], 'median') ELSE c END FROM (
            SELECT fight_id, i, joined, CASE WHEN joined THEN first ELSE run END AS first, CASE WHEN joined THEN runs + 1 ELSE 1 END AS runs, CASE WHEN joined THEN whole ELSE l END AS whole,
                   CASE WHEN joined THEN list_filter(whole, lambda x: abs(x.v - cw) <= {MAX_RESIDUAL * FPS}) ELSE l END AS l, CASE WHEN joined THEN cw ELSE cl END AS c FROM (
            SELECT a.fight_id, r.i, r.run, a.first, a.runs, r.l, a.l || r.l AS whole, list_aggregate([x.v FOR x IN a.l || r.l], 'median') AS cw, list_aggregate([x.v FOR x IN r.l], 'median') AS cl,
                   abs(list_aggregate([x.v FOR x IN r.l], 'median') - a.c) <= {MAX_RESIDUAL * FPS} AND NOT (len([1 FOR x IN a.l IF x.n IS NOT NULL]) > 0 AND len([1 FOR x IN r.l IF x.n IS NOT NULL]) > 0
                       AND list_sort(list_distinct([x.n FOR x IN a.l IF x.n IS NOT NULL])) <> list_sort(list_distinct([x.n FOR x IN r.l IF x.n IS NOT NULL]))) AS joined
            FROM acc a JOIN rl r ON r.fight_id = a.fight_id AND r.i = a.i + 1))
    ) SELECT * FROM acc)),
    mg AS (SELECT fight_id, first AS run, arg_max(runs, i) AS runs, arg_max(l, i) AS l, arg_max(c, i) AS c FROM mr GROUP BY ALL),
    mn AS (SELECT fight_id, run, runs, round(c / {FPS}, 6) AS intercept, len(l) AS inliers, list_max([x.s FOR x IN l])::DOUBLE AS highest, list_min([x.s FOR x IN l])::DOUBLE AS lowest, {_MODE}::BIGINT AS number FROM mg)"""
)


def merged(m) -> DataFrame:
    return clock.merged_runs(clock.split_runs(readings(m), "fight_id"), FPS, "fight_id")


@query("M-10", MERGED_SQL + " SELECT * FROM mn")
def _(m):
    return merged(m)


@query(
    "M-12",
    MERGED_SQL
    + """, mp AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY run) AS i FROM mn), ma AS (SELECT fight_id, arg_min(number, i) AS an, min(i) AS ai FROM mp WHERE number IS NOT NULL GROUP BY fight_id)
    SELECT fight_id, run, coalesce(number, CASE WHEN an IS NOT NULL THEN greatest(1, an + i - ai) END, i)::BIGINT AS round_number, number IS NOT NULL AS numbered FROM mp LEFT JOIN ma USING (fight_id)""",
)
def _(m):
    return clock.numbered_rounds(merged(m), "fight_id").select("fight_id", "run", "round_number", "numbered")


# ---------------------------------------------------------------- the scoreboard's place

BOARD_SQL = """cb AS (SELECT fight_id, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS no, CASE WHEN k % 3 = 0 THEN 'round' ELSE 'timer' END AS kind,
    (CASE WHEN k % 7 = 0 THEN 300 ELSE 100 END + event_id % 23)::DOUBLE AS x1, (600 + k % 13)::DOUBLE AS y1, (CASE WHEN k % 7 = 0 THEN 300 ELSE 100 END + event_id % 23 + 20 + k % 9)::DOUBLE AS x2, (610 + k % 13 + event_id % 5)::DOUBLE AS y2 FROM ev)"""
CLUSTER_SQL = (
    BOARD_SQL
    + """, ct AS (SELECT fight_id, kind, greatest(1, median(x2 - x1)) AS tx, greatest(1, median(y2 - y1)) AS ty FROM cb GROUP BY ALL),
    ci AS (SELECT cb.*, tx, ty, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY fight_id, kind ORDER BY no) AS i FROM cb JOIN ct USING (fight_id, kind)),
    cl AS (SELECT * FROM (WITH RECURSIVE acc AS (
        SELECT fight_id, kind, 0::BIGINT AS i, 0::BIGINT AS no, []::STRUCT(x DOUBLE, y DOUBLE, n INT)[] AS cs, 0::BIGINT AS p FROM ct
        UNION ALL
        SELECT fight_id, kind, i, no, CASE WHEN p <= len(cs) THEN [CASE WHEN j = p THEN {'x': cs[j].x + cx, 'y': cs[j].y + cy, 'n': cs[j].n + 1} ELSE cs[j] END FOR j IN range(1, len(cs) + 1)] ELSE cs || [{'x': cx, 'y': cy, 'n': 1}] END, p FROM (
            SELECT c.*, a.cs, coalesce(list_min([j FOR j IN range(1, len(a.cs) + 1) IF abs(a.cs[j].x / a.cs[j].n - c.cx) <= c.tx AND abs(a.cs[j].y / a.cs[j].n - c.cy) <= c.ty]), len(a.cs) + 1) AS p
            FROM acc a JOIN ci c ON c.fight_id = a.fight_id AND c.kind = a.kind AND c.i = a.i + 1)
    ) SELECT fight_id, kind, no, p - 1 AS cluster FROM acc WHERE i > 0))"""
)


def board_boxes(m) -> DataFrame:
    """fight_id, no, kind, x1, y1, x2, y2."""
    k, e = F.col("k"), F.col("event_id")
    t = m.events.withColumn("no", F.row_number().over(Window.partitionBy("fight_id").orderBy("frame", "event_id")))
    x = F.when(k % 7 == 0, 300).otherwise(100) + e % 23
    box = {"x1": x, "y1": k % 13 + 600, "x2": x + 20 + k % 9, "y2": k % 13 + 610 + e % 5}
    return t.select("fight_id", "no", F.when(k % 3 == 0, "round").otherwise("timer").alias("kind"), *(c.cast("double").alias(n) for n, c in box.items()))


@query("M-08", CLUSTER_SQL + " SELECT fight_id, kind, no, cluster::INT AS cluster FROM cl")
def _(m):
    return calibration.clustered(board_boxes(m), "fight_id", "kind").select("fight_id", "kind", "no", "cluster")


@query(
    "A-46",
    CLUSTER_SQL
    + f""", cn AS (SELECT fight_id, kind, cluster, count(*) AS n FROM cl GROUP BY ALL), cw AS (SELECT fight_id, kind, arg_max(cluster, n * 1000000 - cluster) AS cluster FROM cn GROUP BY ALL),
    ca AS (SELECT fight_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM cb JOIN cl USING (fight_id, kind, no) JOIN cw USING (fight_id, kind, cluster) GROUP BY fight_id), {READ_SQL},
    cs AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY fight_id) AS n FROM rd),
    cr AS (SELECT fight_id, count(*) FILTER (WHERE k % 4 > 1) / count(*) AS match_rate FROM cs WHERE list_contains([(j * n) // least({calibration.TRIED}, n) FOR j IN range(least({calibration.TRIED}, n))], i) GROUP BY fight_id)
    SELECT fight_id, greatest(0, x1 - {calibration.PADDING}) AS x, greatest(0, y1 - {calibration.PADDING}) AS y, least(1280, x2 + {calibration.PADDING}) - greatest(0, x1 - {calibration.PADDING}) AS w, least(620, y2 + {calibration.PADDING}) - greatest(0, y1 - {calibration.PADDING}) AS h,
        match_rate, match_rate >= {calibration.MIN_RATE} AS accepted FROM ca JOIN cr USING (fight_id)""",
)
def _(m):
    samples = readings(m).select("fight_id", "frame", (F.col("k") % 4 > 1).alias("reads"))
    return calibration.region(board_boxes(m), samples, m.fights.select("fight_id", F.lit(1280.0).alias("width"), F.lit(620.0).alias("height")))
