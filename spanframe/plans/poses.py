"""Poses next to strikes and takedowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators import strikes
from spanframe.plans.machines import BOXES_SQL, people
from spanframe.plans.registry import query
from spanframe.plans.scalars import SKELETONS_SQL, skeleton

HIPS_SQL = """hp0 AS (SELECT fight_id, frame, max(k) AS k, max(event_id) AS e FROM ev GROUP BY ALL),
    hp AS (SELECT fight_id, frame, 10 + fight_id % 3 * 8 AS fps, (k % 41)::DOUBLE AS red, (e % 37)::DOUBLE AS blue, CASE WHEN k % 9 > 0 THEN 40 + k % 13 END::DOUBLE AS red_scale, CASE WHEN e % 7 > 0 THEN 45 + e % 5 END::DOUBLE AS blue_scale,
        row_number() OVER (PARTITION BY fight_id ORDER BY frame) AS n FROM hp0)"""


def hips(m) -> DataFrame:
    """fight_id, frame, fps, red, blue, red_scale, blue_scale."""
    t = m.events.groupBy("fight_id", "frame").agg(F.max("k").alias("k"), F.max("event_id").alias("e"))
    k, e = F.col("k"), F.col("e")
    columns = {"red": k % 41, "blue": e % 37, "red_scale": F.when(k % 9 > 0, 40 + k % 13), "blue_scale": F.when(e % 7 > 0, 45 + e % 5)}
    return t.select("fight_id", "frame", (F.col("fight_id") % 3 * 8 + 10).alias("fps"), *(c.cast("double").alias(n) for n, c in columns.items()))


@query(
    "M-15",
    HIPS_SQL
    + f""", hj AS (SELECT b.*, a.n AS first, (b.red - a.red) - (b.blue - a.blue) AS further, coalesce(list_avg([s FOR s IN [a.red_scale, a.blue_scale, b.red_scale, b.blue_scale] IF s IS NOT NULL]), 1) * {strikes.DROP_RATIO} AS least
        FROM hp b JOIN hp a ON a.fight_id = b.fight_id AND a.n = greatest(1, b.n - greatest(1, round_even(b.fps * {strikes.LOOKBACK_SECONDS}, 0)::INT) + 1))
    SELECT fight_id, frame, CASE WHEN first < n AND further > least THEN 'blue' WHEN first < n AND -further > least THEN 'red' END AS initiator FROM hj""",
)
def _(m):
    return strikes.initiators(hips(m)).select("fight_id", "frame", "initiator")


HEADS_SQL = """hd AS (SELECT fight_id, frame // 30 AS frame, max(k) AS k, max(event_id) AS e FROM ev GROUP BY ALL HAVING max(k) % 3 > 0),
    ht AS (SELECT fight_id, event_id, frame // 30 AS frame, (1 - corner)::INT AS defender FROM ev WHERE source = 'prediction')"""


@query(
    "M-16",
    HEADS_SQL
    + f""", hc AS (SELECT ht.*, CASE WHEN defender = 0 THEN k % 50 ELSE e % 40 END AS x, CASE WHEN defender = 0 THEN e % 30 ELSE k % 20 END AS y, CASE WHEN (k + defender) % 8 > 0 THEN k % 7 * 2 + 1 END AS scale FROM ht LEFT JOIN hd USING (fight_id, frame)),
    hl AS (SELECT hc.event_id, min(hd.frame) AS frame FROM hc JOIN hd ON hd.fight_id = hc.fight_id AND hd.frame BETWEEN hc.frame + 4 AND hc.frame + 16 GROUP BY hc.event_id)
    SELECT hc.fight_id, hc.event_id, CASE WHEN scale IS NOT NULL THEN sqrt((CASE WHEN defender = 0 THEN hd.k % 50 ELSE hd.e % 40 END - x) ** 2 + (CASE WHEN defender = 0 THEN hd.e % 30 ELSE hd.k % 20 END - y) ** 2) / 4 * 50 >= {strikes.RECOIL_RATIO} * scale END AS landed
    FROM hc LEFT JOIN hl USING (event_id) LEFT JOIN hd ON hd.fight_id = hc.fight_id AND hd.frame = hl.frame""",
)
def _(m):
    t = m.events.groupBy("fight_id", F.floor(F.col("frame") / 30).alias("frame")).agg(F.max("k").alias("k"), F.max("event_id").alias("e")).where("k % 3 > 0")
    k, e = F.col("k"), F.col("e")
    point = lambda x, y, c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.when((k + c) % 8 > 0, k % 7 * 2 + 1).cast("double").alias("scale")).alias(f"head_{c}")
    heads = t.select("fight_id", "frame", point(k % 50, e % 30, 0), point(e % 40, k % 20, 1))
    contacts = m.events.where("source = 'prediction'").select("fight_id", "event_id", F.floor(F.col("frame") / 30).alias("frame"), (1 - F.col("corner")).alias("defender"), F.lit(50).alias("fps"))
    return strikes.landed(contacts, heads).select("fight_id", "event_id", "landed")


def _mean_sql(s: str, joints) -> str:
    seen = f"[{s}[i] FOR i IN {[j + 1 for j in joints]!r} IF {s}[i][3] >= {strikes.SEEN}]"
    return f"CASE WHEN len({seen}) > 0 THEN [list_avg([j[1] FOR j IN {seen}]), list_avg([j[2] FOR j IN {seen}])] END"


def _far_sql(p: str, q: str) -> str:
    return f"sqrt(({p}[1] - {q}[1]) ** 2 + ({p}[2] - {q}[2]) ** 2)"


def _leg_sql(ends, left, right) -> str:
    a, b = (f"p[{j + 1}]" for j in ends)
    return f"CASE WHEN {b}[3] >= {strikes.SEEN} AND ({a}[3] < {strikes.SEEN} OR coalesce({_far_sql(b, 'hip')} > {_far_sql(a, 'hip')}, false)) THEN {right!r} ELSE {left!r} END"


@query(
    "M-22",
    SKELETONS_SQL
    + f""", g0 AS (SELECT ev.event_id, action, target, p, q, coalesce({_mean_sql("q", strikes.HEAD)}, {_mean_sql("q", strikes.SHOULDERS)}) AS head, {_mean_sql("q", strikes.SHOULDERS + strikes.HIPS)} AS body, {_mean_sql("q", strikes.KNEES)} AS knees,
        coalesce({_mean_sql("p", strikes.HIPS)}, {_mean_sql("p", strikes.SHOULDERS)}) AS hip FROM ev JOIN sk USING (event_id) WHERE source = 'label' AND action IS NOT NULL),
    g1 AS (SELECT *, coalesce(CASE WHEN target = 'head' THEN head WHEN target = 'leg' THEN coalesce(knees, body) ELSE body END, head) AS aim,
        CASE WHEN contains(action, 'hook') THEN 'hook' WHEN contains(action, 'uppercut') THEN 'uppercut' WHEN ends_with(action, 'kick') THEN 'kick' WHEN ends_with(action, 'knee') THEN 'knee' ELSE action END AS family FROM g0)
    SELECT event_id, family, CASE WHEN family = 'kick' THEN {_leg_sql(strikes.ANKLES, [11, 13, 15], [12, 14, 16])} WHEN family = 'knee' THEN {_leg_sql(strikes.KNEES, [11, 13], [12, 14])} WHEN starts_with(action, 'left_') THEN [5, 7, 9] WHEN starts_with(action, 'right_') THEN [6, 8, 10]
        WHEN CASE WHEN p[10][3] >= {strikes.SEEN} AND aim IS NOT NULL THEN {_far_sql("p[10]", "aim")} ELSE 1e99 END <= CASE WHEN p[11][3] >= {strikes.SEEN} AND aim IS NOT NULL THEN {_far_sql("p[11]", "aim")} ELSE 1e99 END THEN [5, 7, 9] ELSE [6, 8, 10] END AS chain FROM g1""",
)
def _(m):
    t = m.events.where("source = 'label' and action is not null").select("event_id", "k", "action", "target").withColumns({"p": skeleton(2), "q": skeleton(4)})
    return t.select("event_id", strikes.family_of(F.col("action")).alias("family"), strikes.limb(F.col("action"), F.col("target"), F.col("p"), F.col("q")).alias("chain"))


@query(
    "M-22-pose",
    BOXES_SQL
    + f""", bp0 AS (SELECT fight_id, frame, flatten(list([j[3] FOR j IN p])) AS cs FROM bx WHERE p IS NOT NULL GROUP BY ALL), bp AS (SELECT fight_id, frame, len([c FOR c IN cs IF c >= {strikes.WELL_SEEN}]) AS seen, list_min(cs) AS worst FROM bp0),
    bh AS (SELECT fight_id, event_id, frame // 300 AS s FROM ev WHERE source = 'label')
    SELECT fight_id, frame, seen, worst FROM bh JOIN bp USING (fight_id) WHERE abs(frame - s) <= {strikes.POSE_REACH} QUALIFY row_number() OVER (PARTITION BY fight_id ORDER BY seen DESC, worst DESC, s, event_id, frame) = 1""",
)
def _(m):
    poses = people(m).where("skeleton is not null").groupBy("fight_id", "frame").agg(F.collect_list("skeleton").alias("skeletons"))
    hits = m.events.where("source = 'label'").select("fight_id", "event_id", F.floor(F.col("frame") / 300).alias("frame"))
    return strikes.best_pose(hits, poses)
