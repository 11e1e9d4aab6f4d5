"""Scoped statistics, pace, tallies and what the dashboards derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.vocabulary import FAMILIES, LABEL_FAMILY, STATE_MARK, STATES, half_up, lookup, sql_list, sql_lookup
from spanframe.operators import stats
from spanframe.operators.asof import asof
from spanframe.plans.events import LANDED_SQL, STRIKE_SQL, ZONE_SQL
from spanframe.operators.segmentation import number_rows
from spanframe.plans.registry import query
from spanframe.sources.testdata import FPS, FRAMES

LIVE = 20_000
#: A scope's seconds are bounded by the fight's length.
SECONDS = FRAMES / FPS

MARKS_SQL = f"marks AS (SELECT fight_id, frame, arg_max({sql_lookup(STATE_MARK, 'action')}, event_id) AS mark_state FROM ev WHERE source = 'label' AND {sql_lookup(STATE_MARK, 'action')} IS NOT NULL GROUP BY fight_id, frame)"
SIDE_SQL = "CASE WHEN corner = 0 THEN 'red' ELSE 'blue' END"
SCOPES_SQL = f"""scopes AS (
        SELECT fight_id, 'fight' AS scope, 0 AS start_frame, NULL::BIGINT AS end_frame FROM fights
        UNION ALL SELECT fight_id, 'live', 0, {LIVE} FROM fights
        UNION ALL SELECT fight_id, 'round ' || round_number, start_frame, end_frame FROM rounds
    )"""
STATS_SQL = f"""{MARKS_SQL}, {SCOPES_SQL}, st AS (
        SELECT e.fight_id, e.frame, e.action, {SIDE_SQL} AS side, {ZONE_SQL} AS zone, {LANDED_SQL} AS landed,
               CASE WHEN action IN ('clinch_punch', 'clinch_knee') OR (source = 'label' AND action = 'knee' AND mark_state = 'CLINCH') THEN 'clinch'
                    WHEN action IN ('ground_punch', 'ground_knee') THEN 'ground' ELSE 'distance' END AS range
        FROM ev e ASOF LEFT JOIN marks m ON e.fight_id = m.fight_id AND e.frame >= m.frame
        WHERE {STRIKE_SQL} AND NOT (source = 'prediction' AND state IS NOT NULL)
    ), hits AS (
        SELECT s.fight_id, s.scope, st.side, count(*) FILTER (WHERE landed) AS sig_landed, count(*) AS sig_thrown,
               count(*) FILTER (WHERE landed AND range = 'distance' AND zone = 'head') AS head, count(*) FILTER (WHERE landed AND range = 'distance' AND zone = 'body') AS body,
               count(*) FILTER (WHERE landed AND range = 'distance' AND zone = 'leg') AS leg, count(*) FILTER (WHERE landed AND range = 'distance') AS distance,
               count(*) FILTER (WHERE landed AND range = 'clinch') AS clinch, count(*) FILTER (WHERE landed AND range = 'ground') AS ground, count(*) FILTER (WHERE action = 'knockdown') AS kd
        FROM st JOIN scopes s ON s.fight_id = st.fight_id AND st.frame >= s.start_frame AND (s.end_frame IS NULL OR st.frame <= s.end_frame) GROUP BY ALL
    ), inside AS (
        SELECT s.scope, s.end_frame, e.*, {SIDE_SQL} AS side, max(e.frame) OVER (PARTITION BY s.fight_id, s.scope) AS last
        FROM ev e JOIN scopes s ON s.fight_id = e.fight_id AND e.frame >= s.start_frame AND (s.end_frame IS NULL OR e.frame <= s.end_frame)
    ), change AS (
        SELECT *, row_number() OVER (PARTITION BY fight_id, scope ORDER BY frame, event_id) AS i FROM inside WHERE source = 'prediction' AND state IS NOT NULL
    ), opened AS (
        SELECT c.*, c.state = 'GROUND' AND coalesce(p.state, '') <> 'GROUND' AS opens,
               (SELECT min(n.frame) FROM change n WHERE n.fight_id = c.fight_id AND n.scope = c.scope AND n.i > c.i AND n.state <> 'GROUND') AS closed
        FROM change c LEFT JOIN change p ON p.fight_id = c.fight_id AND p.scope = c.scope AND p.i = c.i - 1
    ), ctrl AS (
        SELECT fight_id, scope, side, floor(round(coalesce(sum((coalesce(closed, end_frame, last) - frame) / {FPS}) FILTER (WHERE opens), 0), 6) + 0.5)::BIGINT AS control_secs,
               count(*) FILTER (WHERE action = 'takedown_initiated') AS takedowns
        FROM opened GROUP BY ALL
    ), stats AS (
        SELECT s.fight_id, s.scope, d.side, coalesce(sig_landed, 0) AS sig_landed, coalesce(sig_thrown, 0) AS sig_thrown, coalesce(head, 0) AS head, coalesce(body, 0) AS body,
               coalesce(leg, 0) AS leg, coalesce(distance, 0) AS distance, coalesce(clinch, 0) AS clinch, coalesce(ground, 0) AS ground, coalesce(kd, 0) AS kd,
               coalesce(control_secs, 0) AS control_secs, coalesce(takedowns, 0) AS takedowns,
               CASE WHEN sig_thrown > 0 THEN floor(sig_landed / sig_thrown * 100 + 0.5)::BIGINT ELSE 0 END AS acc
        FROM scopes s CROSS JOIN (VALUES ('red'), ('blue')) d(side)
        LEFT JOIN hits h ON h.fight_id = s.fight_id AND h.scope = s.scope AND h.side = d.side
        LEFT JOIN ctrl c ON c.fight_id = s.fight_id AND c.scope = s.scope AND c.side = d.side
    )"""


def _stats(m) -> DataFrame:
    return stats.scoped_stats(m.events, m.fights, stats.scopes_of(m.fights, m.rounds, LIVE))


@query("A-01", STATS_SQL + " SELECT * FROM stats")
def _(m):
    return _stats(m)


@query("A-02", STATS_SQL + " SELECT fight_id, scope, side, control_secs, takedowns FROM ctrl")
def _(m):
    return stats.control(m.events, m.fights, stats.scopes_of(m.fights, m.rounds, LIVE))


@query("ST-06_batch", STATS_SQL + " SELECT fight_id, side, sig_landed, sig_thrown, acc FROM stats WHERE scope = 'live'")
def _(m):
    live = stats.scopes_of(m.fights, m.rounds, LIVE).where("scope = 'live'")
    return stats.scoped_stats(m.events, m.fights, live).select("fight_id", "side", "sig_landed", "sig_thrown", "acc")


@query(
    "A-03",
    f"""n AS (
        SELECT f.fight_id, greatest(2, ceil(greatest({SECONDS}, coalesce(max(e.frame / f.fps), 0)) / 30))::INT AS n FROM fights f LEFT JOIN ev e USING (fight_id) GROUP BY f.fight_id
    ), h AS (
        SELECT fight_id, least(n - 1, floor(frame / {FPS} / 30))::INT AS bucket, {SIDE_SQL} AS side FROM ev JOIN n USING (fight_id) WHERE {STRIKE_SQL} AND {LANDED_SQL}
    )
    SELECT n.fight_id, b::INT AS bucket, count(*) FILTER (WHERE side = 'red') AS red, count(*) FILTER (WHERE side = 'blue') AS blue
    FROM n CROSS JOIN range(0, 10000) r(b) LEFT JOIN h ON h.fight_id = n.fight_id AND h.bucket = r.b WHERE b < n GROUP BY ALL""",
)
def _(m):
    return stats.pace(m.events, m.fights, SECONDS)


def round_bins(events: DataFrame, fights: DataFrame, rounds: DataFrame, seconds: int) -> DataFrame:
    """Labelled strikes of each corner in bins of ``seconds`` inside each round; the
    last bin ends with its round."""
    step = F.col("fps") * seconds
    r = rounds.join(fights.select("fight_id", "fps"), "fight_id")
    grid = r.select("fight_id", "round_number", F.explode(F.sequence(F.lit(0), F.floor((F.col("end_frame") - F.col("start_frame")) / step).cast("int"))).alias("bin"), (F.col("start_frame") + F.col("bin") * step).alias("first"), F.least(F.col("start_frame") + (F.col("bin") + 1) * step - 1, F.col("end_frame")).alias("last"))
    hit = events.where((F.col("source") == "label") & stats.is_strike(F.col("action"))).join(r, "fight_id").where(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    hit = hit.withColumn("bin", F.floor((F.col("frame") - F.col("start_frame")) / step).cast("int"))
    n = hit.groupBy("fight_id", "round_number", "bin").agg(F.count_if(F.col("corner") == 0).alias("red"), F.count_if(F.col("corner") == 1).alias("blue"))
    return grid.join(n, ["fight_id", "round_number", "bin"], "left").fillna(0, ["red", "blue"])


@query(
    "A-04",
    f"""grid AS (SELECT r.*, b::INT AS bin, start_frame + b * 500 AS first, least(start_frame + b * 500 + 499, end_frame) AS last FROM rounds r, range(0, 1000) t(b) WHERE start_frame + b * 500 <= end_frame)
    SELECT g.fight_id, g.round_number, g.bin, g.first, g.last, count(*) FILTER (WHERE e.corner = 0) AS red, count(*) FILTER (WHERE e.corner = 1) AS blue
    FROM grid g LEFT JOIN (SELECT * FROM ev WHERE source = 'label' AND {STRIKE_SQL}) e ON e.fight_id = g.fight_id AND e.frame BETWEEN g.first AND g.last GROUP BY ALL""",
)
def _(m):
    return round_bins(m.events, m.fights, m.rounds, 10)


@query(
    "A-05",
    f"""t AS (SELECT {sql_lookup(LABEL_FAMILY, "action")} AS family, corner, coalesce((SELECT min(round_number) FROM rounds r WHERE r.fight_id = ev.fight_id AND ev.frame BETWEEN r.start_frame AND r.end_frame), 0) AS round_number FROM ev WHERE source = 'label')
    SELECT round_number, family, count(*) FILTER (WHERE corner = 0) AS red, count(*) FILTER (WHERE corner = 1) AS blue, count(*) AS total FROM t WHERE family IS NOT NULL GROUP BY ALL""",
)
def _(m):
    r = m.rounds
    t = m.events.where("source = 'label'").withColumn("family", lookup(LABEL_FAMILY, "action")).where("family is not null")
    t = t.join(r, (t.fight_id == r.fight_id) & t.frame.between(r.start_frame, r.end_frame), "left").select("family", "corner", F.coalesce("round_number", F.lit(0)).alias("round_number"))
    return t.groupBy("round_number", "family").agg(F.count_if(F.col("corner") == 0).alias("red"), F.count_if(F.col("corner") == 1).alias("blue"), F.count(F.lit(1)).alias("total"))


@query("A-06", f"SELECT fight_id, least(23, floor(frame / {FRAMES} * 24))::INT AS bucket, count(*) AS n FROM ev WHERE source = 'label' AND {STRIKE_SQL} GROUP BY ALL")
def _(m):
    t = m.events.where((F.col("source") == "label") & stats.is_strike(F.col("action")))
    return t.groupBy("fight_id", F.least(F.lit(23), F.floor(F.col("frame") / FRAMES * 24)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sides(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows per side made columns red_* and blue_*."""
    pick = lambda side, v: F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side}_{v}")
    return table.groupBy(*keys).agg(*(pick(s, v) for s in ("red", "blue") for v in values))


def summary_tiles(scoped: DataFrame) -> DataFrame:
    """Combined accuracy, who leads in control and by which share, knockdowns."""
    t = sides(scoped, ["fight_id", "scope"], ["sig_landed", "sig_thrown", "control_secs", "kd"])
    c = F.col
    thrown, ctrl, kd = c("red_sig_thrown") + c("blue_sig_thrown"), c("red_control_secs") + c("blue_control_secs"), c("red_kd") + c("blue_kd")
    landed = c("red_sig_landed") + c("blue_sig_landed")
    return t.select(
        "fight_id",
        "scope",
        landed.alias("sig_landed"),
        F.when(thrown > 0, half_up(landed / thrown * 100)).otherwise(F.lit(0).cast("long")).alias("combined_acc"),
        F.when(c("red_control_secs") >= c("blue_control_secs"), "red").otherwise("blue").alias("control_leader"),
        F.when(ctrl > 0, half_up(F.greatest("red_control_secs", "blue_control_secs") / ctrl * 100)).otherwise(F.lit(0).cast("long")).alias("control_share"),
        kd.alias("kd_total"),
        F.when(kd > 0, F.when(c("red_kd") > c("blue_kd"), "red").otherwise("blue")).alias("kd_leader"),
    )


PAIRS_SQL = """, pairs AS (
        SELECT r.fight_id, r.scope, r.sig_landed AS rl, b.sig_landed AS bl, r.sig_thrown + b.sig_thrown AS thrown, r.control_secs AS rc, b.control_secs AS bc, r.kd AS rk, b.kd AS bk
        FROM stats r JOIN stats b ON b.fight_id = r.fight_id AND b.scope = r.scope WHERE r.side = 'red' AND b.side = 'blue'
    )"""


@query(
    "A-41",
    STATS_SQL
    + PAIRS_SQL
    + """ SELECT fight_id, scope, rl + bl AS sig_landed, CASE WHEN thrown > 0 THEN floor((rl + bl) / thrown * 100 + 0.5)::BIGINT ELSE 0 END AS combined_acc,
        CASE WHEN rc >= bc THEN 'red' ELSE 'blue' END AS control_leader, CASE WHEN rc + bc > 0 THEN floor(greatest(rc, bc) / (rc + bc) * 100 + 0.5)::BIGINT ELSE 0 END AS control_share,
        rk + bk AS kd_total, CASE WHEN rk + bk > 0 THEN CASE WHEN rk > bk THEN 'red' ELSE 'blue' END END AS kd_leader FROM pairs""",
)
def _(m):
    return summary_tiles(_stats(m))


def summary_text(scoped: DataFrame) -> DataFrame:
    """One sentence per fight and scope; red and blue stand for the names."""
    t = sides(scoped, ["fight_id", "scope"], ["sig_landed", "sig_thrown", "control_secs", "kd"])
    c = F.col
    red, blue = c("red_sig_landed"), c("blue_sig_landed")
    lead = lambda first: F.when(first, "red").otherwise("blue")
    landed = F.when(red != blue, F.format_string("%s out-landed the opponent %d–%d in significant strikes", lead(red > blue), F.greatest(red, blue), F.least(red, blue))).otherwise(
        F.format_string("red and blue landed an even %d significant strikes apiece", red)
    )
    ctrl = F.when(c("red_control_secs") + c("blue_control_secs") > 0, F.format_string("%s controlled %d min of mat time", lead(c("red_control_secs") >= c("blue_control_secs")), half_up(F.greatest("red_control_secs", "blue_control_secs") / 60)))
    kd = F.when(c("red_kd") + c("blue_kd") > 0, F.concat(lead(c("red_kd") > c("blue_kd")), F.lit(" scored the only knockdown")))
    none = c("red_sig_thrown") + c("blue_sig_thrown") == 0
    return t.select("fight_id", "scope", F.when(none, "No strikes logged yet for this scope.").otherwise(F.concat(F.concat_ws(". ", landed, ctrl, kd), F.lit("."))).alias("summary"))


@query(
    "A-42",
    STATS_SQL
    + PAIRS_SQL
    + """ SELECT fight_id, scope, CASE WHEN thrown = 0 THEN 'No strikes logged yet for this scope.' ELSE concat_ws('. ',
            CASE WHEN rl <> bl THEN (CASE WHEN rl > bl THEN 'red' ELSE 'blue' END) || ' out-landed the opponent ' || greatest(rl, bl) || '–' || least(rl, bl) || ' in significant strikes'
                 ELSE 'red and blue landed an even ' || rl || ' significant strikes apiece' END,
            CASE WHEN rc + bc > 0 THEN (CASE WHEN rc >= bc THEN 'red' ELSE 'blue' END) || ' controlled ' || floor(greatest(rc, bc) / 60 + 0.5)::BIGINT || ' min of mat time' END,
            CASE WHEN rk + bk > 0 THEN (CASE WHEN rk > bk THEN 'red' ELSE 'blue' END) || ' scored the only knockdown' END) || '.' END AS summary FROM pairs""",
)
def _(m):
    return summary_text(_stats(m))


# ---------------------------------------------------------------- labels by state and family


def strikes_by_state(events: DataFrame) -> DataFrame:
    """Labelled strikes by family and by the labelled state at their frame (NONE
    before the first mark), and the same over all families as ``overall``."""
    labels = events.where("source = 'label'")
    marks = labels.withColumn("mark_state", lookup(STATE_MARK, "action")).where("mark_state is not null")
    hit = labels.withColumn("family", lookup(LABEL_FAMILY, "action")).where("family is not null")
    t = asof(hit.select("fight_id", "event_id", "frame", "family"), marks, ["mark_state"])
    state = F.coalesce("mark_state", F.lit("NONE"))
    n = [F.count_if(state == s).alias(s.lower()) for s in (*STATES, "NONE")]
    return t.rollup("family").agg(*n, F.count(F.lit(1)).alias("total")).withColumn("family", F.coalesce("family", F.lit("overall")))


@query(
    "A-30",
    f"""{MARKS_SQL}, s AS (
        SELECT {sql_lookup(LABEL_FAMILY, "action")} AS family, coalesce(m.mark_state, 'NONE') AS st FROM (SELECT * FROM ev WHERE source = 'label') e ASOF LEFT JOIN marks m ON e.fight_id = m.fight_id AND e.frame >= m.frame
    )
    SELECT coalesce(family, 'overall') AS family, count(*) FILTER (WHERE st = 'STRIKING') AS striking, count(*) FILTER (WHERE st = 'CLINCH') AS clinch, count(*) FILTER (WHERE st = 'GROUND') AS ground,
           count(*) FILTER (WHERE st = 'NONE') AS none, count(*) AS total FROM s WHERE family IS NOT NULL GROUP BY ROLLUP (family)""",
)
def _(m):
    return strikes_by_state(m.events)


def _families(spark) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, FAMILIES))).alias("place", "family"))


def displayed_corner(events: DataFrame, swaps: DataFrame) -> DataFrame:
    """Add ``display_corner``: flipped where the frame lies in a swap span."""
    s = swaps.select("fight_id", "start_frame", "end_frame")
    hit = events.join(s, (events.fight_id == s.fight_id) & (events.frame >= s.start_frame) & (s.end_frame.isNull() | (events.frame <= s.end_frame)), "left_semi").select("event_id", F.lit(True).alias("_swapped")).distinct()
    t = events.join(hit, "event_id", "left")
    return t.withColumn("display_corner", F.when(F.col("_swapped"), 1 - F.col("corner")).otherwise(F.col("corner"))).drop("_swapped")


SHOWN_SQL = "shown AS (SELECT *, CASE WHEN EXISTS (FROM swaps s WHERE s.fight_id = ev.fight_id AND ev.frame BETWEEN s.start_frame AND s.end_frame) THEN 1 - corner ELSE corner END AS dc FROM ev WHERE source = 'label')"


@query("I-15", SHOWN_SQL + " SELECT event_id, fight_id, frame, corner, dc AS display_corner FROM shown")
def _(m):
    return displayed_corner(m.events.where("source = 'label'"), m.swaps).select("event_id", "fight_id", "frame", "corner", "display_corner")


def corner_counts(labels: DataFrame, value: str) -> DataFrame:
    return labels.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("display_corner") == 0).alias("red"), F.count_if(F.col("display_corner") == 1).alias("blue"))


#: Palette of label actions that name a fighter, with their groups.
PALETTE = {a: "Strikes" for a in ("jab", "cross", "left_hook", "right_hook", "left_uppercut", "right_uppercut", "left_elbow", "right_elbow", "calf_kick", "low_kick", "middle_kick", "high_kick", "knee")}
PALETTE |= {a: "Ground & pound" for a in ("clinch_punch", "ground_punch", "ground_knee")}
PALETTE |= {a: "Grappling" for a in ("takedown_attempt", "takedown_landed", "takedown_defended", "submission_attempt")}
PALETTE |= {"knockdown": "Outcome", "state_striking": "Fight state", "state_clinch": "Fight state", "state_ground": "Fight state"}
#: Palette actions without a clip to learn from.
NOT_TRAINED = ("takedown_attempt", "takedown_defended", "submission_attempt", "knockdown", "state_striking", "state_clinch", "state_ground")
LEGACY = ("elbow", "clinch_knee")
TRAINED = tuple(a for a in PALETTE if a not in NOT_TRAINED) + LEGACY


def palette(spark, actions=tuple(PALETTE)) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(PALETTE.get(a, "Legacy")).alias("palette_group")) for a in actions))).alias("place", "_t")).select("place", "_t.*")


def palette_sql(actions=tuple(PALETTE)) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{a}', '{PALETTE.get(a, 'Legacy')}')" for i, a in enumerate(actions)) + ") p(place, action, palette_group)"


@query(
    "A-27",
    SHOWN_SQL + f" SELECT p.place, p.palette_group, p.action, count(s.event_id) AS n, count(*) FILTER (WHERE dc = 0) AS red, count(*) FILTER (WHERE dc = 1) AS blue FROM {palette_sql()} LEFT JOIN shown s ON s.action = p.action GROUP BY ALL",
)
def _(m):
    counts = corner_counts(displayed_corner(m.events.where("source = 'label'"), m.swaps), "action")
    return palette(m.spark).join(counts, "action", "left").fillna(0).select("place", "palette_group", "action", "n", "red", "blue")


@query(
    "A-28",
    SHOWN_SQL
    + f""", f AS (SELECT *, {sql_lookup(LABEL_FAMILY, "action")} AS family FROM shown)
    SELECT d.family, count(f.event_id) AS n, count(*) FILTER (WHERE dc = 0) AS red, count(*) FILTER (WHERE dc = 1) AS blue, count(f.event_id) < 25 AS low
    FROM (SELECT unnest({list(FAMILIES)!r}) AS family) d LEFT JOIN f ON f.family = d.family GROUP BY ALL""",
)
def _(m):
    t = displayed_corner(m.events.where("source = 'label'"), m.swaps).withColumn("family", lookup(LABEL_FAMILY, "action"))
    out = _families(m.spark).join(corner_counts(t, "family"), "family", "left").fillna(0)
    return out.select("family", "n", "red", "blue", (F.col("n") < 25).alias("low"))


@query(
    "A-29",
    f"""t AS (SELECT {sql_lookup(LABEL_FAMILY, "action")} AS family, coalesce(target, 'ns') AS zone FROM ev WHERE source = 'label')
    SELECT coalesce(family, 'all') AS family, count(*) FILTER (WHERE zone = 'head') AS head, count(*) FILTER (WHERE zone = 'body') AS body, count(*) FILTER (WHERE zone = 'leg') AS leg, count(*) FILTER (WHERE zone = 'ns') AS unset
    FROM t WHERE family IS NOT NULL GROUP BY ROLLUP (family)""",
)
def _(m):
    t = m.events.where("source = 'label'").withColumn("family", lookup(LABEL_FAMILY, "action")).where("family is not null")
    n = [F.count_if(F.col("target") == z).alias(z) for z in ("head", "body", "leg")]
    return t.rollup("family").agg(*n, F.count_if(F.col("target").isNull()).alias("unset")).withColumn("family", F.coalesce("family", F.lit("all")))


@query(
    "A-31",
    f"""c AS (SELECT fight_id, coalesce({sql_lookup(LABEL_FAMILY, "action")}, action, 'other') AS family, count(*) AS n FROM ev WHERE source = 'label' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY n DESC, family)::INT AS rank FROM c)
    SELECT fight_id, rank, family, n, max(n) OVER () AS overall_max FROM r WHERE rank <= 6""",
)
def _(m):
    t = m.events.where("source = 'label'").select("fight_id", F.coalesce(lookup(LABEL_FAMILY, "action"), "action", F.lit("other")).alias("family"))
    t = t.groupBy("fight_id", "family").agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("fight_id").orderBy(F.desc("n"), "family"))).where("rank <= 6")
    most = t.agg(F.max("n").alias("overall_max"))  # one row
    return t.join(F.broadcast(most), F.lit(True)).select("fight_id", "rank", "family", "n", "overall_max")


TARGET_LABELS, MIN_EXAMPLES = 300, 25


@query(
    "A-32",
    f"""t AS (SELECT * FROM ev WHERE source = 'label' AND action IN {sql_list(TRAINED)}), f AS (SELECT fight_id, count(*) AS n FROM t GROUP BY fight_id),
    fam AS (SELECT {sql_lookup(LABEL_FAMILY, "action")} AS family, count(*) AS n FROM t GROUP BY ALL)
    SELECT (SELECT count(*) FROM t) AS have, least(100, floor((SELECT count(*) FROM t) / {TARGET_LABELS} * 100 + 0.5)::BIGINT) AS pct,
           (SELECT fight_id FROM f ORDER BY n DESC, fight_id LIMIT 1) AS largest_fight, floor((SELECT max(n) FROM f) / (SELECT count(*) FROM t) * 100 + 0.5)::BIGINT AS largest_share,
           (SELECT count(*) FROM (SELECT unnest({list(FAMILIES)!r}) AS family) d LEFT JOIN fam USING (family) WHERE coalesce(n, 0) < {MIN_EXAMPLES}) AS families_below""",
)
def _(m):
    t = m.events.where((F.col("source") == "label") & F.col("action").isin(*TRAINED)).select("fight_id", lookup(LABEL_FAMILY, "action").alias("family"))
    per_fight = t.groupBy("fight_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("have"), F.max(F.struct("n", (-F.col("fight_id")).alias("id"))).alias("top"))
    enough = t.where("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= MIN_EXAMPLES).alias("enough"))
    out = per_fight.join(F.broadcast(enough), F.lit(True))  # one row each
    return out.select("have", F.least(F.lit(100), half_up(F.col("have") / TARGET_LABELS * 100)).alias("pct"), (-F.col("top.id")).alias("largest_fight"), half_up(F.col("top.n") / F.col("have") * 100).alias("largest_share"), (F.lit(len(FAMILIES)) - F.col("enough")).alias("families_below"))


@query("A-33", "SELECT count(*) AS total, count(*) FILTER (WHERE state = 'labeling') AS in_progress, count(*) FILTER (WHERE state = 'complete') AS complete FROM fights")
def _(m):
    return m.fights.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "labeling").alias("in_progress"), F.count_if(F.col("state") == "complete").alias("complete"))


def ledger(fights: DataFrame, labels: DataFrame, rounds: DataFrame, swaps: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per fight: strikes, per minute, marks, spans and warnings."""
    e = labels.groupBy("fight_id").agg(F.count_if(F.col("action").isin(*TRAINED)).alias("strikes"), F.count_if(F.col("action").startswith("state_")).alias("state_marks"))
    r = rounds.groupBy("fight_id").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("_frames"))
    s = swaps.groupBy("fight_id").agg(F.count(F.lit(1)).alias("swaps"), F.count_if(F.col("end_frame").isNull()).alias("_open"))
    x = excluded.groupBy("fight_id").agg(F.count(F.lit(1)).alias("excluded"))
    t = fights
    for part in (e, r, s, x):
        t = t.join(part, "fight_id", "left")
    t = t.fillna(0, ["strikes", "state_marks", "_frames", "swaps", "_open", "excluded"]).withColumn("minutes", F.col("_frames") / F.col("fps") / 60)
    warnings = F.array_compact(F.array(F.when((F.col("minutes") >= 1) & (F.col("strikes") == 0) & (F.col("purpose") != "ai_labeled"), "no strikes"), F.when(F.col("_open") > 0, "open swap")))
    return t.select("fight_id", "strikes", F.round(F.when(F.col("minutes") > 0, F.col("strikes") / F.col("minutes")), 6).alias("per_min"), "state_marks", "swaps", "excluded", F.concat_ws(", ", warnings).alias("warnings"))


LEDGER_SQL = f"""led AS (
        SELECT f.fight_id, (SELECT count(*) FROM ev e WHERE e.fight_id = f.fight_id AND source = 'label' AND action IN {sql_list(TRAINED)}) AS strikes,
               (SELECT count(*) FROM ev e WHERE e.fight_id = f.fight_id AND source = 'label' AND action LIKE 'state%') AS state_marks,
               (SELECT sum(end_frame - start_frame + 1) FROM rounds r WHERE r.fight_id = f.fight_id) / {FPS} / 60 AS minutes,
               (SELECT count(*) FROM swaps s WHERE s.fight_id = f.fight_id) AS swaps, (SELECT count(*) FROM swaps s WHERE s.fight_id = f.fight_id AND s.event_id % 5 = 0) AS open_swaps,
               (SELECT count(*) FROM excluded x WHERE x.fight_id = f.fight_id) AS excluded, purpose
        FROM fights f
    ), ledger AS (
        SELECT fight_id, strikes, round(strikes / minutes, 6) AS per_min, state_marks, swaps, excluded,
               concat_ws(', ', CASE WHEN minutes >= 1 AND strikes = 0 AND purpose <> 'ai_labeled' THEN 'no strikes' END, CASE WHEN open_swaps > 0 THEN 'open swap' END) AS warnings FROM led
    )"""


def _ledger(m) -> DataFrame:
    swaps = m.swaps.withColumn("end_frame", F.when(F.col("event_id") % 5 != 0, F.col("end_frame")))
    return ledger(m.fights, m.events.where("source = 'label'"), m.rounds, swaps, m.excluded)


@query("A-34", LEDGER_SQL + " SELECT * FROM ledger")
def _(m):
    return _ledger(m)


@query("T-07", LEDGER_SQL + " SELECT fight_id, strikes, row_number() OVER (ORDER BY strikes DESC, fight_id)::INT AS place FROM ledger")
def _(m):
    # a cell for each number of strikes: only their counts are lined up in one task
    t = number_rows(_ledger(m).select("fight_id", "strikes", (-F.col("strikes")).alias("_down")), order=["_down", "fight_id"], block=1, out="place")
    return t.select("fight_id", "strikes", F.col("place").cast("int").alias("place"))


# ---------------------------------------------------------------- review of training data

VERDICT_SQL = f"qa AS (SELECT *, CASE WHEN k % 3 = 0 THEN true WHEN k % 5 = 0 THEN false END AS is_verified FROM ev WHERE source = 'label' AND action IN {sql_list(TRAINED)})"


def reviewed(events: DataFrame) -> DataFrame:
    verdict = F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 5 == 0, False)
    return events.where((F.col("source") == "label") & F.col("action").isin(*TRAINED)).withColumn("is_verified", verdict)


def class_stats(qa: DataFrame) -> DataFrame:
    """Per action: total, confirmed, declined, reviewed and pending."""
    v = F.col("is_verified")
    return qa.groupBy("action").agg(F.count(F.lit(1)).alias("total"), F.count_if(v.eqNullSafe(True)).alias("confirmed"), F.count_if(v.eqNullSafe(False)).alias("declined"), F.count_if(v.isNotNull()).alias("reviewed"), F.count_if(v.isNull()).alias("pending"))


CLASS_SQL = "cls AS (SELECT action, count(*) AS total, count(*) FILTER (WHERE is_verified) AS confirmed, count(*) FILTER (WHERE NOT is_verified) AS declined, count(is_verified) AS reviewed, count(*) FILTER (WHERE is_verified IS NULL) AS pending FROM qa GROUP BY action)"


@query("A-25", f"{VERDICT_SQL}, {CLASS_SQL} SELECT * FROM cls")
def _(m):
    return class_stats(reviewed(m.events))


@query(
    "A-26",
    f"""{VERDICT_SQL}, {CLASS_SQL}, g AS (SELECT p.place, p.action, coalesce(total, 0) AS total, coalesce(pending, 0) AS pending FROM {palette_sql(TRAINED)} LEFT JOIN cls ON cls.action = p.action WHERE palette_group <> 'Legacy' OR total > 0)
    SELECT action, total, pending, row_number() OVER (ORDER BY total = 0, pending DESC, place)::INT AS position FROM g""",
)
def _(m):
    t = palette(m.spark, TRAINED).join(class_stats(reviewed(m.events)), "action", "left").fillna(0)
    t = t.where((F.col("palette_group") != "Legacy") | (F.col("total") > 0))  # at most one row per class
    return t.select("action", "total", "pending", F.row_number().over(Window.orderBy(F.col("total") == 0, F.desc("pending"), "place")).alias("position"))


@query("F-19", f"{VERDICT_SQL} SELECT fight_id, event_id, action FROM qa WHERE is_verified IS NULL AND action = 'jab'")
def _(m):
    return reviewed(m.events).where("is_verified is null and action = 'jab'").select("fight_id", "event_id", "action")


@query(
    "F-23",
    f"""{SHOWN_SQL} SELECT s.fight_id, s.frame, s.event_id, s.action, s.dc AS display_corner FROM shown s JOIN fights f USING (fight_id)
    WHERE f.purpose = 'training_data' AND f.state IN ('labeling', 'complete') AND s.action IN {sql_list(TRAINED)}""",
)
def _(m):
    wanted = m.fights.where((F.col("purpose") == "training_data") & F.col("state").isin("labeling", "complete")).select("fight_id")
    t = m.events.where((F.col("source") == "label") & F.col("action").isin(*TRAINED)).join(wanted, "fight_id")
    return displayed_corner(t, m.swaps).select("fight_id", "frame", "event_id", "action", "display_corner")


@query(
    "W-14",
    f"""{VERDICT_SQL}, o AS (SELECT event_id, is_verified, row_number() OVER (PARTITION BY action ORDER BY fight_id, frame, event_id) AS i, action FROM qa),
    n AS (SELECT o.action, o.event_id, p.event_id AS next_id, row_number() OVER (PARTITION BY o.event_id ORDER BY p.i <= o.i, p.i) AS r
          FROM o LEFT JOIN o p ON p.action = o.action AND p.is_verified IS NULL AND p.event_id <> o.event_id)
    SELECT action, event_id, next_id FROM n WHERE r = 1""",
)
def _(m):
    return next_pending(reviewed(m.events))


def next_pending(t: DataFrame) -> DataFrame:
    """The next pending event of the class, cyclically: action, event_id, next_id. A window
    backwards, that only grows, has it at hand; one that only shrinks is filled anew for
    every row. Behind the last one comes the first of the class."""
    place = [F.col("fight_id"), F.col("frame"), F.col("event_id")]
    back = Window.partitionBy("action").orderBy(*(c.desc() for c in place))
    t = t.withColumn("_p", F.when(F.col("is_verified").isNull(), F.col("event_id")))
    t = t.withColumn("_next", F.last("_p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    first = t.where("_p is not null").groupBy("action").agg(F.min_by("_p", F.struct(*place)).alias("_first"))
    t = t.join(first, "action", "left")
    found = F.coalesce("_next", F.when(F.col("_first") != F.col("event_id"), F.col("_first")))
    return t.select("action", "event_id", found.alias("next_id"))


def placed(t: DataFrame, by: str) -> DataFrame:
    """Rows (fight_id and ``by``) with their place, highest first, then by id: cells of one
    value each are ranked apart, and only their counts are lined up."""
    return number_rows(t.withColumn("_down", -F.col(by)), order=["_down", "fight_id"], block=1, out="place").drop("_down")


@query("T-07-minutes", LEDGER_SQL + " SELECT fight_id, minutes, row_number() OVER (ORDER BY minutes DESC, fight_id) AS place FROM (SELECT fight_id, round(coalesce(minutes, 0), 6) AS minutes FROM led)")
def _(m):
    frames = m.rounds.groupBy("fight_id").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))
    t = m.fights.join(frames, "fight_id", "left").select("fight_id", F.round(F.coalesce("frames", F.lit(0)) / F.col("fps") / 60, 6).alias("minutes"))
    return placed(t, "minutes")


@query("T-07-warnings", LEDGER_SQL + " SELECT fight_id, n, row_number() OVER (ORDER BY n DESC, fight_id) AS place FROM (SELECT fight_id, len(list_filter(string_split(warnings, ', '), lambda w: w <> ''))::INT AS n FROM ledger)")
def _(m):
    n = F.size(F.filter(F.split("warnings", ", "), lambda w: w != ""))
    return placed(_ledger(m).select("fight_id", n.alias("n")), "n")
