"""Fights, fighters, users and messages: lists, name joins, lookups, wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import wording
from spanframe.functions.vocabulary import LABEL_FAMILY, PREDICTED_FAMILY, PREDICTED_TARGET, lookup, sql_lookup
from spanframe.plans.registry import query
from spanframe.plans.spans import LATEST_SQL, RUNS_SQL, eval_runs, latest_versions
from spanframe.sources.tables import upsert

# ---------------------------------------------------------------- adapter views

STATE_NAMES = ("completed", "labeling_in_progress", "failed", "invalid", "queued", "processing")
PEOPLE_SQL = f"""fx AS (SELECT f.fight_id, f.purpose, red_fighter_id, blue_fighter_id, {list(STATE_NAMES)!r}[fight_id % 6 + 1] AS status, '/videos/' || purpose || '/Fight #' || fight_id || '.v' || fight_id % 3 || '.MP4' AS video_path,
        CASE WHEN fight_id % 7 > 0 THEN fight_id % 20 END AS uploaded_by, CASE WHEN fight_id % 5 > 0 THEN 1000 + fight_id END AS reported, CASE WHEN fight_id % 4 > 0 THEN 1000 - fight_id % 300 END AS decoded, fight_id % 2 = 0 AS labelled FROM fights f),
    fg AS (SELECT c_custkey::BIGINT AS fighter_id, c_mktsegment AS first_name, substr(c_name, 10) || c_nationkey AS last_name, CASE WHEN c_custkey % 3 > 0 THEN 'The ' || c_nationkey END AS nickname FROM customer),
    us AS (SELECT s_suppkey::BIGINT AS user_id, '  ' || s_name || CASE WHEN s_suppkey % 4 > 0 THEN '@Example.org ' ELSE '' END AS address, s_suppkey % 3 > 0 AS active FROM supplier),
    fn AS (SELECT fx.*, r.first_name || ' ' || r.last_name AS red_name, b.first_name || ' ' || b.last_name AS blue_name FROM fx LEFT JOIN fg r ON r.fighter_id = red_fighter_id LEFT JOIN fg b ON b.fighter_id = blue_fighter_id)"""
STEM_SQL = r"regexp_replace(regexp_extract(video_path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1')"
TITLE_SQL = f"CASE WHEN red_name <> '' AND blue_name <> '' THEN red_name || ' vs ' || blue_name ELSE {STEM_SQL} END"


def fights(m) -> DataFrame:
    """Fights with status, video_path, uploaded_by, reported and decoded frames."""
    f = F.col("fight_id")
    return m.fights.select(
        "fight_id", "purpose", "red_fighter_id", "blue_fighter_id", F.element_at(F.array(*map(F.lit, STATE_NAMES)), (f % 6 + 1).cast("int")).alias("status"),
        F.concat(F.lit("/videos/"), "purpose", F.lit("/Fight #"), f, F.lit(".v"), f % 3, F.lit(".MP4")).alias("video_path"), F.when(f % 7 > 0, f % 20).alias("uploaded_by"),
        F.when(f % 5 > 0, f + 1000).alias("reported"), F.when(f % 4 > 0, 1000 - f % 300).alias("decoded"), (f % 2 == 0).alias("labelled"),
    )


def fighters(m) -> DataFrame:
    c = F.col("c_custkey").cast("long")
    return m.table("customer").select(c.alias("fighter_id"), F.col("c_mktsegment").alias("first_name"), F.concat(F.expr("substr(c_name, 10)"), "c_nationkey").alias("last_name"), F.when(c % 3 > 0, F.concat(F.lit("The "), "c_nationkey")).alias("nickname"))


def users(m) -> DataFrame:
    s = F.col("s_suppkey").cast("long")
    return m.table("supplier").select(s.alias("user_id"), F.concat(F.lit("  "), "s_name", F.when(s % 4 > 0, "@Example.org ").otherwise("")).alias("address"), (s % 3 > 0).alias("active"))


# ---------------------------------------------------------------- joins and lists


def with_names(fights_: DataFrame, fighters_: DataFrame) -> DataFrame:
    """Add red_name and blue_name: full names, null for unknown fighters. Fighters
    are joined by key; Spark broadcasts them where they are few."""
    name = F.concat("first_name", F.lit(" "), "last_name")
    for side in ("red", "blue"):
        fights_ = fights_.join(fighters_.select(F.col("fighter_id").alias(f"{side}_fighter_id"), name.alias(f"{side}_name")), f"{side}_fighter_id", "left")
    return fights_


@query("J-01", PEOPLE_SQL + " SELECT fight_id, red_name, blue_name FROM fn")
def _(m):
    return with_names(fights(m), fighters(m)).select("fight_id", "red_name", "blue_name")


@query("S-05", PEOPLE_SQL + " SELECT fight_id, video_path, red_name, blue_name FROM fn WHERE status = 'completed'")
def _(m):
    return with_names(fights(m).where("status = 'completed'"), fighters(m)).orderBy("fight_id").select("fight_id", "video_path", "red_name", "blue_name")


def facts(m) -> DataFrame:
    """Fights with title and the address of an active uploader."""
    u = users(m).where("active").select(F.col("user_id").alias("uploaded_by"), wording.email(F.col("address")).alias("to"))
    t = with_names(fights(m), fighters(m)).join(u, "uploaded_by", "left")
    return t.withColumn("title", wording.title(F.col("video_path"), F.col("red_name"), F.col("blue_name")))


FACTS_SQL = PEOPLE_SQL + f", fa AS (SELECT fn.*, {TITLE_SQL} AS title, CASE WHEN contains(address, '@') THEN lower(trim(address)) END AS to_ FROM fn LEFT JOIN us ON us.user_id = uploaded_by AND active)"


@query("J-03", FACTS_SQL + ' SELECT fight_id, title, to_ AS "to", labelled FROM fa')
def _(m):
    return facts(m).select("fight_id", "title", "to", "labelled")


def lookup_fight(fights_: DataFrame, video: str) -> DataFrame:
    """The fight of a video: by its exact path, else by its file name. Raises
    LookupError for none and for several."""
    exact = fights_.where(F.col("video_path") == video)
    found = exact.limit(1) if not exact.isEmpty() else fights_.where(F.col("video_path").endswith(video.rsplit("/", 1)[-1])).limit(2)
    n = found.count()
    if n != 1:
        raise LookupError(f"{video!r} matches {'no fight' if n == 0 else 'several fights'}")
    return found


@query("S-15", PEOPLE_SQL + " SELECT fight_id, video_path FROM fx WHERE video_path LIKE '%/Fight #12.v0.MP4'")
def _(m):
    return lookup_fight(fights(m), "elsewhere/Fight #12.v0.MP4").select("fight_id", "video_path")


def search(fighters_: DataFrame, text: str) -> DataFrame:
    """Fighters with ``text`` in a name, in any case, by last and first name."""
    hit = [F.col(c).ilike(f"%{text}%") for c in ("first_name", "last_name", "nickname")]
    return fighters_.where(hit[0] | hit[1] | hit[2]).orderBy("last_name", "first_name")


@query("S-27", PEOPLE_SQL + " SELECT * FROM fg WHERE first_name ILIKE '%auto%' OR last_name ILIKE '%auto%' OR nickname ILIKE '%auto%'")
def _(m):
    return search(fighters(m), "auto")


@query("T-01", PEOPLE_SQL + " SELECT last_name, first_name, fighter_id FROM fg")
def _(m):
    return fighters(m).orderBy("last_name", "first_name", "fighter_id").select("last_name", "first_name", "fighter_id")


@query("T-06", PEOPLE_SQL + " SELECT fight_id, status, CASE WHEN status IN ('failed', 'invalid') THEN 1 WHEN status IN ('completed', 'labeling_in_progress') THEN 2 ELSE 0 END AS rank FROM fx")
def _(m):
    rank = F.when(F.col("status").isin("failed", "invalid"), 1).when(F.col("status").isin("completed", "labeling_in_progress"), 2).otherwise(0)
    return fights(m).select("fight_id", "status", rank.alias("rank")).orderBy("rank", "fight_id")


@query("T-08", "SELECT fight_id, frame, event_id, action FROM ev WHERE source = 'label'")
def _(m):
    return m.events.where("source = 'label'").orderBy("fight_id", "frame", "event_id").select("fight_id", "frame", "event_id", "action")


def top_per_group(t: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


@query("T-05", "SELECT fight_id, frame, event_id FROM ev WHERE source = 'prediction' QUALIFY row_number() OVER (PARTITION BY fight_id, source ORDER BY value DESC, event_id) <= 2")
def _(m):
    return top_per_group(m.events.where("source = 'prediction'"), ["fight_id"], [F.desc("value"), "event_id"], 2).select("fight_id", "frame", "event_id")


@query("J-17", PEOPLE_SQL + ", " + LATEST_SQL + ", rf AS (SELECT reference_id, arg_max(f1, version) AS f1 FROM la GROUP BY 1), sd AS (SELECT scored_id, arg_min(f1, reference_id) AS f1 FROM la GROUP BY 1) SELECT fight_id, coalesce(rf.f1, sd.f1) AS f1 FROM fx LEFT JOIN rf ON reference_id = fight_id LEFT JOIN sd ON scored_id = fight_id")
def _(m):
    # a fixture's latest run; of several that scored a fight the first fixture's
    runs = latest_versions(eval_runs(m))
    reference = runs.groupBy(F.col("reference_id").alias("fight_id")).agg(F.max_by("f1", "version").alias("_r"))
    scored = runs.groupBy(F.col("scored_id").alias("fight_id")).agg(F.min_by("f1", "reference_id").alias("_s"))
    return fights(m).join(reference, "fight_id", "left").join(scored, "fight_id", "left").select("fight_id", F.coalesce("_r", "_s").alias("f1"))


@query("A-51", LATEST_SQL + " SELECT run_id, 'v' || version || ' · fight #' || scored_id || ' · scored at ' || substr(sha256(run_id::VARCHAR), 1, 7) || ' · constants ' || substr(sha256('c' || run_id), 1, 6) || '… · tolerance ±' || tol || 'f · ' || (generated_at % 50 + run_id % 9) || ' labelled strikes' AS line FROM la")
def _(m):
    t = latest_versions(eval_runs(m))
    sha = lambda c: F.sha2(c.cast("string"), 256)
    labelled = F.col("generated_at") % 50 + F.col("run_id") % 9  # tp + fn
    line = F.concat(F.lit("v"), "version", F.lit(" · fight #"), "scored_id", F.lit(" · scored at "), F.substring(sha(F.col("run_id")), 1, 7), F.lit(" · constants "), F.substring(sha(F.concat(F.lit("c"), "run_id")), 1, 6), F.lit("… · tolerance ±"), "tol", F.lit("f · "), labelled, F.lit(" labelled strikes"))
    return t.select("run_id", line.alias("line"))


@query("W-13", RUNS_SQL + " SELECT run_id, reference_id, scored_id, dense_rank() OVER (PARTITION BY reference_id ORDER BY scored_id)::INT AS pipeline_version FROM ru")
def _(m):
    version = F.dense_rank().over(Window.partitionBy("reference_id").orderBy("scored_id"))
    return eval_runs(m).select("run_id", "reference_id", "scored_id", version.alias("pipeline_version"))


# ---------------------------------------------------------------- wording


@query("E-16", PEOPLE_SQL + f" SELECT fight_id, {TITLE_SQL} AS title FROM fn")
def _(m):
    t = with_names(fights(m), fighters(m))
    return t.select("fight_id", wording.title(F.col("video_path"), F.col("red_name"), F.col("blue_name")).alias("title"))


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``unique``: equal names after the first get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    dotted = F.regexp_extract(name, r"(.*)(\.[^.]*)$", 1)
    numbered = F.concat(F.when(dotted != "", dotted).otherwise(F.col(name)), F.lit("_"), n, F.when(dotted != "", F.regexp_extract(name, r"(.*)(\.[^.]*)$", 2)).otherwise(""))
    return files.withColumn("unique", F.when(n == 1, F.col(name)).otherwise(numbered))


@query(
    "E-17",
    r"""c AS (SELECT event_id, ['_My fight (' || k || ').MOV', 'a b?.mp4', '???.Mp4', 'plain' || k % 5][k % 4 + 1] AS path FROM ev),
    s AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(path, '(.)\.[^.]+$', '\1'), '[^\w\-.]', '_', 'g'), '^_+|_+$', '', 'g') AS kept, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS ext FROM c),
    n AS (SELECT event_id, CASE WHEN kept = '' THEN 'video' ELSE kept END AS stem, ext, row_number() OVER (PARTITION BY kept, ext ORDER BY event_id) AS i FROM s)
    SELECT event_id, stem || ext AS safe, CASE WHEN i = 1 THEN stem || ext ELSE stem || '_' || i || ext END AS "unique" FROM n""",
)
def _(m):
    k = F.col("k")
    path = F.element_at(F.array(F.concat(F.lit("_My fight ("), k, F.lit(").MOV")), F.lit("a b?.mp4"), F.lit("???.Mp4"), F.concat(F.lit("plain"), k % 5)), (k % 4 + 1).cast("int"))
    t = m.events.select("event_id", wording.safe_name(path).alias("safe"))
    return unique_names(t, "safe", "event_id")


@query("E-18", PEOPLE_SQL + " SELECT user_id, CASE WHEN contains(address, '@') THEN lower(trim(address)) END AS email FROM us")
def _(m):
    return users(m).select("user_id", wording.email(F.col("address")).alias("email"))


@query("E-19", "SELECT event_id, sha256(concat_ws('|', action, frame::VARCHAR)) AS sha FROM ev")
def _(m):
    return m.events.select("event_id", F.sha2(F.concat_ws("|", "action", F.col("frame").cast("string")), 256).alias("sha"))


def _case(mapping: dict, before: str = "''", after: str = "''") -> str:
    return "CASE action " + " ".join(f"WHEN '{k}' THEN {before} || '{v}' || {after}" for k, v in mapping.items()) + " END"


OUTCOME_SQL = "CASE WHEN success THEN ' (landed)' WHEN NOT success THEN ' (missed)' ELSE ' (unconfirmed)' END"


@query(
    "E-15",
    f"""{PEOPLE_SQL}, d0 AS (SELECT ev.*, coalesce(red_name, 'Red') AS rn, coalesce(blue_name, 'Blue') AS bn, EXISTS (FROM swaps s WHERE s.fight_id = ev.fight_id AND ev.frame BETWEEN s.start_frame AND s.end_frame) AS swapped,
        coalesce(arg_max(action, frame * 100000000 + event_id) FILTER (WHERE source = 'label' AND action LIKE 'state%') OVER (PARTITION BY ev.fight_id ORDER BY frame RANGE UNBOUNDED PRECEDING) = 'state_clinch', false) AS clinch FROM ev JOIN fn USING (fight_id)),
    d AS (SELECT *, CASE WHEN source = 'prediction' THEN CASE WHEN fighter_id = fight_id * 2 THEN rn ELSE bn END WHEN (corner = 0) = NOT swapped THEN rn ELSE bn END AS who FROM d0)
    SELECT event_id, CASE WHEN source = 'label' THEN coalesce({_case(wording.STATE_TEXT)}, {_case(wording.HAND_STRIKES, "who || ' '", "' to the ' || coalesce(target, 'head')")},
        CASE WHEN action = 'knee' THEN who || CASE WHEN clinch THEN ' knee in the clinch' ELSE ' knee' END END, {_case(wording.LABEL_TEXT, 'who')}, action, '')
      WHEN action IS NULL THEN coalesce('Fight state → ' || state, '') ELSE coalesce({_case(wording.PREDICTED_TEXT, 'who')}, {_case(wording.OPEN_TEXT, 'who', OUTCOME_SQL)}, action) END AS text FROM d""",
)
def _(m):
    from spanframe.operators.intervals import contained

    names = with_names(fights(m), fighters(m)).select("fight_id", F.coalesce("red_name", F.lit("Red")).alias("_red"), F.coalesce("blue_name", F.lit("Blue")).alias("_blue"))
    swapped = contained(m.events.select("fight_id", "frame", "event_id"), m.swaps, how="left_semi").select("event_id", F.lit(True).alias("_swapped"))
    t = m.events.join(names, "fight_id").join(swapped, "event_id", "left").withColumn("_swapped", F.coalesce("_swapped", F.lit(False)))
    mark = (F.col("source") == "label") & F.col("action").startswith("state")
    so_far = Window.partitionBy("fight_id").orderBy("frame").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(mark, F.struct("frame", "event_id", "action"))).over(so_far)["action"]
    t = t.withColumn("_clinch", F.coalesce(last == "state_clinch", F.lit(False)))
    red = F.when(F.col("source") == "prediction", F.col("fighter_id") == F.col("fight_id") * 2).otherwise((F.col("corner") == 0) == ~F.col("_swapped"))
    who = F.when(red, F.col("_red")).otherwise(F.col("_blue"))
    label = wording.describe_label(F.col("action"), F.col("target"), who, F.col("_clinch"))
    predicted = wording.describe_prediction(F.col("action"), F.col("state"), F.col("success"), who, F.lit(None).cast("string"))
    return t.select("event_id", F.when(F.col("source") == "label", label).otherwise(predicted).alias("text"))


@query("E-21", f"SELECT event_id, action, coalesce({_case(wording.FIXED_TARGET)}, CASE WHEN action IN {wording.AIMED} THEN CASE WHEN target = 'body' THEN 'body' ELSE 'head' END END) AS target, CASE WHEN action IN {wording.ALWAYS_LANDED} THEN true END AS success FROM ev WHERE source = 'label'")
def _(m):
    a = F.col("action")
    return m.events.where("source = 'label'").select("event_id", "action", wording.reclassified_target(a, F.col("target")).alias("target"), wording.reclassified_success(a).alias("success"))


@query("E-22", f"x AS (SELECT event_id, ['STRIKING', 'CLINCH', 'GROUND'][k % 3 + 1] AS st, {sql_lookup(PREDICTED_FAMILY, 'action')} AS fam, {sql_lookup(PREDICTED_TARGET, 'action')} AS tg FROM ev WHERE source = 'prediction') SELECT event_id, CASE WHEN fam IN {wording.PUNCHES} THEN CASE st WHEN 'CLINCH' THEN 'clinch_punch' WHEN 'GROUND' THEN 'ground_punch' ELSE fam || CASE WHEN tg = 'head' THEN '_head' ELSE '_body' END END WHEN fam = 'kick' THEN CASE tg WHEN 'head' THEN 'head_kick' WHEN 'body' THEN 'middle_kick' WHEN 'leg' THEN 'low_kick' END WHEN st = 'GROUND' THEN 'ground_knee' WHEN st = 'CLINCH' THEN 'clinch_knee' ELSE 'knee' END AS action FROM x WHERE fam IS NOT NULL")
def _(m):
    t = m.events.where("source = 'prediction'").select("event_id", lookup(PREDICTED_FAMILY, "action").alias("f"), lookup(PREDICTED_TARGET, "action").alias("t"), F.element_at(F.array(*map(F.lit, ("STRIKING", "CLINCH", "GROUND"))), (F.col("k") % 3 + 1).cast("int")).alias("s"))
    return t.where("f is not null").select("event_id", wording.strike_action(F.col("f"), F.col("t"), F.col("s")).alias("action"))


MEASURE_SQL = r"""CASE WHEN regexp_matches(X, '(\d+)''(\d+)') THEN regexp_extract(X, '(\d+)''(\d+)', 1)::DOUBLE * 12 + regexp_extract(X, '(\d+)''(\d+)', 2)::DOUBLE WHEN regexp_matches(X, '(\d+)"') THEN regexp_extract(X, '(\d+)"', 1)::DOUBLE
    ELSE coalesce(try_cast(regexp_extract(X, '^\s*([-+]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE), 0) END"""


@query("E-23", r"""x AS (SELECT event_id, k, [ (k % 7) || '''' || (k % 12) || '"', (60 + k % 20) || '" reach', (k / 4.0)::VARCHAR || ' kg', 'n/a'][event_id % 4 + 1] AS r, (70 + k % 9) || '"' AS b FROM ev), y AS (SELECT *, """ + MEASURE_SQL.replace("X", "r") + " AS rn, " + MEASURE_SQL.replace("X", "b") + " AS bn FROM x) SELECT event_id, rn AS red, abs(rn - bn) AS diff, rn > bn AS red_wins FROM y")
def _(m):
    k = F.col("k")
    red = F.element_at(F.array(F.concat(k % 7, F.lit("'"), k % 12, F.lit('"')), F.concat(k % 20 + 60, F.lit('" reach')), F.concat((k / 4).cast("string"), F.lit(" kg")), F.lit("n/a")), (F.col("event_id") % 4 + 1).cast("int"))
    t = m.events.select("event_id", wording.measure(red).alias("red"), wording.measure(F.concat(k % 9 + 70, F.lit('"'))).alias("_b"))
    return t.select("event_id", "red", F.abs(F.col("red") - F.col("_b")).alias("diff"), (F.col("red") > F.col("_b")).alias("red_wins"))


@query("E-24", r"""x AS (SELECT event_id, [ 'Ann  Lee Smith ', ' Cher', '', 'Jo ' || action][k % 4 + 1] AS full_ FROM ev), y AS (SELECT event_id, trim(full_) AS f, string_split_regex(trim(full_), '\s+') AS p FROM x)
    SELECT event_id, CASE WHEN f <> '' THEN CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], ' ') ELSE p[1] END END AS "first", CASE WHEN f <> '' THEN upper(p[-1]) END AS name FROM y""")
def _(m):
    full = F.element_at(F.array(F.lit("Ann  Lee Smith "), F.lit(" Cher"), F.lit(""), F.concat(F.lit("Jo "), "action")), (F.col("k") % 4 + 1).cast("int"))
    return m.events.select("event_id", wording.split_name(full).alias("n")).select("event_id", "n.first", "n.name")


@query("F-20", PEOPLE_SQL + " SELECT fight_id, CASE WHEN reported IS NULL OR decoded IS NULL THEN 'The source video failed to decode.' ELSE 'Container reports ' || reported || ' frames, only ' || decoded || ' decode (' || floor((reported - decoded) / reported * 100 + 0.5)::BIGINT || '% missing) — the file is an incomplete download.' END AS reason FROM fx")
def _(m):
    return fights(m).select("fight_id", wording.invalid_reason(F.col("reported"), F.col("decoded")).alias("reason"))


@query(
    "E-27",
    FACTS_SQL + """ SELECT fight_id, to_ AS "to", CASE status WHEN 'completed' THEN title || ' is ready' WHEN 'labeling_in_progress' THEN title || ' is ready to label' WHEN 'failed' THEN 'processing failed for ' || title ELSE title || ' could not be processed' END AS subject,
    CASE status WHEN 'completed' THEN title || E' has been processed. Its AI annotations are ready to review:\\n\\nhttp://x/fights/' || fight_id || E'\\n' WHEN 'labeling_in_progress' THEN title || E' has been processed. Fighter tracking is done, so it''s ready to label:\\n\\nhttp://x/fights/' || fight_id || E'/annotate\\n'
      WHEN 'failed' THEN 'The pipeline failed while processing ' || title || E'. You can delete it and upload it again from the fight list:\\n\\nhttp://x/\\n'
      ELSE title || ' didn''t pass validation, so it wasn''t processed.' || CASE WHEN reported <> 0 AND decoded IS NOT NULL THEN ' Only ' || decoded || ' of its ' || reported || ' frames could be decoded.' ELSE '' END || E' The file is probably truncated: download or export it again, then upload it again:\\n\\nhttp://x/\\n' END AS body
    FROM fa WHERE to_ IS NOT NULL AND (status IN ('completed', 'failed', 'invalid') OR status = 'labeling_in_progress' AND NOT labelled)""",
)
def _(m):
    t = facts(m).withColumn("subject", wording.uploader_subject(F.col("status"), F.col("title"), F.col("labelled"))).where("`to` is not null and subject is not null")
    return t.select("fight_id", "to", "subject", wording.uploader_body(F.col("status"), F.col("title"), F.col("fight_id"), F.col("reported"), F.col("decoded"), "http://x").alias("body"))


@query("U-05", PEOPLE_SQL + " SELECT DISTINCT lower(trim(address)) AS email FROM us WHERE contains(address, '@') AND user_id % 5 > 0")
def _(m):
    # every fifth account is synthetic
    made = users(m).where("user_id % 5 = 0").select(wording.email(F.col("address")).alias("email"))
    return users(m).select(wording.email(F.col("address")).alias("email")).where("email is not null").subtract(made)


# ---------------------------------------------------------------- sets, guards and sums


@query("U-01", "SELECT fight_id, 'point' AS kind, frame, NULL::BIGINT AS end_frame, action, NULL::VARCHAR AS reason FROM ev WHERE source = 'label' UNION ALL SELECT fight_id, 'excluded', start_frame, end_frame, NULL, 'span ' || event_id FROM excluded")
def _(m):
    points = m.events.where("source = 'label'").select("fight_id", F.lit("point").alias("kind"), "frame", "action")
    spans = m.excluded.select("fight_id", F.lit("excluded").alias("kind"), F.col("start_frame").alias("frame"), "end_frame", F.concat(F.lit("span "), "event_id").alias("reason"))
    return points.unionByName(spans, allowMissingColumns=True).select("fight_id", "kind", "frame", "end_frame", "action", "reason")


@query("U-02", "t AS (SELECT fight_id FROM fights WHERE purpose = 'training_data'), v AS (SELECT fight_id FROM fights WHERE fight_id % 10 = 0) SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (FROM t INTERSECT FROM v)")
def _(m):
    both = m.fights.where("purpose = 'training_data'").select("fight_id").intersect(m.fights.where("fight_id % 10 = 0").select("fight_id"))
    return both.agg(F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) == 0).alias("disjoint"))


@query("U-04", "SELECT fight_id, list_sort(list(DISTINCT round_number)) AS numbers FROM rounds GROUP BY fight_id")
def _(m):
    return m.rounds.groupBy("fight_id").agg(F.array_sort(F.collect_set("round_number")).alias("numbers"))


def may_update(kind: Column, source: Column, action: Column, end_frame: Column, value: Column) -> Column:
    """Whether a label may be changed so: points are fixed, but for the frame of a state mark."""
    mark = F.coalesce(action, F.lit("")).startswith("state_") & end_frame.isNull() & value.isNull()
    return (source == "label") & ((kind != "point") | mark)


@query("F-17", "SELECT event_id, source = 'label' AND (k % 3 = 0 OR (coalesce(action, '') LIKE 'state\\_%' ESCAPE '\\' AND k % 4 > 0 AND k % 5 > 0)) AS allowed, CASE WHEN source = 'label' AND (k % 3 = 0 OR (coalesce(action, '') LIKE 'state\\_%' ESCAPE '\\' AND k % 4 > 0 AND k % 5 > 0)) AND k % 2 = 1 THEN frame + k ELSE frame END AS frame FROM ev")
def _(m):
    k = F.col("k")
    allowed = may_update(F.when(k % 3 == 0, "round").otherwise("point"), F.col("source"), F.col("action"), F.when(k % 4 == 0, k), F.when(k % 5 == 0, k))
    moved = F.when(k % 2 == 1, F.col("frame") + k)  # the new frame, null for none
    return m.events.select("event_id", allowed.alias("allowed"), F.when(allowed, F.coalesce(moved, F.col("frame"))).otherwise(F.col("frame")).alias("frame"))


@query("A-24", "r AS (SELECT fight_id, count(*) FILTER (WHERE fight_id % 9 > 0 OR round_number > 3) AS n FROM rounds GROUP BY 1), e AS (SELECT fight_id, count(*) AS n FROM ev WHERE source = 'label' AND action = 'knockdown' GROUP BY 1) SELECT r.fight_id, r.n > 0 AND coalesce(e.n, 0) >= r.n AS complete FROM r LEFT JOIN e USING (fight_id)")
def _(m):
    # rows, not distinct rounds; round labels are played by knockdowns here, and every ninth fight has no round
    rounds = m.rounds.groupBy("fight_id").agg(F.count_if((F.col("fight_id") % 9 > 0) | (F.col("round_number") > 3)).alias("n"))
    labels = m.events.where("source = 'label' and action = 'knockdown'").groupBy("fight_id").agg(F.count(F.lit(1)).alias("e"))
    return rounds.join(labels, "fight_id", "left").select("fight_id", ((F.col("n") > 0) & (F.coalesce("e", F.lit(0)) >= F.col("n"))).alias("complete"))


@query("A-21", f"l AS (SELECT fight_id, {sql_lookup(LABEL_FAMILY, 'action')} AS family, success FROM ev WHERE source = 'label') SELECT fight_id, family, count(*) AS n, count(*) FILTER (WHERE success) AS landed FROM l WHERE family IS NOT NULL GROUP BY ROLLUP (fight_id, family)")
def _(m):
    l = m.events.where("source = 'label'").select("fight_id", lookup(LABEL_FAMILY, "action").alias("family"), "success").where("family is not null")  # noqa: E741
    return l.rollup("fight_id", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("landed"))


OFFSETS_SQL = "o AS (SELECT fight_id, k % 41 - 20 AS d FROM ev WHERE source = 'prediction')"


@query("A-11", OFFSETS_SQL + " SELECT fight_id, median(d)::DOUBLE AS bias, median(abs(d))::DOUBLE AS jitter FROM o GROUP BY fight_id")
def _(m):
    t = m.events.where("source = 'prediction'").groupBy("fight_id")
    d = F.col("k") % 41 - 20
    return t.agg(F.median(d).alias("bias"), F.median(F.abs(d)).alias("jitter"))


@query("W-17", OFFSETS_SQL + " SELECT fight_id, sum(d)::BIGINT AS total, median(d)::DOUBLE AS bias, greatest(12, max(abs(d)))::INT AS bound FROM o GROUP BY fight_id")
def _(m):
    d = F.col("k") % 41 - 20
    return m.events.where("source = 'prediction'").groupBy("fight_id").agg(F.sum(d).alias("total"), F.median(d).alias("bias"), F.greatest(F.lit(12), F.max(F.abs(d))).alias("bound"))


CELLS_SQL = f"x AS (SELECT {sql_lookup(LABEL_FAMILY, 'action')} AS truth, {sql_lookup(PREDICTED_FAMILY, 'action')} AS f, fight_id, frame, source FROM ev), c AS (SELECT a.truth, b.f AS pred, count(*) AS n FROM x a JOIN x b ON a.fight_id = b.fight_id AND a.frame // 200 = b.frame // 200 WHERE a.source = 'label' AND b.source = 'prediction' AND a.truth IS NOT NULL AND b.f IS NOT NULL GROUP BY 1, 2)"


def confusion(m) -> DataFrame:
    """Sparse counts of (truth, pred): families of labels and predictions near each other."""
    slot = F.floor(F.col("frame") / 200)
    side = lambda source, names, out: m.events.where(F.col("source") == source).select("fight_id", slot.alias("_slot"), lookup(names, "action").alias(out)).where(F.col(out).isNotNull())
    return side("label", LABEL_FAMILY, "truth").join(side("prediction", PREDICTED_FAMILY, "pred"), ["fight_id", "_slot"]).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def dense(cells: DataFrame) -> DataFrame:
    """All pairs of the truths and preds that occur, 0 where none was counted, with
    the largest cell. Both sides are class names, a few dozen at any scale."""
    grid = cells.select("truth").distinct().crossJoin(F.broadcast(cells.select("pred").distinct()))
    most = cells.agg(F.max("n").alias("most"))
    return grid.join(cells, ["truth", "pred"], "left").fillna(0, ["n"]).crossJoin(F.broadcast(most)).orderBy("truth", "pred")


@query("A-50", CELLS_SQL + " SELECT t.truth, p.pred, coalesce(n, 0) AS n, (SELECT max(n) FROM c) AS most FROM (SELECT DISTINCT truth FROM c) t CROSS JOIN (SELECT DISTINCT pred FROM c) p LEFT JOIN c ON c.truth = t.truth AND c.pred = p.pred")
def _(m):
    return dense(confusion(m))


@query("E-25", CELLS_SQL + " SELECT truth || '>' || pred AS key, n, truth, pred FROM c")
def _(m):
    # written as one JSON object and read back, split at the first ">"
    t = confusion(m).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat("truth", F.lit(">"), "pred"), "n")))).alias("report"))
    return t.select(F.explode(F.from_json("report", "map<string,bigint>")).alias("key", "n")).select("key", "n", F.substring_index("key", ">", 1).alias("truth"), F.regexp_extract("key", ">(.*)$", 1).alias("pred"))


def read_confusion(reports: DataFrame, column: str) -> DataFrame:
    """Rows of a report's JSON confusion: truth, pred (split at the first ">"), n."""
    t = reports.withColumn("_cells", F.from_json(column, "map<string,bigint>")).select("*", F.explode("_cells").alias("_key", "n")).drop("_cells")
    return t.withColumn("truth", F.substring_index("_key", ">", 1)).withColumn("pred", F.regexp_extract("_key", ">(.*)$", 1)).drop("_key")


@query("S-21", "SELECT event_id, 'jab' AS truth, action AS pred, k::BIGINT AS n FROM ev WHERE action IS NOT NULL UNION ALL SELECT event_id, 'x', 'y>z', frame FROM ev WHERE action IS NOT NULL")
def _(m):
    cells = F.to_json(F.create_map(F.concat(F.lit("jab>"), F.coalesce("action", F.lit(""))), F.col("k").cast("long"), F.lit("x>y>z"), F.col("frame")))
    return read_confusion(m.events.where("action is not null").select("event_id", cells.alias("report")), "report").select("event_id", "truth", "pred", "n")


def class_metrics(cells: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of every class of sparse cells."""
    by = lambda c, out: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(out))
    hit = cells.where("truth = pred").select(F.col("truth").alias("class"), F.col("n").alias("hit"))
    t = by("truth", "support").join(by("pred", "predicted"), "class", "full").join(hit, "class", "left").fillna(0)
    part = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    t = t.withColumn("precision", part(F.col("hit"), F.col("predicted"))).withColumn("recall", part(F.col("hit"), F.col("support")))
    return t.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


@query(
    "A-39",
    CELLS_SQL + """, s AS (SELECT truth AS class, sum(n) AS support FROM c GROUP BY 1), p AS (SELECT pred AS class, sum(n) AS predicted FROM c GROUP BY 1), h AS (SELECT truth AS class, n AS hit FROM c WHERE truth = pred),
    j AS (SELECT class, coalesce(support, 0) AS support, coalesce(hit / nullif(predicted, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM s FULL JOIN p USING (class) LEFT JOIN h USING (class)), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM j)
    SELECT class, support::BIGINT AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round((SELECT avg(f1) FROM f WHERE support > 0), 6) AS macro_f1, round((SELECT max(support) / sum(support) FROM f), 6) AS majority FROM f""",
)
def _(m):
    t = class_metrics(confusion(m))
    total = t.agg(F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 6).alias("macro_f1"), F.round(F.max("support") / F.sum("support"), 6).alias("majority"))
    return t.crossJoin(F.broadcast(total)).select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "macro_f1", "majority")


@query("A-40", "c AS (SELECT action, count(*) AS n FROM ev WHERE source = 'prediction' GROUP BY 1) SELECT action, round(1 / sqrt(n) * count(*) OVER () / sum(1 / sqrt(n)) OVER (), 6) AS weight FROM c")
def _(m):
    # one row per class from here on
    t = m.events.where("source = 'prediction'").groupBy("action").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("w"))
    total = t.agg(F.count(F.lit(1)).alias("_n"), F.sum("w").alias("_s"))
    return t.crossJoin(F.broadcast(total)).select("action", F.round(F.col("w") * F.col("_n") / F.col("_s"), 6).alias("weight"))


@query("A-47", "SELECT fight_id, frame, count(*) AS n, list(corner ORDER BY corner, event_id) AS corners, list(event_id ORDER BY corner, event_id) AS events FROM ev GROUP BY fight_id, frame")
def _(m):
    seen = F.array_sort(F.collect_list(F.struct("corner", "event_id")))
    t = m.events.groupBy("fight_id", "frame").agg(F.count(F.lit(1)).alias("n"), seen.alias("_s"))
    return t.select("fight_id", "frame", "n", F.col("_s.corner").alias("corners"), F.col("_s.event_id").alias("events"))


@query("A-48", "d AS (SELECT fight_id, frame // 50 AS f, count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS kp FROM ev GROUP BY ALL) SELECT fight_id, count(*) AS frames, sum(n)::BIGINT AS detections, count(*) FILTER (WHERE n >= 2) AS both_present, sum(kp)::BIGINT AS with_keypoints FROM d GROUP BY fight_id")
def _(m):
    t = m.events.groupBy("fight_id", F.floor(F.col("frame") / 50)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 3 == 0).alias("kp"))
    return t.groupBy("fight_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("detections"), F.count_if(F.col("n") >= 2).alias("both_present"), F.sum("kp").alias("with_keypoints"))


@query("W-09", "s AS (SELECT fight_id, k - lag(k) OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS d FROM ev) SELECT fight_id, CASE WHEN count(*) FILTER (WHERE d < 0) >= count(*) FILTER (WHERE d > 0) THEN 'down' ELSE 'up' END AS direction FROM s GROUP BY fight_id")
def _(m):
    d = F.col("k") - F.lag("k").over(Window.partitionBy("fight_id").orderBy("frame", "event_id"))
    t = m.events.select("fight_id", d.alias("d")).groupBy("fight_id").agg(F.count_if(F.col("d") < 0).alias("a"), F.count_if(F.col("d") > 0).alias("b"))
    return t.select("fight_id", F.when(F.col("a") >= F.col("b"), "down").otherwise("up").alias("direction"))


@query("M-23", "g AS (SELECT fight_id, event_id, frame, CASE WHEN k % 4 = 0 THEN k END AS v FROM ev) SELECT fight_id, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY fight_id ORDER BY frame, event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY fight_id ORDER BY frame, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g")
def _(m):
    w = Window.partitionBy("fight_id").orderBy("frame", "event_id")
    v = F.when(F.col("k") % 4 == 0, F.col("k"))
    held = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.events.select("fight_id", "event_id", F.coalesce(held, F.first(v, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias("v"))


# ---------------------------------------------------------------- upserts

#: Registrations that arrive: every second id is known.
ARRIVALS_SQL = "ar AS (SELECT fight_id * 2 AS fight_id, 'arrived' AS purpose, 'queued' AS state FROM fights)"


def _upserted(m, update: bool) -> DataFrame:
    known = m.fights.select("fight_id", "purpose", "state")
    arrivals = m.fights.select((F.col("fight_id") * 2).alias("fight_id"), F.lit("arrived").alias("purpose"), F.lit("queued").alias("state"))
    return upsert(known, arrivals, "fight_id", update=update)


@query("S-18", ARRIVALS_SQL + " SELECT fight_id, coalesce(ar.purpose, f.purpose) AS purpose, coalesce(ar.state, f.state) AS state FROM fights f FULL JOIN ar USING (fight_id)")
def _(m):
    return _upserted(m, True)


@query("S-18-keep", ARRIVALS_SQL + " SELECT fight_id, coalesce(f.purpose, ar.purpose) AS purpose, coalesce(f.state, ar.state) AS state FROM fights f FULL JOIN ar USING (fight_id)")
def _(m):
    return _upserted(m, False)
