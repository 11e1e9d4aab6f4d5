"""What is written, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from spanframe.functions.vocabulary import FAMILIES, LABEL_FAMILY, STATE_MARK, STATES, lookup, sql_lookup
from spanframe.operators import series
from spanframe.plans.machines import BOXES_SQL, FRAMES_SQL, people, seen_frames
from spanframe.plans.registry import query
from spanframe.plans.spans import RUNS_SQL, eval_runs
from spanframe.sources import labels, reports, runs
from spanframe.sources.files import write_files
from spanframe.sources.store import Store
from spanframe.sources.files import shared_folder


def store(m, *keys: str) -> Store:
    return Store(m.spark, f"{shared_folder(m.spark)}/store-{uuid.uuid4().hex}", *keys)


@query("S-16", "SELECT source, fight_id, event_id, frame, action, 'events' AS kept FROM ev WHERE (source = 'label' OR fight_id % 2 = 0 OR k < 70) UNION ALL SELECT 'prediction', fight_id, round_number, start_frame, NULL, 'rounds' FROM rounds WHERE fight_id % 2 = 0 OR round_number < 3")
def _(m):
    """Labels once; all fights processed; every other one processed again, twice."""
    kept = store(m, "source", "fight_id")
    columns = ("source", "fight_id", "event_id", "frame", "action")
    labels, found = (m.events.where(F.col("source") == s).select(*columns, "k") for s in ("label", "prediction"))
    rounds = m.rounds.select(F.lit("prediction").alias("source"), "fight_id", "round_number", "start_frame")
    kept.replace({"events": labels.drop("k")}, labels)
    everyone = m.fights.select(F.lit("prediction").alias("source"), "fight_id")
    kept.replace({"events": found.where("k < 70").drop("k"), "rounds": rounds.where("round_number < 3")}, everyone)
    even = F.col("fight_id") % 2 == 0
    for _ in range(2):
        kept.replace({"events": found.where(even).drop("k"), "rounds": rounds.where(even)}, everyone.where(even))
    read = kept.read("rounds").select("source", "fight_id", F.col("round_number").cast("long").alias("event_id"), F.col("start_frame").alias("frame"), F.lit(None).cast("string").alias("action"), F.lit("rounds").alias("kept"))
    return kept.read("events").select(*columns, F.lit("events").alias("kept")).unionByName(read)


@query("S-17", "SELECT fight_id, event_id, frame FROM ev")
def _(m):
    """Rows in files of a thousand at most."""
    kept = store(m, "fight_id")
    rows = m.events.select("fight_id", "event_id", "frame")
    kept.replace({"frames": rows}, m.fights, rows_per_file=1000)
    return kept.read("frames")


# ---------------------------------------------------------------- label documents

DOCUMENT_SQL = f"""dk AS (SELECT ev.*, {sql_lookup(LABEL_FAMILY, "action")} AS family, {sql_lookup(STATE_MARK, "action")} AS st FROM ev WHERE source = 'label'),
    dn AS (SELECT fight_id, 'fight ' || fight_id AS name FROM fights UNION ALL SELECT fight_id, 'fight ' || fight_id || '.second' FROM fights WHERE fight_id % 4 = 0),
    ds AS (SELECT fight_id, row_number() OVER w - 1 AS i, frame - 300 AS frame, CASE WHEN k % 17 = 0 THEN 'green' WHEN corner = 0 THEN 'red' ELSE 'blue' END AS fighter, CASE WHEN k % 29 = 0 THEN 'slap' ELSE family END AS family, coalesce(target, 'unknown') AS target, success AS landed FROM dk WHERE family IS NOT NULL WINDOW w AS (PARTITION BY fight_id ORDER BY event_id)),
    dt AS (SELECT fight_id, row_number() OVER w - 1 AS i, frame - 300 AS frame FROM dk WHERE action = 'takedown_landed' WINDOW w AS (PARTITION BY fight_id ORDER BY event_id)),
    da AS (SELECT fight_id, row_number() OVER w - 1 AS i, frame AS s, frame + 3000 - k * 40 AS e, CASE WHEN k % 31 = 0 THEN 'STANDING' ELSE st END AS state FROM dk WHERE st IS NOT NULL WINDOW w AS (PARTITION BY fight_id ORDER BY event_id)),
    dw AS (SELECT fight_id, row_number() OVER w - 1 AS i, start_frame AS s, CASE WHEN event_id % 9 = 0 THEN start_frame - 1 ELSE end_frame END AS e FROM swaps WINDOW w AS (PARTITION BY fight_id ORDER BY event_id))"""


def documents(m) -> DataFrame:
    """One document a fight, and a second pass of every fourth; some rows break rules."""
    k = F.col("k")
    t = m.events.where("source = 'label'").withColumns({"family": lookup(LABEL_FAMILY, "action"), "st": lookup(STATE_MARK, "action")})
    fighter = F.when(k % 17 == 0, "green").when(F.col("corner") == 0, "red").otherwise("blue")
    strike = F.struct("event_id", (F.col("frame") - 300).alias("frame"), fighter.alias("fighter"), F.when(k % 29 == 0, "slap").otherwise(F.col("family")).alias("family"), F.coalesce("target", F.lit("unknown")).alias("target"), F.col("success").alias("landed"))
    state = F.struct("event_id", F.col("frame").alias("start"), (F.col("frame") + 3000 - k * 40).alias("end"), F.when(k % 31 == 0, "STANDING").otherwise(F.col("st")).alias("state"))
    down = F.struct("event_id", (F.col("frame") - 300).alias("frame"), F.lit("red").alias("fighter"))
    swap = F.struct("event_id", F.col("start_frame").alias("start"), F.when(F.col("event_id") % 9 == 0, F.col("start_frame") - 1).otherwise(F.col("end_frame")).alias("end"))
    listed = lambda x, cond=None: F.transform(F.array_sort(F.collect_list(x if cond is None else F.when(cond, x))), lambda s: s.dropFields("event_id"))
    d = t.groupBy("fight_id").agg(listed(strike, F.col("family").isNotNull()).alias("strikes"), listed(state, F.col("st").isNotNull()).alias("states"), listed(down, F.col("action") == "takedown_landed").alias("takedowns"))
    rounds = F.transform(F.array_sort(F.collect_list(F.struct("round_number", F.col("start_frame").alias("start"), F.col("end_frame").alias("end")))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["round_number"].alias("round"), F.lit(False).alias("seeded")))
    d = m.fights.select("fight_id", "fps").join(d, "fight_id", "left").join(m.rounds.groupBy("fight_id").agg(rounds.alias("rounds")), "fight_id", "left").join(m.swaps.groupBy("fight_id").agg(listed(swap).alias("corner_swaps")), "fight_id", "left")
    name = F.concat(F.lit("fight "), F.col("fight_id").cast("string"))
    d = d.withColumn("name", F.explode(F.array_compact(F.array(name, F.when(F.col("fight_id") % 4 == 0, F.concat(name, F.lit(".second")))))))
    d = d.withColumns({"video": F.concat("name", F.lit(".mp4")), "frame_count": F.lit(0), "labeler": F.lit(""), "labeled_at": F.lit(""), "notes": F.lit(""), "excluded": F.array()})
    kinds = {f.name: f.dataType for f in StructType.fromDDL(labels.DOCUMENT)}
    return d.select("name", *(F.coalesce(F.col(n), F.array()).cast(kinds[n]).alias(n) if isinstance(kinds[n], ArrayType) else F.col(n).cast(kinds[n]).alias(n) for n in labels.NAMES))


def stored_documents(m) -> DataFrame:
    folder = f"{shared_folder(m.spark)}/labels-{uuid.uuid4().hex}"
    labels.write_labels(documents(m), folder)
    return labels.read_labels(m.spark, folder)


@query(
    "S-08",
    DOCUMENT_SQL
    + """ SELECT name, name || '.mp4' AS video, 50 AS fps, (SELECT coalesce(list(frame ORDER BY frame, i), []) FROM ds WHERE ds.fight_id = dn.fight_id) AS strikes, (SELECT coalesce(list(family ORDER BY frame, i), []) FROM ds WHERE ds.fight_id = dn.fight_id) AS families,
    (SELECT coalesce(list(s ORDER BY s, i), []) FROM da WHERE da.fight_id = dn.fight_id) AS states, (SELECT coalesce(list(s ORDER BY i), []) FROM dw WHERE dw.fight_id = dn.fight_id) AS corner_swaps, (SELECT list(round_number ORDER BY start_frame) FROM rounds r WHERE r.fight_id = dn.fight_id) AS rounds FROM dn""",
)
def _(m):
    t = stored_documents(m)
    return t.select("name", "video", "fps", F.col("strikes.frame").alias("strikes"), F.col("strikes.family").alias("families"), F.col("states.start").alias("states"), F.col("corner_swaps.start").alias("corner_swaps"), F.col("rounds.round").alias("rounds"))


@query("S-10", DOCUMENT_SQL + " SELECT 'fight ' || fight_id AS video_name, row_number() OVER (PARTITION BY fight_id ORDER BY length(name)) - 1 AS place, name FROM dn")
def _(m):
    videos = m.fights.select(F.concat(F.lit("fight "), F.col("fight_id").cast("string")).alias("video_name"))
    return labels.passes(stored_documents(m), videos).select("video_name", "place", "name")


@query(
    "F-13-document",
    DOCUMENT_SQL
    + f""", de AS (
        SELECT fight_id, 'strikes[' || i || ']: frame ' || frame || ' is not 1-based' AS message FROM ds WHERE frame < 1
        UNION ALL SELECT fight_id, 'strikes[' || i || ']: fighter ''' || fighter || ''' not in (''red'', ''blue'')' FROM ds WHERE fighter = 'green'
        UNION ALL SELECT fight_id, 'strikes[' || i || ']: family ''' || family || ''' not in {str(FAMILIES).replace("'", "''")}' FROM ds WHERE family NOT IN {FAMILIES}
        UNION ALL SELECT fight_id, 'takedowns[' || i || ']: frame ' || frame || ' is not 1-based' FROM dt WHERE frame < 1
        UNION ALL SELECT fight_id, 'states[' || i || ']: state ''' || state || ''' not in {str(STATES).replace("'", "''")}' FROM da WHERE state NOT IN {STATES}
        UNION ALL SELECT fight_id, 'states[' || i || ']: end ' || e || ' before start ' || s FROM da WHERE e < s
        UNION ALL SELECT fight_id, 'state spans overlap: [' || s || ',' || e || '] and [' || ns || ',' || ne || ']' FROM (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM da WINDOW w AS (PARTITION BY fight_id ORDER BY s, i)) WHERE ns <= e
        UNION ALL SELECT fight_id, 'corner_swaps[' || i || ']: end ' || e || ' before start ' || s FROM dw WHERE e < s)
    SELECT name, message FROM dn JOIN de USING (fight_id)""",
)
def _(m):
    t = documents(m)
    return t.select("name", F.explode(labels.errors(t)).alias("message"))


@query("S-09", DOCUMENT_SQL + " SELECT name, (SELECT coalesce(list(fighter ORDER BY frame, i), []) FROM ds WHERE ds.fight_id = dn.fight_id) AS fighters, (SELECT coalesce(list(state ORDER BY s, i), []) FROM da WHERE da.fight_id = dn.fight_id) AS states, (SELECT coalesce(list(frame ORDER BY frame, i), []) FROM dt WHERE dt.fight_id = dn.fight_id) AS takedowns, (SELECT coalesce(list(e ORDER BY i), []) FROM dw WHERE dw.fight_id = dn.fight_id) AS corner_swaps FROM dn")
def _(m):
    """Lists in order of frames, corner swaps as they came."""
    return stored_documents(m).select("name", F.col("strikes.fighter").alias("fighters"), F.col("states.state").alias("states"), F.col("takedowns.frame").alias("takedowns"), F.col("corner_swaps.end").alias("corner_swaps"))


# ---------------------------------------------------------------- reports

REPORT = "events long, strikes long, type_counts map<string,long>, confusion map<string,long>"


def sanity_reports(m) -> DataFrame:
    """One report a fight: name and the envelope."""
    e = m.events.where("action is not null")
    counts = e.groupBy("fight_id", "action").agg(F.count(F.lit(1)).alias("n")).groupBy("fight_id").agg(F.sum("n").alias("events"), F.map_from_entries(F.collect_list(F.struct("action", "n"))).alias("type_counts"))
    cells = e.groupBy("fight_id", F.col("source").alias("truth"), F.coalesce("state", F.lit("none")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.groupBy("fight_id").agg(reports.cells_json(F.collect_list(F.struct("truth", "pred", "n"))).alias("confusion"))
    strikes = e.groupBy("fight_id").agg(F.count_if("success").alias("strikes"))
    t = counts.join(cells, "fight_id").join(strikes, "fight_id")
    name = F.concat(F.lit("fight-"), F.col("fight_id").cast("string"))
    return t.select(
        name.alias("name"), F.sha1(name.cast("binary")).alias("git_sha"), F.sha2(name, 256).alias("constants_sha256"), F.concat(name, F.lit(".mp4")).alias("video"), F.when(F.col("fight_id") % 2 == 0, 12).cast("long").alias("tolerance_frames"),
        F.lit("2024-01-01T00:00:00+00:00").alias("generated_at"), F.struct("events", "strikes", "type_counts", "confusion").alias("report"),
    )


@query(
    "S-20",
    """rp AS (SELECT fight_id, count(*) AS events, count(*) FILTER (WHERE success) AS strikes FROM ev WHERE action IS NOT NULL GROUP BY fight_id), rt AS (SELECT fight_id, action, count(*) AS n FROM ev WHERE action IS NOT NULL GROUP BY ALL), rc AS (SELECT fight_id, source || '>' || coalesce(state, 'none') AS cell, count(*) AS n FROM ev WHERE action IS NOT NULL GROUP BY ALL)
    SELECT 'fight-' || fight_id AS name, sha1('fight-' || fight_id) AS git_sha, sha256('fight-' || fight_id) AS constants_sha256, 'fight-' || fight_id || '.mp4' AS video, CASE WHEN fight_id % 2 = 0 THEN 12 END AS tolerance_frames, '2024-01-01T00:00:00+00:00' AS generated_at, events, strikes,
        (SELECT list(action || '=' || n ORDER BY action) FROM rt WHERE rt.fight_id = rp.fight_id) AS type_counts, (SELECT list(cell || '=' || n ORDER BY cell) FROM rc WHERE rc.fight_id = rp.fight_id) AS confusion FROM rp""",
)
def _(m):
    """Written as one file a report and read back."""
    folder = f"{shared_folder(m.spark)}/reports-{uuid.uuid4().hex}"
    reports.write_reports(sanity_reports(m), folder)
    t = reports.read_reports(m.spark, folder, REPORT.replace(" long", ":long").replace(" map", ":map"))
    listed = lambda c: F.array_sort(F.transform(F.map_entries(F.col(f"report.{c}")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))).alias(c)
    return t.select("name", "git_sha", "constants_sha256", "video", "tolerance_frames", "generated_at", "report.events", "report.strikes", listed("type_counts"), listed("confusion"))


@query("S-19", RUNS_SQL + " SELECT run_id, reference_id, scored_id, generated_at, f1, tol FROM ru")
def _(m):
    """Appended in two parts that overlap; a run stays as it was written first."""
    log = reports.RunLog(m.spark, f"{shared_folder(m.spark)}/runs-{uuid.uuid4().hex}")
    every = eval_runs(m)
    log.append(every.where("run_id % 3 < 2"))
    log.append(every.withColumn("f1", F.when(F.col("run_id") % 3 == 1, F.lit(-1.0)).otherwise(F.col("f1"))).where("run_id % 3 > 0"))
    return log.read().select("run_id", "reference_id", "scored_id", "generated_at", "f1", "tol")


SERIES_SQL = (
    FRAMES_SQL
    + """, sn AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY frame, event_id) AS i FROM sg), sd AS (SELECT * FROM sn WHERE i % greatest(1, floor(fps * 5 * 0.5)::INT) = 0),
    so AS (SELECT fight_id, frame, max(k) AS k FROM ev WHERE k % 3 = 0 GROUP BY ALL),
    sj AS (SELECT sd.fight_id, sd.event_id, sd.frame, sd.hit, so.k AS reading FROM sd LEFT JOIN so USING (fight_id) QUALIFY row_number() OVER (PARTITION BY sd.event_id ORDER BY abs(so.frame - sd.frame), so.frame) = 1)"""
)


def series_points(m) -> DataFrame:
    readings = m.events.where("k % 3 = 0").groupBy("fight_id", "frame").agg(F.max("k").alias("reading")).withColumn("event_id", F.lit(0).cast("long"))
    frames = seen_frames(m.events).withColumn("fps", F.col("fps") * 5)
    return series.debug_series(frames, readings, ["reading"], order=("frame", "event_id")).select("fight_id", "event_id", "frame", "hit", "reading")


@query("S-29", SERIES_SQL + " SELECT * FROM sj")
def _(m):
    return series_points(m)


@query("S-22", SERIES_SQL + " SELECT * FROM sj")
def _(m):
    """The same as CSV with a header, the fights dealt to a fixed number of folders, read back."""
    folder = f"{shared_folder(m.spark)}/series-{uuid.uuid4().hex}"
    points = series_points(m)
    reports.write_series(points, folder, "fight_id", ["frame", "event_id"])
    return reports.read_series(m.spark, folder, points.schema, "fight_id")


# ---------------------------------------------------------------- runs


def _fight_name() -> Column:
    return F.concat(F.lit("fight-"), F.col("fight_id").cast("string"))


@query("S-30", "SELECT 'fight-' || fight_id AS name, round_number AS number, start_frame, end_frame FROM rounds WHERE fight_id % 6 > 0")
def _(m):
    """Manifests written, and read for their rounds; every sixth run has found none."""
    folder = f"{shared_folder(m.spark)}/manifests-{uuid.uuid4().hex}"
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame"))), lambda r: F.array(r["start_frame"], r["end_frame"]))
    t = m.fights.select("fight_id", "fps").join(m.rounds.where("fight_id % 6 > 0").groupBy("fight_id").agg(spans.alias("rounds")), "fight_id", "left")
    name = _fight_name()
    runs.write_manifests(
        t.select(
            name.alias("name"), F.lit("2024-01-01T00:00:00").alias("run_at"), F.struct(F.concat(name, F.lit(".mp4")).alias("path"), F.col("fps").cast("double").alias("fps"), F.lit(43200).cast("long").alias("frame_count")).alias("video"),
            F.create_map(F.lit("debug"), F.lit("normal")).alias("args"), F.create_map(F.lit("pose"), F.lit(1.5)).alias("timings_sec"), F.create_map(F.lit("pose"), name).alias("outputs"), F.struct("rounds", F.col("rounds").isNotNull().alias("is_valid")).alias("summary"),
        ), folder,
    )
    return runs.manifest_rounds(m.spark, folder)


@query("S-11", BOXES_SQL + " SELECT 'fight-' || fight_id AS name, 50.0::DOUBLE AS fps, frame, corner AS class_id, [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]::DOUBLE[] AS box, CASE WHEN k % 5 > 0 THEN k / 100 END AS confidence, len(p) AS joints FROM bx")
def _(m):
    """Detections written as nested documents, and loaded again."""
    folder = f"{shared_folder(m.spark)}/detections-{uuid.uuid4().hex}"
    best = m.events.groupBy("fight_id", "corner", F.floor(F.col("frame") / 300).alias("frame")).agg(F.max_by("k", "event_id").alias("k"))
    t = people(m).join(best, ["fight_id", "corner", "frame"])
    box = F.array(*(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")))
    runs.write_detections(t.select(_fight_name().alias("name"), F.lit(50.0).alias("fps"), "frame", box.alias("box"), F.when(F.col("k") % 5 > 0, F.col("k") / 100).alias("confidence"), F.col("corner").alias("class_id"), F.col("skeleton").alias("keypoints")), folder)
    return runs.read_detections(m.spark, folder).select("name", "fps", "frame", "class_id", "box", "confidence", F.when(F.col("keypoints").isNotNull(), F.size("keypoints")).alias("joints"))


@query(
    "S-23",
    """xs AS (SELECT fight_id, list('[' || frame || ',' || corner || ',"' || action || '",' || coalesce(success::INT::VARCHAR, 'null') || ']' ORDER BY frame, event_id) AS s FROM ev WHERE source = 'prediction' AND action IS NOT NULL GROUP BY fight_id), xr AS (SELECT fight_id, list('[' || round_number || ',' || start_frame || ',' || end_frame || ']' ORDER BY round_number) AS r FROM rounds GROUP BY fight_id)
    SELECT 'fight-' || fight_id AS name, 'window.FIGHT = {"fps":50,"rounds":[' || array_to_string(r, ',') || '],"strikes":[' || array_to_string(s, ',') || ']};' AS text FROM xr JOIN xs USING (fight_id)""",
)
def _(m):
    """A script a fight, written and read back line by line."""
    folder = f"{shared_folder(m.spark)}/scripts-{uuid.uuid4().hex}"
    text = lambda *c: F.array(*(F.when(x.isNull(), "null").otherwise(F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)) for x in c))
    listed = lambda *c: F.concat(F.lit("["), F.array_join(text(*c), ","), F.lit("]"))
    joined = lambda rows: F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["t"]), ","), F.lit("]"))
    hits = m.events.where("source = 'prediction' and action is not null").select("fight_id", "frame", "event_id", listed(F.col("frame"), F.col("corner"), F.col("action"), F.col("success").cast("int")).alias("t"))
    hits = hits.groupBy("fight_id").agg(joined(F.array_sort(F.collect_list(F.struct("frame", "event_id", "t")))).alias("strikes"))
    spans = m.rounds.select("fight_id", "round_number", listed(F.col("round_number"), F.col("start_frame"), F.col("end_frame")).alias("t")).groupBy("fight_id").agg(joined(F.array_sort(F.collect_list(F.struct("round_number", "t")))).alias("rounds"))
    whole = F.concat(F.lit('window.FIGHT = {"fps":50,"rounds":'), "rounds", F.lit(',"strikes":'), "strikes", F.lit("};\n"))
    write_files(spans.join(hits, "fight_id").select(_fight_name().alias("name"), whole.alias("text")), folder, ".js")
    return m.spark.read.text(folder).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.js$", 1).alias("name"), F.col("value").alias("text"))


@query("S-24", "SELECT 'fight-' || fight_id AS name, ['mp4', 'MKV', 'Mov'][fight_id % 4 + 1] AS ending, CASE WHEN fight_id % 5 = 0 THEN 'known' ELSE 'new' END AS note FROM fights WHERE fight_id % 4 < 3")
def _(m):
    """Files of several kinds, in folders; what was registered before stays as it is."""
    home = f"{shared_folder(m.spark)}/videos-{uuid.uuid4().hex}"
    for k, ending in enumerate((".mp4", ".MKV", ".Mov", ".txt")):
        write_files(m.fights.where(F.col("fight_id") % 4 == k).select(_fight_name().alias("name"), F.lit("x").alias("text")), f"{home}/in/{k}", ending)
    kept = Store(m.spark, f"{home}/store", "path")
    found = runs.videos(m.spark, f"{home}/in")
    runs.register(kept, found.withColumn("note", F.lit("known")).where(F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 5 == 0))
    runs.register(kept, found.withColumn("note", F.lit("new")))
    return kept.read("videos").select("name", F.regexp_extract("path", r"\.([^.]*)$", 1).alias("ending"), "note")
