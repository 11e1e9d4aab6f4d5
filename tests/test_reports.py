"""Reports as files, the log of runs, and thinned series."""

import json
import random

from pyspark.sql import functions as F

from spanframe.operators import series
from spanframe.plans import QUERIES
from spanframe.sources import reports


def test_reports_are_read_back(spark, tmp_path):
    cells = F.array(*(F.struct(F.lit(a).alias("truth"), F.lit(b).alias("pred"), F.lit(n).alias("n")) for a, b, n in (("jab", "cross", 2), ("x", "y>z", 1))))
    t = spark.createDataFrame([("one", 12), ("two", None)], "name string, tolerance_frames long").select(
        "name", "tolerance_frames", F.lit("abc").alias("git_sha"), F.lit(None).cast("string").alias("constants_sha256"), F.lit("v.mp4").alias("video"), F.lit("now").alias("generated_at"),
        F.struct(F.lit(0.5).alias("f1"), reports.cells_json(cells).alias("confusion")).alias("report"),
    )
    for _ in range(2):
        assert reports.write_reports(t, f"file://{tmp_path}/r") == 2
    raw = (tmp_path / "r/two.json").read_text()
    assert list(json.loads(raw)) == list(reports.ENVELOPE) and raw.endswith("}\n") and json.loads(raw)["tolerance_frames"] is None
    got = {r.name: r for r in reports.read_reports(spark, f"file://{tmp_path}/r", "f1:double,confusion:map<string,long>").collect()}
    assert got["one"].tolerance_frames == 12 and got["two"].constants_sha256 is None
    assert got["one"].report.f1 == 0.5 and got["one"].report.confusion == {"jab>cross": 2, "x>y>z": 1}


def test_a_run_is_logged_once(spark, tmp_path):
    log = reports.RunLog(spark, f"file://{tmp_path}/log")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id long, f1 double")
    assert log.read() is None
    log.append(rows((1, 0.1), (2, 0.2)))
    log.append(rows((2, 0.9), (3, 0.3)))
    assert sorted(map(tuple, log.read().collect())) == [(1, 0.1), (2, 0.2), (3, 0.3)]


def test_series(spark):
    rng, frames, readings, want = random.Random(3), [], [], {}
    for fight, fps in ((1, 5.0), (2, 1.0), (3, 24.0), (4, 9.0)):
        own = sorted(rng.sample(range(400), 120))
        read = {f: f * 10 + fight for f in rng.sample(range(400), 30)} if fight != 4 else {}
        frames += [(fight, f, f, fps, "x") for f in own]
        readings += [(fight, f, 0, v) for f, v in read.items()]
        for f in own[max(1, int(fps * 0.5)) - 1 :: max(1, int(fps * 0.5))]:
            want[fight, f] = read[min(read, key=lambda g: (abs(g - f), g))] if read else None
    t = spark.createDataFrame(frames, "fight_id long, frame long, event_id long, fps double, note string")
    r = spark.createDataFrame(readings, "fight_id long, frame long, event_id long, v long")
    for block in (32, 8192):
        assert {(x.fight_id, x.frame): x.v for x in series.debug_series(t, r, ["v"], block=block).collect()} == want


def test_series_share_a_fixed_number_of_files(spark, tmp_path):
    schema = "fight_id long, event_id long, frame long, hit boolean, reading int"
    rows = [(f if f else None, e, 90 - e // 2, [True, False, None][e % 3], e if e % 4 else None) for f in range(300) for e in range(6)]
    t = spark.createDataFrame(rows, schema)
    folder = f"file://{tmp_path}/series"
    reports.write_series(t.repartition(3), folder, "fight_id", ["frame", "event_id"])
    files = list((tmp_path / "series").glob("folder=*/*.csv"))
    assert 32 < len(files) == len({f.parent for f in files}) <= reports.SERIES_FOLDERS
    whole = reports.read_series(spark, folder, t.schema, "fight_id")
    assert whole.schema == t.schema and sorted(map(repr, map(tuple, whole.collect()))) == sorted(map(repr, rows))
    one = reports.read_series(spark, folder, t.schema, "fight_id", only=7)
    assert sorted(map(repr, map(tuple, one.collect()))) == sorted(repr(r) for r in rows if r[0] == 7)
    assert one.select(F.input_file_name()).distinct().count() == 1
    for f in files:
        head, *lines = f.read_text().splitlines()
        assert head == "fight_id,event_id,frame,hit,reading"
        keys = [tuple(int(x) if x.strip('"') else -1 for x in (r.split(",")[i] for i in (0, 2, 1))) for r in lines]
        assert keys == sorted(keys)


def test_files_of_s22_do_not_grow_with_the_fights(spark):
    t = QUERIES["S-22"](spark, "/root/testdata/sf0.01")
    fights = t.select("fight_id").distinct().count()
    assert len(t.inputFiles()) <= reports.SERIES_FOLDERS < fights
