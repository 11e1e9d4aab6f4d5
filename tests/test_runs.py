"""Manifests, nested detections and scans of videos."""

import json

import pytest

from spanframe.sources import runs
from spanframe.sources.store import Store


def test_rounds_of_manifests(spark, tmp_path):
    for name, summary in (("a", {"rounds": [[1, 9], [20, 30]], "more": 1}), ("b", {"rounds": []}), ("c", {"is_valid": False})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"run_at": "now", "python": "3", "video": {"path": "x", "width": 4}, "args": {}, "summary": summary}, indent=2))
    got = runs.manifest_rounds(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 9), ("a", 2, 20, 30)]
    (tmp_path / "d.json").write_text("[1")
    with pytest.raises(Exception, match="(?i)malformed"):
        runs.manifest_rounds(spark, f"file://{tmp_path}").collect()


def test_detections_are_nested_by_frame(spark, tmp_path):
    rows = [("v", 25.0, 2, [0.0, 0.0, 1.0, 1.0], None, 1, None), ("v", 25.0, 1, [1.0, 1.0, 2.0, 2.0], 0.5, 0, [[1.0, 2.0, 0.9]]), ("v", 25.0, 2, [3.0, 3.0, 4.0, 4.0], 0.7, 0, None)]
    t = spark.createDataFrame(rows, "name string, fps double, frame long, box array<double>, confidence double, class_id int, keypoints array<array<double>>")
    assert runs.write_detections(t, f"file://{tmp_path}/d") == 1
    raw = json.loads((tmp_path / "d/v.json").read_text())
    assert [f["frame"] for f in raw["frames"]] == [1, 2] and [d["class_id"] for d in raw["frames"][1]["detections"]] == [0, 1]
    assert raw["frames"][1]["detections"][1]["confidence"] is None
    assert sorted(map(str, map(tuple, runs.read_detections(spark, f"file://{tmp_path}/d").select(*t.columns).collect()))) == sorted(map(str, rows))


def test_videos_are_registered_once(spark, tmp_path):
    for name in ("a.mp4", "sub/b.MOV", "sub/deep/c d.mkv", "notes.txt", "mp4", "e.mp4.part"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
    found = runs.videos(spark, f"file://{tmp_path}/in")
    assert sorted((r.name, r.length) for r in found.collect()) == [("a", 5), ("b", 5), ("c d", 5)]
    store = Store(spark, f"file://{tmp_path}/store", "path")
    runs.register(store, found.where("name = 'a'"))
    (tmp_path / "in/a.mp4").write_text("1")
    runs.register(store, runs.videos(spark, f"file://{tmp_path}/in"))
    assert sorted((r.name, r.length) for r in store.read("videos").collect()) == [("a", 5), ("b", 5), ("c d", 5)]
