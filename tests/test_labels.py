"""Label documents: defaults, every rule, several passes, and a round trip."""

import json

import pytest
from pyspark.sql import functions as F

from spanframe.sources import labels

WHOLE = {
    "video": "a b.mp4", "fps": 50, "frame_count": 900, "labeler": "x", "labeled_at": "2024", "notes": "",
    "rounds": [{"start": 10, "end": 300, "round": 2, "seeded": True}, {"start": 1, "end": 9}], "excluded": [{"start": 40, "end": 50, "reason": "replay"}],
    "states": [{"start": 101, "end": 200, "state": "GROUND"}, {"start": 1, "end": 100}], "corner_swaps": [{"start": 9, "end": 12}, {"start": 2, "end": 3}],
    "strikes": [{"frame": 77, "fighter": "red", "family": "jab", "target": "head"}, {"frame": 20, "fighter": "blue", "family": "kick", "target": "leg", "landed": False}, {"frame": 20, "fighter": "red", "family": "knee", "target": "unknown", "landed": True}],
    "takedowns": [{"frame": 90, "fighter": "red"}],
}
WRONG = {
    "video": "bad", "fps": 0,
    "strikes": [{"frame": 0, "fighter": "green", "family": "slap", "target": "it's"}, {"frame": 5, "fighter": "red", "family": "jab", "target": None}],
    "takedowns": [{"frame": -1, "fighter": None}], "states": [{"start": 50, "end": 40, "state": "STANDING"}, {"start": 1, "end": 50}, {"start": 60, "end": 70, "state": "CLINCH"}],
    "rounds": [{"start": 5, "end": 4}], "corner_swaps": [{"start": 1, "end": 1}, {"start": 9, "end": 2}],
}
PROBLEMS = [
    "fps must be positive, got 0",
    "strikes[0]: frame 0 is not 1-based",
    "strikes[0]: fighter 'green' not in ('red', 'blue')",
    f"strikes[0]: family 'slap' not in {labels.FAMILIES}",
    f'strikes[0]: target "it\'s" not in {labels.TARGETS}',
    f"strikes[1]: target None not in {labels.TARGETS}",
    "takedowns[0]: frame -1 is not 1-based",
    "takedowns[0]: fighter None not in ('red', 'blue')",
    f"states[0]: state 'STANDING' not in {labels.STATES}",
    "states[0]: end 40 before start 50",
    "state spans overlap: [1,50] and [50,40]",
    "rounds[0]: end 4 before start 5",
    "corner_swaps[1]: end 2 before start 9",
]


@pytest.fixture
def folder(tmp_path):
    for name, doc in (("a b", WHOLE), ("a b.second+one", WHOLE | {"labeler": "y"}), ("a", {"video": "a", "fps": 25}), ("bad", WRONG), ("a bc", {"video": "c", "fps": 25}), ("v.1", {"video": "v", "fps": 25})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    return tmp_path


def test_defaults(spark, folder):
    docs = {r.name: r for r in labels.read_labels(spark, f"file://{folder}").collect()}
    assert set(docs) == {"a b", "a b.second+one", "a", "bad", "a bc", "v.1"}
    a = docs["a"]
    assert (a.frame_count, a.labeler, a.notes, a.rounds, a.strikes) == (0, "", "", [], [])
    b = docs["a b"]
    assert [(r.round, r.seeded) for r in b.rounds] == [(2, True), (1, False)] and [s.state for s in b.states] == ["GROUND", "STRIKING"] and b.strikes[0].landed is None


def test_all_problems_are_told_at_once(spark, folder):
    docs = labels.read_labels(spark, f"file://{folder}")
    found = {r.name: r.e for r in docs.select("name", labels.errors(docs).alias("e")).collect()}
    assert found["bad"] == PROBLEMS and all(e == [] for n, e in found.items() if n != "bad")
    with pytest.raises(Exception, match="13 problem") as e:
        labels.checked(docs).collect()
    assert "problem(s) in labels for bad:" in str(e.value) and PROBLEMS[-1] in str(e.value)
    assert labels.checked(docs.where("name <> 'bad'")).count() == 5


def test_passes(spark, folder):
    docs = labels.read_labels(spark, f"file://{folder}")
    videos = spark.createDataFrame([("a b",), ("a",), ("v",), ("none",)], "video_name string")
    got = sorted((r.video_name, r.place, r.name) for r in labels.passes(docs, videos).collect())
    assert got == [("a", 0, "a"), ("a b", 0, "a b"), ("a b", 1, "a b.second+one"), ("v", 0, "v.1")]


def test_written_documents_are_read_back(spark, folder, tmp_path):
    docs = labels.read_labels(spark, f"file://{folder}").where("name <> 'bad'")
    out = tmp_path / "out"
    for _ in range(2):
        assert labels.write_labels(docs, f"file://{out}") == 5
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{n}.json" for n in ("a b", "a b.second+one", "a", "a bc", "v.1"))
    written = json.loads((out / "a b.json").read_text())
    assert [(s["frame"], s["fighter"]) for s in written["strikes"]] == [(20, "blue"), (20, "red"), (77, "red")] and written["strikes"][2]["landed"] is None
    assert [r["start"] for r in written["rounds"]] == [1, 10] and [c["start"] for c in written["corner_swaps"]] == [9, 2]
    assert (out / "a b.json").read_text().startswith('{\n  "video": "a b.mp4",\n  "fps": 50,')
    again = labels.read_labels(spark, f"file://{out}")
    plain = lambda t: sorted(json.dumps(r.asDict(recursive=True)) for r in t.collect())
    assert plain(again) == plain(labels.ordered(docs))


def test_a_file_that_is_no_document_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text("{no")
    with pytest.raises(Exception, match="(?i)malformed"):
        labels.read_labels(spark, f"file://{tmp_path}").select(F.col("fps")).collect()
