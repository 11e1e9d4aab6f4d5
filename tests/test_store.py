"""Replacing rows by key: twice, half-way, and beside other keys."""

import pytest
from pyspark.sql import functions as F

from spanframe.sources.store import Store

EVENTS = "source string, fight_id long, frame long"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def seen(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", "source", "fight_id")


def test_a_second_run_leaves_one_version(spark, store):
    assert store.read("events") is None and store.versions() is None
    labels = events(spark, [("label", 1, 5), ("label", None, 6)])
    store.replace({"events": labels}, labels)
    first = events(spark, [("prediction", 1, 10), ("prediction", 1, 11), ("prediction", 2, 12)])
    for _ in range(2):
        store.replace({"events": first, "rounds": first}, first)
        assert seen(store.read("events").where("source = 'prediction'")) == seen(first)
    assert seen(store.read("rounds")) == seen(first)
    # fight 1 is processed again and has no events any more; fight 2 and the labels stay
    store.replace({"events": first.limit(0), "rounds": first.limit(0)}, first.where("fight_id = 1"))
    assert seen(store.read("events").where("source = 'prediction'")) == [("prediction", 2, 12)]
    assert sorted(r.frame for r in store.read("events").where("source = 'label'").collect()) == [5, 6]


def test_a_run_that_ends_between_two_tables_changes_nothing(spark, store):
    old = events(spark, [("prediction", 1, 1)])
    store.replace({"events": old, "rounds": old}, old)
    new = events(spark, [("prediction", 1, 2)])
    broken = new.withColumn("frame", F.raise_error("lost").cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.replace({"events": new, "rounds": broken}, new)
    assert seen(store.read("events")) == seen(store.read("rounds")) == seen(old)
    store.replace({"events": new, "rounds": new}, new)
    assert seen(store.read("events")) == seen(store.read("rounds")) == seen(new)
    assert store.vacuum() >= 3 and store.vacuum() == 0
    assert seen(store.read("events")) == seen(new)


def test_upserts_are_stored(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", "name")
    rows = lambda *r: spark.createDataFrame(list(r), "name string, v int")
    store.upsert("t", rows(("a", 1), (None, 2)))
    store.upsert("t", rows(("a", 3), ("b", 4)))
    assert sorted(map(str, seen(store.read("t")))) == ["('a', 3)", "('b', 4)", "(None, 2)"]
    store.upsert("t", rows(("a", 9), (None, 9), ("c", 5)), update=False)
    assert sorted(map(str, seen(store.read("t")))) == ["('a', 3)", "('b', 4)", "('c', 5)", "(None, 2)"]


def test_files_are_bounded(spark, store, tmp_path):
    rows = spark.range(2500).select(F.lit("prediction").alias("source"), F.lit(1).cast("long").alias("fight_id"), F.col("id").alias("frame")).coalesce(1)
    version = store.replace({"events": rows}, rows, rows_per_file=1000)
    assert len(list((tmp_path / f"store/tables/events/version={version}").glob("*.parquet"))) == 3
    assert store.read("events").count() == 2500
