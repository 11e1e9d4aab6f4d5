"""Upserts with null keys, empty sides and columns in another order."""

from spanframe.sources.tables import upsert


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "key long, value string")
    new = spark.createDataFrame([("B", 2), ("D", 4), ("E", None)], "value string, key long")
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    assert rows(upsert(old, new, "key")) == sorted([(1, "a"), (2, "B"), (4, "D"), (None, "c"), (None, "E")], key=str)
    assert rows(upsert(old, new, "key", update=False)) == sorted([(1, "a"), (2, "b"), (4, "D"), (None, "c"), (None, "E")], key=str)
    for update in (True, False):
        assert rows(upsert(old, new.limit(0), "key", update=update)) == rows(old)
        assert rows(upsert(old.limit(0), new, "key", update=update)) == rows(new.select("key", "value"))
