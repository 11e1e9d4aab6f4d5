"""Snapshot and deltas: no loss and no repeat at the seam."""

import random

from pyspark.sql import functions as F

from spanframe.streaming import changes, live

SCHEMA = "fight_id long, state string, at long, seq long"


def writes(seed, n=200):
    rng = random.Random(seed)
    return [(rng.randrange(12), rng.choice(["queued", "processing", "ready", None]), i // 3, i) for i in range(n)]


def run(spark, folder, home, snapshot):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return live.run_to_table(changes.deltas(stream, snapshot), home, "update")


def rows_of(df):
    return sorted(((r.fight_id, r.state, r.at, r.seq) for r in df.collect()), key=str)


def test_seam(spark, tmp_path):
    rows = writes(1)
    folder, home = f"file://{tmp_path}/in", f"file://{tmp_path}/home"
    every = spark.createDataFrame(rows, SCHEMA)
    # the snapshot has seen 0..119; the stream began at 80, so 80..119 are in both
    snapshot = spark.createDataFrame(rows_of(changes.latest(every.where("seq < 120"))), SCHEMA)
    emitted = None
    for n, (a, b) in enumerate(((80, 110), (110, 121), (121, 160), (160, 200))):
        every.where(f"seq >= {a} and seq < {b}").coalesce(1).write.parquet(f"{folder}/new-{n}")
        if n != 1:  # between two files the query ends and goes on from its checkpoint
            emitted = run(spark, folder, home, snapshot)
    assert rows_of(changes.current(snapshot, emitted)) == rows_of(changes.latest(every))
    told = emitted.collect()
    assert min(r.seq for r in told) >= 120 and len({(r.fight_id, r.seq) for r in told}) == len(told)
    # replayed messages change nothing
    assert rows_of(changes.current(snapshot, emitted.union(emitted))) == rows_of(changes.latest(every))
    again = run(spark, folder, home, snapshot)
    assert rows_of(again.drop("batch")) == rows_of(emitted.drop("batch"))


def test_snapshot_alone_and_stream_alone(spark, tmp_path):
    rows = writes(2, 30)
    every, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    every.write.parquet(f"{tmp_path}/in/new")
    emitted = run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/home", none)
    assert rows_of(changes.current(none, emitted)) == rows_of(changes.latest(every))
    assert rows_of(changes.current(changes.latest(every), none)) == rows_of(changes.latest(every))


def test_feed_tells_every_write(spark):
    t = spark.createDataFrame([(1, "queued", 1, 1), (1, "queued", 1, 2), (2, None, 1, 3)], SCHEMA)
    assert [r.payload for r in changes.change_feed(t).orderBy("seq").collect()] == ['{"id":1,"state":"queued"}', '{"id":1,"state":"queued"}', '{"id":2,"state":null}']
    assert changes.change_feed(t).where(F.col("payload").isNull()).isEmpty()
