"""Totals and buckets as streams: what is emitted, and that closed buckets leave no state."""

from collections import Counter

from pyspark.sql import functions as F

from spanframe.streaming import live

SCHEMA = "fight_id long, ts timestamp_ntz, source string, value double"


def rows():
    return [(i % 3, f"2024-01-{1 + i // 40:02d} {i % 24:02d}:00:00", "label" if i % 2 else "prediction", 1.0) for i in range(400)]


def files(spark, folder):
    t = spark.createDataFrame(rows(), "fight_id long, ts string, source string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for n, day in enumerate((3, 6, 11)):
        t.where(f"day(ts) < {day} and day(ts) >= {(1, 3, 6)[n]}").coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_update_mode_ends_with_the_batch_result(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    files(spark, folder)
    totals = live.run_to_table(live.live_totals(stream(spark, folder), "2024-01-08 00:00:00"), f"file://{tmp_path}/a", "update")
    want = Counter(r[0] for r in rows() if r[1] <= "2024-01-08 00:00:00")
    assert {r.fight_id: r.n for r in live.as_of_last(totals, "fight_id").collect()} == want
    buckets = live.run_to_table(live.live_buckets(stream(spark, folder)), f"file://{tmp_path}/b", "update")
    assert {(r.fight_id, str(r.day)): r.n for r in live.as_of_last(buckets, "fight_id", "day").collect()} == Counter((r[0], r[1][:10]) for r in rows())


def test_closed_buckets_are_told_once_and_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    files(spark, folder)
    q = live.live_buckets(stream(spark, folder)).writeStream.outputMode("append").format("memory").queryName("closed_buckets").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    told = [(r.fight_id, str(r.day), r.n) for r in spark.table("closed_buckets").collect()]
    want = Counter((r[0], r[1][:10]) for r in rows())
    # the last day is open still: its end lies beyond the watermark
    assert sorted(told) == sorted((*k, n) for k, n in want.items() if k[1] < "2024-01-10")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
