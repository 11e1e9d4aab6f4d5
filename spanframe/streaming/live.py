"""The event log as a stream: running totals and tumbling buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.sources.files import shared_folder  # noqa: F401


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming events: fight_id, ts, source ("prediction" or "label"), value, event_id, k."""
    path = f"{sf_dir}/events.parquet"
    # as a pattern: a stream takes a plain path for a folder
    t = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("int")
    return t.select(F.col("user_id").cast("long").alias("fight_id"), "ts", F.when(k % 2 == 0, "prediction").otherwise("label").alias("source"), "value", F.col("event_id").cast("long").alias("event_id"), k.alias("k"))


def live_totals(events: DataFrame, until: str) -> DataFrame:
    """Running totals of each fight up to a time: one state row a fight."""
    return events.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz")).groupBy("fight_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "label").alias("labels"))


def live_buckets(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events of each fight in tumbling buckets. A bucket that the watermark (``late``
    behind the last event) has passed is final: its state is dropped, and later
    events of it are too. In update mode a trigger emits the buckets that it changed, in
    append mode those that became final."""
    # watermarks need an instant: ts is read as UTC, whatever the session's zone
    at = events.withColumn("_at", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    buckets = at.withWatermark("_at", late).groupBy("fight_id", F.window("_at", width).alias("w"))
    day = F.expr("date_add(date'1970-01-01', int(unix_seconds(w.start) div 86400))")
    return buckets.agg(F.count(F.lit(1)).alias("n")).select("fight_id", day.alias("day"), "n")


def as_of_last(emitted: DataFrame, *keys: str) -> DataFrame:
    """Of rows that update mode has emitted (``run_to_table``) each key's last one."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own whose state store keeps keyed state with timers."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def run_to_table(stream: DataFrame, home: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived and return every row that it has emitted,
    with the trigger's number as ``batch``, in this run and in earlier ones with the
    same ``home``: the checkpoint lies there, and a trigger that is repeated after a
    failure writes over its own rows."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/table/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema.add("batch", "long")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/table")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{home}/table")
