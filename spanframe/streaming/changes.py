"""Changes of state as a feed, and the state of all as a snapshot with what came after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What orders a key's changes: the time, and the number of the write.
ORDER = ("at", "seq")


def change_feed(writes: DataFrame) -> DataFrame:
    """One message a write of a state, also if it writes what was there: fight_id, seq and
    the payload {"id": ..., "state": ...}. ``writes``: fight_id, state, at, seq."""
    return writes.select("fight_id", "seq", F.to_json(F.struct(F.col("fight_id").alias("id"), "state"), {"ignoreNullFields": "false"}).alias("payload"))


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each fight: fight_id, state, at, seq. Streams keep one row a
    fight as state and give, in update mode, the fights that have changed."""
    last = F.max_by(F.struct("state", *ORDER), F.struct(*ORDER))
    return writes.groupBy("fight_id").agg(last.alias("_l")).select("fight_id", "_l.*")


def deltas(writes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Streaming changes that ``snapshot`` (fight_id, state, at, seq, one row a fight) does
    not hold yet. The stream must have begun before the snapshot was taken: then nothing
    falls between the two, and what is in both is told once."""
    known = snapshot.select("fight_id", F.struct(*ORDER).alias("_known"))
    new = F.col("_known").isNull() | (F.struct(*ORDER) > F.col("_known"))
    return latest(writes.join(known, "fight_id", "left").where(new).drop("_known"))


def current(snapshot: DataFrame, emitted: DataFrame) -> DataFrame:
    """The state of each fight: the last of its row in the snapshot and the deltas that
    were emitted for it, in whatever order and however often they arrive."""
    names = ["fight_id", "state", *ORDER]
    return latest(snapshot.select(*names).unionByName(emitted.select(*names)))
