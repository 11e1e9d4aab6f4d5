"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import group_key, hex_number, ranked

#: Cells of the fractional rank; each holds 1/65536 of the rows.
CELLS = 1 << 16


def interleave(docs: DataFrame, shards: int, *, key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """Add ``shard`` and ``slot`` so that every shard matches the mixture.

    Rows of a source are shuffled by a seeded hash and ranked; row r of n has
    the fractional rank (2r - 1) / 2n. All rows are lined up by it (ties: source,
    then hash) and cut into ``shards`` runs whose counts differ by at most one.
    ``slot`` counts from 0 inside a shard without gaps.

    Nulls: a null source is a source of its own; a null key is hashed as the
    empty string. Repeated rows are rows of their own, and rows that tie in all
    of source and key are told apart by all their columns' hash. An empty table
    gives an empty result; columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    # own columns travel as one struct, so that none is taken for a helper of the same name
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    t = docs.select(own, group_key(source).alias("_source"), hashed.alias("_hash"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_tie"))
    t = ranked(t.withColumn("_cell", hex_number(F.col("_hash"), 1, 4)), ["_source"], "_cell", ["_hash", "_tie"], "_rank")
    counts = docs.groupBy(group_key(source).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    t = t.join(counts, "_source").withColumn("_part", (F.col("_rank") * 2 - 1) / (F.col("_n") * 2))
    t = t.withColumn("_cell", F.floor(F.col("_part") * CELLS))
    t = ranked(t, [], "_cell", ["_part", "_source", "_hash", "_tie"], "_at")
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    t = t.join(F.broadcast(total), F.lit(True)).withColumn("_at", F.col("_at") - 1)
    t = t.withColumn("_shard", F.expr(f"_at * {shards} div _total").cast("int"))
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    return t.select("_own.*", F.col("_shard").alias("shard"), (F.col("_at") - first).alias("slot"))
