"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import materialize, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id in ``links`` the smallest id reachable.

    A large star hangs the larger neighbours of every node on its smallest
    neighbour, a small star the smaller ones; both keep the components, and in
    O(log^2 n) rounds every component is one star around its smallest id. Each
    star is one shuffle by node, where the first neighbour in order is the
    smallest; links never leave the executors.
    """
    now = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"), "links")
    mark = None
    while True:
        last = now
        now = materialize(_small_star(_large_star(now)), "links")
        release(last)
        # a fixed point has the same links: compare their number and hashes
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _neighbours(links: DataFrame) -> DataFrame:
    """Distinct links with ``m``, the smallest v of each u, and ``_new``, null on
    the first link of each u."""
    by_node = Window.partitionBy("u").orderBy("v")
    t = links.withColumn("m", F.first("v").over(by_node)).withColumn("_new", F.lag("v").over(by_node))
    return t.where(F.col("_new").isNull() | (F.col("_new") != F.col("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Links (u > v): every neighbour above u goes to u's smallest neighbour, or
    to u if none is smaller."""
    around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _neighbours(around).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links (u > v): u and its smaller neighbours go to the smallest of them."""
    first = F.col("_new").isNull()
    return _neighbours(links).select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
