"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import group_key, hex_number, join_sized, materialize, ranked

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more than this many times over.
MAX_REPEAT = 3
#: Up to this many sources their targets are broadcast, else joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: its key ``_source``, ``source_size`` and ``target``.

    The targets share the sum of all sizes by weight. A target stops at
    ``max_repeat`` times its source's size, and the excess goes to the others
    by weight until none is above. That fixed point is water-filling: source s
    gets min(w * level, cap), and sources reach their caps in the order of
    cap / weight, so two running sums give the one level that uses up the total.
    """
    w = [F.lit(int(x)) for x in weights]
    by_source = sized.withColumn("_source", group_key(source)).groupBy("_source", source).agg(F.sum(size).cast("long").alias("source_size"))
    # one row per source from here on: windows without a partition see only those
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    t = by_source.withColumn("_w", F.element_at(F.array(*w), (place % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * max_repeat)
    order = Window.orderBy((F.col("_cap") / F.col("_w")), "_source")
    t = (
        t.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest_w", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
    )
    level = (F.col("_total") - F.col("_full")) / F.col("_rest_w")
    # the level holds from the first source on whose cap is not below it
    open_level = F.when(F.col("_cap") >= F.col("_w") * level, level)
    t = t.withColumn("_level", F.first(open_level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("_source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def mix(docs: DataFrame, size: str, *, key: str = "doc_id", source: str = "source", seed: int = 0, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` and ``taken`` to ``docs``.

    Systematic sampling: inside a source every document is expected
    target / source_size times, so the prefix sum of expected copies up to rank
    r is r times that; with one random offset per source, a document is emitted
    once for each integer that lies between the prefix sums before and after
    it. Documents are lined up by size (then by a seeded hash), which keeps the
    words taken close to the target: neighbours that swap differ little.

    Nulls: a null source is a source of its own, last in order; a null size
    counts as 0; a null key is hashed as the empty string. Repeated rows are
    rows of their own. An empty table gives an empty result. Extra columns stay;
    columns of ``docs`` that have the names of new ones are replaced.
    """
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    shares = source_targets(docs.select(source, size), source, size, weights, max_repeat)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    # own columns travel as one struct, so that none is taken for a helper of the same name
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own")
    t = docs.select(own, F.col(size).alias("_size"), F.col(key).alias("_key"), group_key(source).alias("_source"), hashed.alias("_hash"))
    t = t.withColumn("_z", F.greatest(F.col("_size"), F.lit(1))).withColumn("_p", F.length(F.bin("_z")) - 1)
    # a class for every 16th of an octave of sizes; 256 hashed cells in each
    klass = F.expr("_p * 16 + shiftright((_z - shiftleft(1L, _p)) * 16, _p)")
    t = t.withColumn("_cell", klass.cast("long") * 256 + hex_number(F.col("_hash"), 1, 2))
    t = ranked(t, ["_source"], "_cell", ["_size", "_hash", "_key"], "_rank")
    t = join_sized(t, materialize(shares, "shares"), ["_source"], "inner", BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hex_number(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_source"))), 1, 8) / F.lit(4294967296.0)
    passed = lambda rank: F.floor(offset + rate * rank)
    copies = F.least((passed(F.col("_rank")) - passed(F.col("_rank") - 1)).cast("long"), F.lit(max_repeat).cast("long"))
    t = t.withColumn("_copies", copies)
    return t.select("_own.*", "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def emit(docs: DataFrame, *, size: str | Column, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. ``size``
    is a column or an expression over ``docs``. The rows' own columns travel as one
    struct, so that none is taken for a new column of the same name."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own")
    t = docs.select(own, F.col(key).alias("_key"), F.col(source).alias("_from"), (F.col(size) if isinstance(size, str) else size).alias("_size"))
    mixed = mix(t, "_size", key="_key", source="_from", **options).where("copies > 0")
    return mixed.select("_own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_own.*")
