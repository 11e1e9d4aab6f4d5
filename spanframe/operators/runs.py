"""Runs of equal values and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_run(df: DataFrame, value: str, *keys: str, order: list[str], out: str = "run") -> DataFrame:
    """Number the runs of equal non-null ``value`` from 1; nulls are dropped and
    a run continues across them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = df.where(F.col(value).isNotNull())
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return t.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def run_lengths(df: DataFrame, value: str, *keys: str, order: list[str]) -> DataFrame:
    """One row per run: keys, run, value, n, first and last of ``order[0]``."""
    t = with_run(df, value, *keys, order=order)
    return t.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def flagged_runs(df: DataFrame, flag: Column, least: int, *keys: str, order: list[str]) -> DataFrame:
    """Maximal runs of consecutive rows with ``flag``, at least ``least`` long."""
    t = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(*order)
    t = t.withColumn("_island", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_flag")
    t = t.groupBy(*keys, "_island").agg(F.min(order[0]).alias("start_frame"), F.max(order[0]).alias("end_frame"), F.count(F.lit(1)).alias("n"))
    return t.where(F.col("n") >= least).drop("_island")


def rolling_sum(df: DataFrame, value: str, width: Column, *keys: str, order: list[str], out: str) -> DataFrame:
    """Sum over the last ``width`` rows, where width may differ from key to key: a
    difference of two prefix sums, joined by row number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    t = df.withColumn("_i", F.row_number().over(w)).withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_i") - width)
    past = t.select(*keys, F.col("_i").alias("_from"), F.col("_sum").alias("_past"))
    return t.join(past, [*keys, "_from"], "left").withColumn(out, F.col("_sum") - F.coalesce("_past", F.lit(0))).drop("_i", "_sum", "_from", "_past")


def first_mode(values: Column) -> Column:
    """The most frequent element of an array; of ties the one that comes first."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
    return F.array_max(counts)["v"]


def rolling_mode(df: DataFrame, value: str, half: int, *keys: str, order: list[str], out: str) -> DataFrame:
    """Mode of the non-null values within ``half`` rows to either side."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(out, first_mode(F.collect_list(value).over(w)))


def upper_median(values: Column) -> Column:
    """Of an array with an even count the upper of the two middle elements."""
    s = F.sort_array(values)
    return F.get(s, F.expr("0") + F.floor(F.size(s) / 2).cast("int"))
