"""Decisions that hold until something else has lasted: latches and dwell times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.operators.folds import fold_arrays
from spanframe.operators.runs import first_mode
from spanframe.operators.segmentation import BLOCK, number_rows


def in_blocks(rows: DataFrame, at: str, margin: Column, block: int) -> DataFrame:
    """Rows in the blocks of ``block`` numbers that need them: their own, and those that
    begin within ``margin`` numbers after them. Adds ``_block`` and ``_own``."""
    home = F.floor(F.col(at) / block)
    t = rows.withColumn("_block", F.explode(F.sequence(home, F.floor((F.col(at) + margin) / block))))
    return t.withColumn("_own", F.col("_block") == home)


# ---------------------------------------------------------------- latches


def latched(rows: DataFrame, key: str, at: str, ask: str, need: str, start: Column, carried: list[str], block: int = BLOCK) -> DataFrame:
    """Where a two-way switch turns: key, at, on, ``carried``.

    ``ask`` is what a row asks for: true, false, or null for neither. The switch turns
    where ``need`` rows in a row (by ``at``: 1, 2, ... in each key) have asked for the
    other way; it begins as ``start``, a column of the key. What rows ask must not depend
    on the switch. As a full run always sets the switch its way, whatever it was before,
    runs are found in blocks with margins, and only the full ones are lined up.
    """
    t = in_blocks(rows, at, F.col(need) + 1, block)
    here = Window.partitionBy(key, "_block").orderBy(at)
    new = ~F.lag(ask).over(here).eqNullSafe(F.col(ask)) | F.lag(at).over(here).isNull()
    began = F.last(F.when(new, F.col(at)), ignorenulls=True).over(here)
    # a run cut by its block's edge has begun before it: longer than the margin, so it is not full just here
    cut = F.last(F.when(new, F.lag(at).over(here).isNull() & (F.col("_block") > 0)), ignorenulls=True).over(here)
    t = t.withColumn("_full", (F.col(at) - began + 1 == F.col(need)) & ~cut & F.col(ask).isNotNull()).where("_full and _own")
    along = Window.partitionBy(key).orderBy(at)
    t = t.withColumn("_was", F.coalesce(F.lag(ask).over(along), start))
    return t.where(F.col(ask) != F.col("_was")).select(key, at, F.col(ask).alias("on"), *carried)


# ---------------------------------------------------------------- votes and dwell times


def voted(rows: DataFrame, key: str, at: str, value: str, width: str, block: int = BLOCK, out: str = "vote") -> DataFrame:
    """Rows with a ``value``, and ``out``: the most frequent of the last ``width`` values
    up to here, of ties the one seen first. The widest window bounds the margin; it is
    asked for once."""
    t = rows.where(F.col(value).isNotNull())
    most = t.agg(F.max(width)).first()[0] or 1
    t = in_blocks(number_rows(t, key, order=[at], block=block, out="_n"), "_n", F.lit(most), block)
    window = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(-(most - 1), 0)
    last = F.collect_list(value).over(window)
    t = t.withColumn("_last", last).where("_own")
    size = F.size("_last")
    values = F.slice("_last", F.greatest(size - F.col(width) + 1, F.lit(1)), F.col(width))
    return t.withColumn(out, first_mode(values)).drop("_last", "_n", "_block", "_own")


def settled(rows: DataFrame, key: str, at: str, value: str, width: str, dwell: str, start: str, block: int = BLOCK) -> DataFrame:
    """Where a state changes: key, at, state. A row's target is the vote over the last
    ``width`` values (null: no vote, the target stays); a state that differs from it
    takes it once ``dwell`` rows have passed since the last change, the first time at
    once. Begins as ``start``. ``at`` numbers a key's rows from 1, those without a value
    too. Only changes of the target go through a fold."""
    votes = voted(rows, key, at, value, width, block).select(key, at, "vote", dwell)
    along = Window.partitionBy(key).orderBy(at)
    # one row a run of equal targets; a block's first row may repeat what came before
    cell = Window.partitionBy(key, F.floor(F.col(at) / block)).orderBy(at)
    runs = votes.withColumn("_new", ~F.lag("vote").over(cell).eqNullSafe(F.col("vote"))).where("_new").drop("_new")
    runs = runs.withColumn("_new", ~F.lag("vote").over(along).eqNullSafe(F.col("vote"))).where("_new").drop("_new")
    last = rows.groupBy(key).agg(F.max(at).alias("_last"))
    runs = runs.join(last, key).withColumn("_until", F.coalesce(F.lead(at).over(along) - 1, F.col("_last")))

    def step(state, c):
        now, changed = state or (start, None)
        out = []
        for a, b, target, rest in zip(c[at].tolist(), c["_until"].tolist(), c["vote"].tolist(), c[dwell].tolist(), strict=True):
            turn = a if changed is None else max(a, changed + rest)
            if target != now and turn <= b:
                now, changed = target, turn
                out.append(turn)
            else:
                out.append(None)
        return (now, changed), [out]

    return fold_arrays(runs, step, [at, "_until", "vote", dwell], "turn long", key, order=[at]).where("turn is not null").select(key, F.col("turn").alias(at), F.col("vote").alias("state"))


#: Torsos nearer than this share of the fighters' scale are entangled.
GRAPPLING_RATIO = 0.11
#: Seconds of the vote's window and of the shortest stay in a state.
VOTE_SECONDS, DWELL_SECONDS = 0.5, 0.75


def fight_state(distance: Column, scale_a: Column, scale_b: Column, grounded: Column) -> Column:
    """What a frame speaks for: nothing if a distance or scale is unknown."""
    far = distance >= GRAPPLING_RATIO * (scale_a + scale_b) / 2
    return F.when(far, "STRIKING").when(~far & F.coalesce(grounded, F.lit(False)), "GROUND").when(~far, "CLINCH")
