"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with
    the scheme of Hadoop's default file system where it has none, so that it is the
    same place for Spark and for the file readers inside tasks.

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is made, once for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spanframe-")
        named = _own_dirs[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}".rstrip("/")


_own_dirs: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/spanframe-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int) -> DataFrame:
    """Join with a materialized ``right``; broadcast it only if it has at most
    ``limit`` rows, else leave the shuffle join (and AQE) to Spark."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send Python workers at most ``rows`` rows at once, unless the session has
    its own number: whole texts of 10,000 documents, as by default, fill them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


# ---------------------------------------------------------------- columns


def words(text: Column) -> Column:
    """array<string> of the words of ``text``; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_key(col: str) -> Column:
    """A never-null string that is equal for equal values, nulls included."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(col).cast("string")))


def hex_number(hexes: Column, first: int, digits: int) -> Column:
    """``digits`` hexadecimal digits from position ``first`` on, as a long."""
    return F.conv(F.substring(hexes, first, digits), 16, 10).cast("long")


def ranked(df: DataFrame, group: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Add ``out``: the 1-based rank of each row in its group by (cell, *order).

    ``group`` columns must not be null. ``cell`` is an integer that grows with
    the order and cuts a group into many parts, so that a group with a third of
    all rows is ranked by many tasks: rows are numbered inside their cell, and
    the cells' counts (one row per group and cell, two levels of prefix sums)
    give what lies before it. No row of ``df`` is sorted outside its cell.
    """
    cells = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_coarse", F.expr(f"{cell} div 256"))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    fine = cells.withColumn("_inner", F.coalesce(F.sum("_n").over(before([*group, "_coarse"], cell)), F.lit(0)))
    coarse = cells.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_m"))
    coarse = coarse.withColumn("_outer", F.coalesce(F.sum("_m").over(before(group, "_coarse")), F.lit(0)))
    offsets = fine.join(coarse, [*group, "_coarse"]).select(*group, cell, (F.col("_inner") + F.col("_outer")).alias("_before"))
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)).cast("long"))
    return inside.join(offsets, [*group, cell]).withColumn(out, F.col("_row") + F.col("_before")).drop("_row", "_before")


# ---------------------------------------------------------------- numpy, inside tasks

_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise uint64 hashes so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers.up) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        m = max(n, 1 << 16)
        _powers.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _P)]), dtype=np.uint64)
        _powers.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, inverse)]), dtype=np.uint64)
    return _powers.up[:n], _powers.down[:n]


_powers.up = _powers.down = np.zeros(0, dtype=np.uint64)


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and len(texts)+1 bounds
    into them. ``lower`` folds A-Z only."""
    if not texts:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    if lower:
        data = _LOWER[data]
    up, down = _powers(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    sums = total[end - 1] - np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashes = mix64(sums * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, bounds.astype(np.int64)


def hash_grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (empty if there are fewer)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = out * _P + word_hashes[i : i + m]
    return mix64(out)


def worker_memory(name, make):
    """What an operator keeps in a Python worker from task to task. A worker keeps
    the memory of one operator only: the last."""
    if name not in _memory:
        _memory.clear()
        give_back()
        _memory[name] = make()
    return _memory[name]


_memory: dict = {}


def give_back() -> None:
    """Return what a task has freed to the system: Python workers live on, and the
    next stage's executor memory also holds what they keep."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def in_slices(rows: list, size, most: int = 1 << 20) -> Iterator[list]:
    """Cut ``rows`` into runs of about ``most`` bytes, so that the arrays made
    of them stay small whatever Arrow's batch size; one huge row is a run."""
    run, held = [], 0
    for row in rows:
        run.append(row)
        held += size(row)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run
