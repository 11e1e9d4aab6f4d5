"""Tables whose rows are replaced by key, all at once or not at all.

Every change writes its rows as a new version beside the old ones and then one
commit: a small table of the keys that it replaces, staged and renamed to the next
free number. A rename happens or does not, so a run that ends between two tables
leaves the last version; a second run replaces the first; a key without new rows
has none. Readers join each table with the last commit of each key. Writers take
turns: two at once could take one number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under ``root`` (qualified, shared by all executors) whose rows belong to
    the ``keys``, for example ("source", "fight_id"). Null keys are keys."""

    def __init__(self, spark: SparkSession, root: str, *keys: str):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def replace(self, tables: dict[str, DataFrame], replaced: DataFrame, rows_per_file: int = 0) -> str:
        """Replace all rows of the keys in ``replaced`` by those in ``tables``, which must
        belong to them; returns the version. ``rows_per_file`` bounds the files (0: not)."""
        version = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/tables/{name}/version={version}")
        staged = f"{self.root}/staged/{version}"
        replaced.select(*self.keys).distinct().withColumn("version", F.lit(version)).write.parquet(staged)
        commits = self._path(f"{self.root}/commits")
        self._fs.mkdirs(commits)
        number = max((int(n.partition("=")[2]) for n in self._names("commits")), default=0) + 1
        if not self._fs.rename(self._path(staged), self._path(f"{self.root}/commits/number={number}")):
            raise OSError(f"commit {number} of {self.root} could not be made")
        return version

    def upsert(self, name: str, rows: DataFrame, update: bool = True) -> str:
        """One row a key: rows of known keys replace theirs, or are left out (``update``
        false); others are added."""
        known = self.versions() if not update else None
        if known is not None:
            rows = rows.join(known.select(*self.keys), self._same(rows, known), "left_anti")
        return self.replace({name: rows}, rows)

    def _same(self, a: DataFrame, b: DataFrame):
        same = F.lit(True)
        for k in self.keys:
            same &= a[k].eqNullSafe(b[k])
        return same

    def versions(self) -> DataFrame | None:
        """The version that each key's rows have; None before the first commit."""
        if not self._names("commits"):
            return None
        commits = self.spark.read.parquet(f"{self.root}/commits")
        return commits.groupBy(*self.keys).agg(F.max_by("version", "number").alias("version"))

    def read(self, name: str) -> DataFrame | None:
        """The rows of a table as of the last commit; None if it never had any."""
        versions = self.versions()
        if versions is None or not self._names(f"tables/{name}"):
            return None
        rows = self.spark.read.parquet(f"{self.root}/tables/{name}")
        same = self._same(rows, versions) & (rows["version"] == versions["version"])
        return rows.join(versions, same, "left_semi").drop("version")

    def vacuum(self) -> int:
        """Delete the versions that no key has any more, of failed runs too; returns how
        many. Not for a time when others write."""
        versions = self.versions()
        used = {r.version for r in versions.select("version").distinct().collect()} if versions is not None else set()
        gone = 0
        for table in self._names("tables"):
            for folder in self._names(f"tables/{table}"):
                if folder.partition("=")[2] not in used:
                    self._fs.delete(self._path(f"{self.root}/tables/{table}/{folder}"), True)
                    gone += 1
        for folder in self._names("staged"):
            self._fs.delete(self._path(f"{self.root}/staged/{folder}"), True)
        return gone
