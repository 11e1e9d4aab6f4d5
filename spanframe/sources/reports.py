"""Reports with their provenance, as files and as rows of a log that only grows; series as CSV."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanframe.sources.files import write_files
from spanframe.sources.store import Store

#: What surrounds a report, in order.
ENVELOPE = ("git_sha", "constants_sha256", "video", "tolerance_frames", "generated_at", "report")
#: Folders that the keys of series share, so that files grow in size and not in number.
SERIES_FOLDERS = 64


def cells_json(cells: Column) -> Column:
    """A confusion (an array of structs truth, pred, n) as a map "truth>pred" to n."""
    return F.map_from_entries(F.transform(cells, lambda c: F.struct(F.concat(c["truth"], F.lit(">"), c["pred"]), c["n"])))


def enveloped(reports: DataFrame) -> DataFrame:
    """Add ``text``: the columns ENVELOPE as one JSON object; what is null stays, as null."""
    return reports.withColumn("text", F.to_json(F.struct(*ENVELOPE), {"ignoreNullFields": "false"}))


def write_reports(reports: DataFrame, folder: str) -> int:
    """Write each report (name and ENVELOPE) as ``<name>.json``, indented."""
    return write_files(enveloped(reports), folder, ".json", lambda text: json.dumps(json.loads(text), indent=2) + "\n")


def read_reports(spark: SparkSession, path: str, report: str) -> DataFrame:
    """Reports under ``path``: name and ENVELOPE. ``report`` is the DDL of what they hold;
    what they have beyond it is left out. A file that is no JSON object fails."""
    schema = f"git_sha string, constants_sha256 string, video string, tolerance_frames long, generated_at string, report struct<{report}>"
    t = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return t.select(F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")), r"\.json$", "").alias("name"), *ENVELOPE)


def _series_folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SERIES_FOLDERS)).cast("int")


def write_series(points: DataFrame, folder: str, key: str, order: list[str]) -> None:
    """Write ``points`` as CSV with a header into SERIES_FOLDERS folders by the hash of their
    key; the rows of a key (a long) lie together in one of them, by ``order``."""
    t = points.withColumn("folder", _series_folder(F.col(key))).repartition("folder")
    t.sortWithinPartitions("folder", key, *order).write.partitionBy("folder").option("header", True).csv(folder)


def read_series(spark: SparkSession, folder: str, schema: StructType, key: str, only: int | None = None) -> DataFrame:
    """What ``write_series`` wrote; the series of ``only`` is looked for in its own folder."""
    t = spark.read.schema(schema).option("header", True).csv(folder)
    if only is not None:
        place = spark.range(1).select(_series_folder(F.lit(only).cast("long"))).first()[0]
        t = t.where((F.col("folder") == place) & (F.col(key) == only))
    return t.select(*schema.names)


class RunLog:
    """Scorings, each once: a run that is there already is not written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root, "run_id")

    def append(self, runs: DataFrame) -> None:
        """``runs``: run_id, what they compare, and the provenance of the envelope."""
        self.store.upsert("runs", runs, update=False)

    def read(self) -> DataFrame | None:
        return self.store.read("runs")
