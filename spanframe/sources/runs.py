"""What a run leaves behind, its manifest and the detections of each step, and the videos
that it starts from."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.sources.files import write_files
from spanframe.sources.store import Store

#: A run's manifest; other fields of a summary are left out.
MANIFEST = "run_at string, video struct<path:string,fps:double,frame_count:long>, args map<string,string>, timings_sec map<string,double>, outputs map<string,string>, summary struct<rounds:array<array<long>>,is_valid:boolean>"
#: The detections of a step, nested by frame.
DETECTIONS = "fps double, frames array<struct<frame:long,detections:array<struct<bbox_xyxy:array<double>,confidence:double,class_id:int,keypoints:array<array<double>>>>>>"
#: Endings of videos, in any case.
VIDEOS = ("mp4", "mkv", "mov")


def _name() -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")), r"\.json$", "").alias("name")


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(_name(), "*")


def write_manifests(manifests: DataFrame, folder: str) -> int:
    """Write each manifest (name and the columns of MANIFEST) as ``<name>.json``."""
    columns = [c for c in manifests.columns if c != "name"]
    texts = manifests.select("name", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("text"))
    return write_files(texts, folder, ".json", lambda text: json.dumps(json.loads(text), indent=2))


def manifest_rounds(spark: SparkSession, path: str) -> DataFrame:
    """The rounds that runs have found: name, number (from 1), start_frame, end_frame. A run
    without rounds has no row."""
    t = _documents(spark, path, MANIFEST).select("name", F.posexplode("summary.rounds").alias("_i", "_r"))
    return t.select("name", (F.col("_i") + 1).alias("number"), F.get("_r", F.lit(0)).alias("start_frame"), F.get("_r", F.lit(1)).alias("end_frame"))


def write_detections(rows: DataFrame, folder: str) -> int:
    """Write rows (name, fps, frame, box array, confidence, class_id, keypoints) as one
    document a name, nested by frame."""
    found = F.struct(F.col("box").alias("bbox_xyxy"), "confidence", "class_id", "keypoints")
    frames = rows.groupBy("name", "fps", "frame").agg(F.array_sort(F.collect_list(F.struct("class_id", found.alias("d")))).alias("_d"))
    frames = frames.groupBy("name", "fps").agg(F.array_sort(F.collect_list(F.struct("frame", F.transform("_d", lambda x: x["d"]).alias("detections")))).alias("frames"))
    return write_files(frames.select("name", F.to_json(F.struct("fps", "frames"), {"ignoreNullFields": "false"}).alias("text")), folder, ".json")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row a detection: name, fps, frame, box, confidence, class_id, keypoints."""
    t = _documents(spark, path, DETECTIONS).select("name", "fps", F.inline("frames"))
    return t.select("name", "fps", "frame", F.inline("detections")).withColumnRenamed("bbox_xyxy", "box")


def videos(spark: SparkSession, folder: str, endings: tuple[str, ...] = VIDEOS) -> DataFrame:
    """Videos anywhere under ``folder``: path, name (without ending), length. Only the
    files' names and sizes are read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    file = F.element_at(F.split("path", "/"), -1)
    return t.where(F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1)).isin(*endings)).select("path", F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), "length")


def register(store: Store, found: DataFrame) -> None:
    """Add the videos whose path (the store's key) is not there yet; known ones stay."""
    store.upsert("videos", found, update=False)
