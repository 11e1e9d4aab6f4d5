"""The folder that all executors share, and small texts written by tasks as files of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The qualified folder that spark.checkpoint.dir names. Only a local session without
    that setting falls back to its warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def write_files(texts: DataFrame, folder: str, ending: str, change=lambda text: text) -> int:
    """Write each row (name, text) as ``<name><ending>`` into ``folder``, which has a scheme
    and is shared by all executors; returns the number of files. ``change`` may alter a
    text first. A task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if "/" in name:
                    raise ValueError(f"{name!r} is no name of a file")
                with fs.open_output_stream(f"{root}/{name}{ending}", compression=None) as out:
                    out.write(change(text).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return texts.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first().n or 0
