"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], str] = {}


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object: works on any shared store."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; it goes when the application ends.

    Where that is unset a local run, as in tests, gets a folder of the machine; a cluster has no such folder, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    key = (spark.sparkContext.applicationId, found or "")
    if key not in _made:
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = found.rstrip("/") if found else f"file://{tempfile.gettempdir()}"
        folder = f"{base}/threadloom-{key[0]}"
        fs, path = file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made[key] = folder
    return _made[key]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes everything staged so far: for long sessions, once the results that read it are written."""
    fs, path = file_system(spark, shared_dir(spark))
    for status in fs.listStatus(path):
        fs.delete(status.getPath(), True)
