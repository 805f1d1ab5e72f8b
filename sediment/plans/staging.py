"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:///tmp/checkpoints/sediment"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where that is unset and all runs on one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    return (path or LOCAL).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage ends, and what it depends on is fixed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of queries that have ended go now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def local_folder(spark: SparkSession) -> str:
    """The shared folder as a path that ``open`` takes; archives are single files on a mounted file system."""
    path = shared_folder(spark)
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} is not mounted: name a mounted folder in spark.checkpoint.dir")
    folder = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(folder, exist_ok=True)
    return folder
