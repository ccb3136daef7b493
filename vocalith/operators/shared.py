"""Folders that driver and executors share, and tables settled there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def job_dir(spark: SparkSession, name: str) -> str:
    """A folder that all executors share: under spark.checkpoint.dir where it is named, which only a local session may leave out.

    It is given in full, with its file system, so that an executor resolves it as the driver does.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vocalith")
    return qualified(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4()}")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the file system that Spark takes it to be on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from those files."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(job_dir(df.sparkSession, "settled"))
    return df.checkpoint()
