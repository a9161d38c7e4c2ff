"""Folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`); a local session may go without.

    What an application writes there goes when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/reelspark/{spark.sparkContext.applicationId}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(own):
        fs.mkdirs(own)
        fs.deleteOnExit(own)
    return f"{own.toString()}/{name}-{uuid.uuid4().hex}"
