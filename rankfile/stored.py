"""Intermediate tables in the folder that the driver and every executor share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session on one machine names no shared folder.
LOCAL_SHARED = "/tmp/checkpoints/rankfile"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir); what is there goes when the session's file system closes."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{named.rstrip('/') if named else LOCAL_SHARED}/rankfile-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` and reads it back: it is computed once, whatever reads it and however often."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
