"""Tables in the folder that driver and executors share, for results that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Where it is unset a local session gets a temporary folder, as in tests; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write a table and read it again: what made it runs once, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stash_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete a stashed table that nothing will read again."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

