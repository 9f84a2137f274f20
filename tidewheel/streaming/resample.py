"""Resampling of a stream: a tumbling window with a watermark. The batch engine's calendar bins, kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panels import cents


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Events from Parquet files that arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(series_id, ts, c) by hour. State is one sum for each series and open hour; an hour closes when the watermark passes it, and later rows are dropped."""
    binned = stream.withWatermark("ts", late).groupBy(F.col("user_id").alias("series_id"), F.window("ts", "1 hour").alias("w"))
    return binned.agg(F.sum(cents(F.col("value"))).alias("c")).select("series_id", F.col("w.start").alias("ts"), "c")


def write_hourly(stream: DataFrame, out: str, checkpoint: str, late: str = "2 hours"):
    """Append closed hours as Parquet; a restarted query goes on where its checkpoint says."""
    return hourly(stream, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
