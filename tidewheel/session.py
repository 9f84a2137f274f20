"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster size the shuffle so that a partition has about 128 MB."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).config(map=settings | conf).getOrCreate()
