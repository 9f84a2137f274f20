"""Prepared panels kept as Parquet under the signature of what they were made from."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import signature, write_json

VERSION = 1


def prepared(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The panel for `config` (which names its sources with size and time): read if its manifest is whole and fits, else built and written anew.

    `root` is a folder that driver and executors share. The manifest is written last, so a build that broke off is never read.
    """
    mark = signature({"version": VERSION, **config})
    folder = Path(root) / mark
    manifest = folder / "manifest.json"
    if manifest.exists():
        try:
            known = json.loads(manifest.read_text())
            if known["version"] == VERSION and known["signature"] == mark and known["status"] == "complete":
                panel = spark.read.parquet(f"{folder}/panel")
                if panel.count() == known["rows"]:
                    return panel
        except Exception:  # a broken cache is built again, whatever broke it
            manifest.unlink()
    build().write.mode("overwrite").parquet(f"{folder}/panel")
    panel = spark.read.parquet(f"{folder}/panel")
    write_json(manifest, {"version": VERSION, "signature": mark, "status": "complete", "rows": panel.count(), "config": config})
    return panel


TOTALS = ("num_series", "num_timestamps", "num_values")


def write_catalog(entries: DataFrame, skipped: DataFrame, path: str, options: dict) -> DataFrame:
    """Writes the catalog of prepared datasets below `path` and gives its head, one row: options, number of datasets and totals.

    entries: (name, csv, config, num_series, num_timestamps, num_values, ...); skipped: (relative, reason). Both stay tables of JSON lines, so a catalog of any length is written by tasks.
    The head is written last.
    """
    entries.write.mode("overwrite").json(f"{path}/datasets")
    skipped.write.mode("overwrite").json(f"{path}/skipped")
    known = entries.sparkSession.read.schema(entries.schema).json(f"{path}/datasets")
    head = known.agg(F.count("*").alias("num_datasets"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOTALS))
    head = head.select(*(F.lit(json.dumps(v) if isinstance(v, list | dict) else v).alias(k) for k, v in options.items()), "*")
    head.write.mode("overwrite").json(f"{path}/catalog")
    return head
