"""Wide CSV files (a date column and one column for each series) as long panels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import ranked
from .panels import unpivot

# Header names of a date column, in no order.
DATE_NAMES = {"date", "datetime", "timestamp", "time"}


def local_sources(spark: SparkSession, root: str, datasets: set[str] | None = None, frequencies: set[str] | None = None) -> DataFrame:
    """(relative, dataset, frequency, bytes, path) of the files `<dataset>/<frequency>/.../*.csv` below a folder. Frequencies match in any case.

    Spark lists the files; of their contents nothing is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path", F.col("length").alias("bytes"))
    base = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    relative = F.expr("substring(path, locate(base, path) + length(base))")
    rows = found.withColumn("base", F.lit(base)).withColumn("relative", relative).withColumn("_parts", F.split("relative", "/")).filter("size(_parts) >= 3")
    rows = rows.select("relative", F.col("_parts")[0].alias("dataset"), F.col("_parts")[1].alias("frequency"), "bytes", "path")
    if datasets is not None:
        rows = rows.filter(F.col("dataset").isin(*datasets))
    if frequencies is not None:
        rows = rows.filter(F.lower("frequency").isin(*(f.casefold() for f in frequencies)))
    return rows


def timestamp_column(header: list[str]) -> str:
    """The first column named like a date, else the first."""
    return next((c for c in header if c.strip().lower() in DATE_NAMES), header[0])


def resolve_drops(header: list[str], drop: str | list | None) -> set[int]:
    """Source positions to drop: each item is a column name, else its text, else a position. Unknown names and positions fail."""
    items = [x.strip() for x in drop.split(";") if x.strip()] if isinstance(drop, str) else list(drop or [])
    found = set()
    for item in items:
        if str(item) in header:
            found.add(header.index(str(item)))
        elif str(item).lstrip("-").isdigit() and 0 <= int(item) < len(header):
            found.add(int(item))
        else:
            raise ValueError(f"no such series: {item}")
    return found


def read_wide(spark: SparkSession, path: str, date_col: str | None = None, dated: bool = True, targets: list[str] | None = None, drop: str | list | None = None, context: list[str] | None = None, missing: str = "zero") -> tuple[DataFrame, DataFrame]:
    """(panel of (series_id, series_name, t, ts, value), context of (name, t, value)) of a wide CSV.

    Ids are source positions, whatever is dropped. Missing numbers are 0 or fail; infinite ones always fail. Undated files number
    their rows by the first column's values. Every row has its own t; rows of one timestamp stay in file order.
    """
    frame = spark.read.csv(path, header=True)
    key = date_col or timestamp_column(frame.columns)
    series = [c for c in frame.columns if c != key and c not in (context or [])]
    gone = resolve_drops(series, drop)
    if targets is not None and (unknown := [c for c in targets if c not in series]):
        raise ValueError(f"no such target: {unknown}")
    kept = [c for i, c in enumerate(series) if i not in gone and (targets is None or c in targets)]
    order = F.to_timestamp(F.col(f"`{key}`")) if dated else F.col(f"`{key}`").cast("double")
    ts = order if dated else F.lit(None).cast("timestamp")
    rows = frame.select("*", ts.alias("ts"), order.alias("_order"), F.monotonically_increasing_id().alias("_row")).drop(key)
    # ranked inside days (or whole numbers), so that a long file isn't numbered in one task; rows of one timestamp keep their order
    day = F.unix_date(F.to_date("_order")).cast("double") if dated else F.floor("_order").cast("double")
    rows = ranked(rows, [], F.coalesce(day, F.lit(float("-inf"))), ["_order", "_row"], "t").withColumn("t", F.col("t") - 1)
    bad = F.raise_error(F.lit("infinite value")).cast("double")
    none = F.lit(0.0) if missing == "zero" else F.raise_error(F.lit("missing value")).cast("double")

    def clean(long: DataFrame) -> DataFrame:
        v = F.col("value")
        return long.withColumn("value", F.when(v.isNull() | F.isnan(v), none).when(F.abs(v) == float("inf"), bad).otherwise(v))

    ids = F.create_map(*(F.lit(x) for i, c in enumerate(series) for x in (c, i))) if series else F.lit(None)
    panel = clean(unpivot(rows, ["t", "ts"], kept)).withColumn("series_id", F.element_at(ids, F.col("series_name")).cast("long"))
    extra = clean(unpivot(rows, ["t"], context, "name")) if context else spark.createDataFrame([], "t long, name string, value double")
    return panel.select("series_id", "series_name", "t", "ts", "value"), extra.select("name", "t", "value")


def read_transposed(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Series in rows: every other column is a date, parsed where it can be."""
    frame = spark.read.csv(path, header=True)
    days = [c for c in frame.columns if c != id_col]
    long = unpivot(frame, [id_col], days, "label")
    order = {c: i for i, c in enumerate(days)}
    t = F.element_at(F.create_map(*(F.lit(x) for c, i in order.items() for x in (c, i))), F.col("label")).cast("long")
    return long.select(F.col(id_col).cast("long").alias("series_id"), t.alias("t"), F.expr("try_to_timestamp(label)").alias("ts"), "value")
