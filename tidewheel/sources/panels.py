"""Long panels (series_id, variate, t, ts, c) from tables of events: binned, densified, with values in integer hundredths.

Sums over integers don't depend on their order, so every statistic built on them is exact and repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL = ["series_id", "variate", "t", "ts", "c"]
#: Calendar bins by name.
UNITS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def date_grid(frame: DataFrame, unit: str = "hour", ts: str = "ts") -> DataFrame:
    """(t, ts): every bin from the first to the last of `frame`, numbered from 0. One row of bounds is aggregated; the grid is made from it."""
    bounds = frame.agg(F.min(F.date_trunc(unit, ts)).alias("lo"), F.max(F.date_trunc(unit, ts)).alias("hi"))
    step = "interval 1 month" if unit == "month" else f"interval {UNITS[unit]}"
    return bounds.select(F.posexplode(F.expr(f"sequence(lo, hi, {step})")).alias("t", "ts")).select(F.col("t").cast("long").alias("t"), "ts")


def aggregate(how: str, value: Column, ts: Column) -> Column:
    """How the values of a bin become one: sum, mean, first or last of those that aren't null."""
    known = F.when(value.isNotNull(), value)
    return {"sum": F.sum(known), "mean": F.avg(known), "first": F.min_by(known, F.when(value.isNotNull(), ts)), "last": F.max_by(known, F.when(value.isNotNull(), ts))}[how]


def resample(frame: DataFrame, unit: str, how: str = "sum") -> DataFrame:
    """(series_id, variate, ts, c) by calendar bin of rows (series_id, variate, ts, c): partial sums are combined before the shuffle."""
    return frame.groupBy("series_id", "variate", F.date_trunc(unit, "ts").alias("ts")).agg(aggregate(how, F.col("c"), F.col("ts")).alias("c"))


#: Dates of a block of a dense panel.
DATES = 256


def densify(binned: DataFrame, grid: DataFrame, missing: str = "zero", keys: DataFrame | None = None) -> DataFrame:
    """Every series and variate at every bin of the grid. An absent bin is 0 (`zero`), stays null (`keep`), or fails (`error`).

    The grid has one row for each bin, so it is broadcast. Only known bins are shuffled: they meet in blocks of dates, whose other dates are filled in where the block is. A null key
    equals none, so its bins are all absent. `keys` are the distinct (series_id, variate), if they are known from elsewhere, with other columns that every row gets. A panel of zeros and
    whole numbers carries its known bins, from which windows are cut without its other dates (`blocks.windows`).
    """
    keys = binned.select("series_id", "variate").distinct() if keys is None else keys
    more = [c for c in keys.columns if c not in ("series_id", "variate")]
    dates = grid.groupBy(F.floor(F.col("t") / DATES).alias("block")).agg(F.sort_array(F.collect_list(F.struct("t", "ts"))).alias("dates"))
    known = binned.join(F.broadcast(grid), "ts").select("series_id", "variate", "t", "c").filter("series_id is not null and variate is not null and c is not null")
    cells = known.select("series_id", "variate", F.floor(F.col("t") / DATES).alias("block"), F.struct("t", "c").alias("cell"), *(F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in more))
    every = keys.join(F.broadcast(dates.select("block"))).select("series_id", "variate", "block", F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), *more)
    met = cells.unionByName(every).groupBy("series_id", "variate", "block").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"), *(F.max(c).alias(c) for c in more))
    value = lambda t: F.try_element_at("cells", t)
    filled = {"zero": lambda v: F.coalesce(v, F.lit(0)), "keep": lambda v: v, "error": lambda v: F.coalesce(v, F.raise_error(F.lit("missing value")).cast("long"))}[missing]
    rows = met.join(F.broadcast(dates), "block").select("series_id", "variate", F.inline(F.transform("dates", lambda d: F.struct(d["t"].alias("t"), d["ts"].alias("ts"), filled(value(d["t"])).alias("c")))), *more)
    out = rows.select("series_id", "variate", "t", "ts", "c", *more)
    out.grid = grid
    if missing == "zero" and dict(binned.dtypes)["c"] == "bigint" and not more:
        out.known, out.keys = known, keys
    return out


def events_hourly(spark: SparkSession, sf_dir: str, how: str = "sum", missing: str = "zero") -> DataFrame:
    """Users' event values by hour."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("series_id"), F.lit(0).alias("variate"), "ts", cents(F.col("value")).alias("c"))
    return densify(resample(rows, "hour", how), date_grid(events), missing, rows.select("series_id", "variate").distinct())


def events_hourly_mv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variates: value and number of events."""
    events = table(spark, sf_dir, "events")
    base = events.select(F.col("user_id").alias("series_id"), "ts", cents(F.col("value")).alias("c"))
    rows = base.withColumn("variate", F.lit(0)).unionByName(base.withColumn("variate", F.lit(1)).withColumn("c", F.lit(1).cast("long")))
    return densify(resample(rows, "hour"), date_grid(events), keys=base.select("series_id").distinct().select("series_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variate")))


def ship_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' quantity and price by week of shipment."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").alias("ts"), cents(F.col("l_quantity")).alias("q"), cents(F.col("l_extendedprice")).alias("p"))
    rows = lines.select("series_id", "ts", F.posexplode(F.array("q", "p")).alias("variate", "c"))
    return densify(resample(rows, "week"), date_grid(lines, "week"))


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' order totals by month, with region as cluster."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.col("c_nationkey").alias("series_id"), F.lit(0).alias("variate"), F.col("o_orderdate").alias("ts"), cents(F.col("o_totalprice")).alias("c"))
    panel = densify(resample(rows, "month"), date_grid(orders, "month", "o_orderdate"))
    return panel.join(F.broadcast(nation.select(F.col("n_nationkey").alias("series_id"), F.col("n_name").alias("series_name"), F.col("n_regionkey").alias("cluster_id"))), "series_id")


def asfreq(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Values at exactly the grid's timestamps, without aggregation; a bin without such a row is 0."""
    exact = rows.groupBy("series_id", "variate", "ts").agg(F.min("c").alias("c"))
    return densify(exact, grid)


def wide(panel: DataFrame, names: list | None = None, prefix: str = "serie_") -> DataFrame:
    """One row for each date, one column for each series (of variate 0): for exports at the edge of the engine only."""
    one = panel.filter("variate = 0").withColumn("name", F.concat(F.lit(prefix), "series_id"))
    return one.groupBy("t", "ts").pivot("name", names).agg(F.first("c")).orderBy("t")


def unpivot(frame: DataFrame, keys: list[str], columns: list[str], name: str = "series_name", value: str = "value") -> DataFrame:
    """Long rows of a wide frame's named columns, with numbers cast leniently."""
    return frame.select(*keys, *(F.col(f"`{c}`").try_cast("double").alias(c) for c in columns)).unpivot(keys, columns, name, value)


def numbered(frame: DataFrame, ts: str) -> DataFrame:
    """`frame` with t, the rank of each distinct timestamp from 0."""
    days = frame.select(ts).distinct().withColumn("t", (F.row_number().over(Window.orderBy(ts)) - 1).cast("long"))
    return frame.join(F.broadcast(days), ts)


def check_shapes(panel: DataFrame, context: DataFrame | None = None, shared: DataFrame | None = None) -> tuple[int, int, int]:
    """(series, variates, dates) of a whole panel, else an error: every series and variate has each date once, from 0.

    context: (series_id, name, t, value) has for every series and name one value (t null) or one for each date; shared: (name, t, value) likewise. Counts are
    aggregated; only the first fault comes to the driver.
    """
    lines = panel.groupBy("series_id", "variate").agg(F.count("*").alias("n"), F.count_distinct("t").alias("dates"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    size = lines.agg(F.count("*").alias("lines"), F.count_distinct("series_id").alias("series"), F.count_distinct("variate").alias("variates"), F.max("dates").alias("dates")).first()
    if not size.lines:
        raise ValueError("the panel is empty")
    if size.lines != size.series * size.variates:
        raise ValueError("a series lacks a variate")
    dates = size.dates
    if (bad := lines.filter((F.col("n") != dates) | (F.col("dates") != dates) | (F.col("lo") != 0) | (F.col("hi") != dates - 1)).head()) is not None:
        raise ValueError(f"series {bad.series_id}, variate {bad.variate} has {bad.n} rows for {dates} dates")

    def covered(rows: DataFrame, by: list[str]) -> DataFrame:
        got = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("t").alias("dated"), F.count_distinct("t").alias("dates"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        static = (F.col("n") == 1) & (F.col("dated") == 0)
        whole = (F.col("n") == dates) & (F.col("dates") == dates) & (F.col("lo") == 0) & (F.col("hi") == dates - 1)
        if (bad := got.filter(~(static | F.coalesce(whole, F.lit(False)))).head()) is not None:
            raise ValueError(f"context {bad.asDict()} must have 1 or {dates} dates")
        return got

    if shared is not None:
        covered(shared, ["name"])
    if context is not None:
        had = covered(context, ["series_id", "name"]).groupBy("name").agg(F.count("*").alias("n"))
        known = context.select("series_id").distinct().join(panel.select("series_id").distinct(), "series_id", "left_anti")
        if (bad := had.filter(F.col("n") != size.series).head()) is not None or not known.isEmpty():
            raise ValueError("a context must have values for exactly the panel's series" + (f": {bad.name} has {bad.n} of {size.series}" if bad else ""))
    return size.series, size.variates, dates


def checked_indices(asked: list[int] | None, n: int) -> list[int]:
    """Positions of an axis of n, all if none are asked for."""
    out = list(range(n)) if asked is None else [int(i) for i in asked]
    if not out:
        raise ValueError("no positions")
    if bad := [i for i in out if not 0 <= i < n]:
        raise IndexError(f"positions beyond {n}: {bad[:5]}")
    return out
