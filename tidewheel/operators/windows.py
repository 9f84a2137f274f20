"""Lookback and horizon windows of a panel, split ownership and window filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("series_id", "variate")
# Names of one, two and three chronological blocks.
SPLIT_NAMES = {1: ["test1"], 2: ["train", "test1"], 3: ["train", "valid1", "test1"]}
EPS = 1e-8


def over(lo: int, hi: int) -> WindowSpec:
    """A frame of rows relative to t. All frames share one partitioning and order, so they cost one exchange and one sort."""
    return Window.partitionBy(*KEYS).orderBy("t").rowsBetween(lo, hi)


def date_blocks(total: int, ratios: list[float]) -> list[tuple[int, int]]:
    """Chronological [lo, hi) blocks; the last takes what is left. Ratios are positive and sum to 1; no block may be empty."""
    if not 1 <= len(ratios) <= 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-8:
        raise ValueError("one to three positive ratios that sum to 1")
    cuts, run = [0], 0.0
    for r in ratios[:-1]:
        run += r
        cuts.append(int(round(run, 9) * total))
    cuts.append(total)
    blocks = list(zip(cuts, cuts[1:], strict=False))
    if any(lo >= hi for lo, hi in blocks):
        raise ValueError("a block is empty")
    return blocks


def split_ranges(total: int, ratios: list[float]) -> list[tuple[str, int, int]]:
    return [(name, lo, hi) for name, (lo, hi) in zip(SPLIT_NAMES[len(ratios)], date_blocks(total, ratios), strict=True)]


def dates_of(panel: DataFrame) -> int:
    """The panel's number of dates: the only number that splitting needs from the data. A densified panel knows its grid, which two aggregates of the source give."""
    grid = getattr(panel, "grid", None)
    last = (panel if grid is None else grid).agg(F.max("t")).first()[0]
    return 0 if last is None else last + 1


def ranked(frame: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    """`frame` with the rank from 1 within `by` by `order`. `bucket` must rise with the order.

    Rows are ranked inside their bucket, and counts by bucket, pre-aggregated, tell how many come before it: no group of `by` meets in one task.
    """
    rows = frame.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    return nth.join(counts, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_nth")).drop("_bucket", "_before", "_nth")


def prune_halo(panel: DataFrame, lo: int, hi: int, lookback: int, horizon: int) -> DataFrame:
    """Rows that queries in [lo, hi] can touch. Filters on the query can't move below a window, so the range is cut by hand before it."""
    return panel.filter(F.col("t").between(lo - lookback + 1, hi + horizon))


def with_moments(panel: DataFrame, lookback: int) -> DataFrame:
    """Count, sum, sum of squares, least and largest of each lookback."""
    w = over(-(lookback - 1), 0)
    return panel.select("*", F.count("c").over(w).alias("n"), F.sum("c").over(w).alias("s1"), F.sum(F.col("c") * F.col("c")).over(w).alias("s2"), F.max("c").over(w).alias("mx"), F.min("c").over(w).alias("mn"))


def std(n: Column, s1: Column, s2: Column) -> Column:
    """Population deviation from integer moments."""
    first, second = s1.cast("double"), s2.cast("double")
    return F.sqrt(F.greatest(n.cast("double") * second - first * first, F.lit(0.0))) / n.cast("double")


def queries_in(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int = 1) -> DataFrame:
    """Admissible query rows of each split: the horizon lies in the split, the lookback in the panel; every `stride`-th, from the first admissible one."""
    out = None
    for name, lo, hi in splits:
        first = max(lookback - 1, lo - 1)
        part = panel.filter((F.col("t") >= first) & (F.col("t") + horizon <= hi - 1) & ((F.col("t") - first) % stride == 0)).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def split_queries(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int = 1) -> DataFrame:
    """As `queries_in`, in one pass: splits are literals of a CASE, so the windows below are computed once."""
    case, first = F.lit(None).cast("string"), F.lit(None).cast("long")
    t = F.col("t")
    for name, lo, hi in splits:
        start = max(lookback - 1, lo - 1)
        inside = (t >= start) & (t + horizon <= hi - 1)
        case, first = F.when(inside, name).otherwise(case), F.when(inside, F.lit(start).cast("long")).otherwise(first)
    return panel.withColumn("split", case).filter(F.col("split").isNotNull() & ((t - first) % stride == 0))


def owned_queries(panel: DataFrame, owned: DataFrame, lookback: int, horizon: int, stride: int = 1) -> DataFrame:
    """Admissible rows for any set of owned dates (t): all of the horizon is owned. The stride counts admissible dates, not t."""
    flagged = panel.join(F.broadcast(owned.select("t").distinct().withColumn("owned", F.lit(1))), "t", "left")
    counted = flagged.withColumn("n_owned", F.sum(F.coalesce("owned", F.lit(0))).over(over(1, horizon)))
    ok = counted.filter((F.col("n_owned") == horizon) & (F.col("t") >= lookback - 1))
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("t")) - 1
    return ok.withColumn("nth", nth).filter(F.col("nth") % stride == 0).drop("nth", "owned")


def not_constant(frame: DataFrame, by: list[str]) -> DataFrame:
    """Window filter: keep a window if any of its variates varies in the lookback."""
    w = Window.partitionBy(*by)
    return frame.withColumn("_any", F.max((F.col("mx") > F.col("mn")).cast("int")).over(w)).filter("_any = 1").drop("_any")


def drop_constant_series(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Series filter: drop a series if any variate of any of its windows is constant."""
    bad = windows.filter("mx = mn").select("series_id").distinct()
    return panel.join(bad, "series_id", "left_anti")


def horizons(queries: DataFrame, panel: DataFrame, horizon: int, keep: list[str]) -> DataFrame:
    """Rows (keep..., step, y) for every step of each query. Targets come from a frame over the panel, so no join is needed."""
    return queries.select(*keep, F.posexplode("y").alias("step", "y")).withColumn("step", F.col("step") + 1)


def with_future(panel: DataFrame, horizon: int) -> DataFrame:
    return panel.withColumn("y", F.collect_list("c").over(over(1, horizon)))


def with_past(panel: DataFrame, lookback: int) -> DataFrame:
    return panel.withColumn("x", F.collect_list("c").over(over(-(lookback - 1), 0)))
