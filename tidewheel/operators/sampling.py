"""Repeatable sampling: what a random draw would pick is what comes first by the md5 of its key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import save_clusters
from .windows import ranked


def draw_key(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def first_by(frame: DataFrame, by: list[str], key: Column, ties: list[str], n: int | Column) -> DataFrame:
    """The n rows of each group that come first by `key`."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(key, *ties))
    return frame.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def sample_keys(keys: DataFrame, column: str, ratio: float, seed: int) -> DataFrame:
    """max(1, int(n * ratio)) of the distinct keys, without replacement.

    The count is one row. Only a sort with a limit is global, and each task sends no more rows than the limit keeps.
    """
    n = max(1, int(keys.count() * ratio))
    return keys.orderBy(draw_key(seed, column), column).limit(n)


def largest_remainder(n: int, ratios: list[float]) -> list[int]:
    """Whole sizes that sum to n: floors, then one more for the largest fractions (earlier ones first)."""
    raw = [n * r for r in ratios]
    sizes = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (-(raw[i] - sizes[i]), i))[: n - sum(sizes)]:
        sizes[i] += 1
    return sizes


def cluster_ids(series: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(series_id, cluster_id): a shuffled order cut into clusters of the given sizes."""
    if len(sizes) < 1 or min(sizes) < 0:
        raise ValueError("sizes must not be negative")
    key = draw_key(seed, "series_id")
    ends, total = [], 0
    for i, size in enumerate(sizes):
        total += size
        ends.append((i, total))
    case = F.lit(-1)
    for i, end in reversed(ends):
        case = F.when(F.col("_nth") <= end, i).otherwise(case)
    numbered = ranked(series.select("series_id"), [], F.substring(key, 1, 3), [key, "series_id"], "place").withColumnRenamed("place", "_nth")
    return numbered.select("series_id", case.cast("int").alias("cluster_id"))


def batches(frame: DataFrame, by: list[str], seed: int, key: list[str], size: int) -> DataFrame:
    """Shuffled batches: rank by key within a group, cut into parts of `size`."""
    drawn = draw_key(seed, *key)
    out = ranked(frame, by, F.substring(drawn, 1, 3), [drawn, *key], "batch")
    return out.select(*frame.columns, F.floor((F.col("batch") - 1) / size).cast("long").alias("batch"))


def loader_order(windows: DataFrame, epochs: list[int], seed: int, size: int, key: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """`windows` once an epoch, with nth (its place in the epoch's shuffled order, from 0) and batch: what a loader gives, as columns, so that any later step can be put in that order.

    The place is counted by ranks of the key alone and joined to the windows, so no array is sorted.
    """
    keys = windows.select(*key).withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in epochs))))
    drawn = draw_key(seed, "epoch", *key)
    placed = ranked(keys, ["epoch"], F.substring(drawn, 1, 3), [drawn, *key], "nth").withColumn("nth", (F.col("nth") - 1).cast("long"))
    return windows.join(placed, list(key)).withColumn("batch", F.floor(F.col("nth") / size).cast("long"))


def iid_sizes(n: int, ratios: list[float] | None = None, sizes: list[int] | None = None, clusters: int | None = None) -> list[int]:
    """Cluster sizes of n series by exactly one of: ratios that sum to 1 (largest remainders), sizes that sum to n, or a number of clusters (larger ones first)."""
    if sum(v is not None for v in (ratios, sizes, clusters)) != 1:
        raise ValueError("exactly one of ratios, sizes and clusters")
    if ratios is not None:
        if abs(sum(ratios) - 1) > 1e-8 or min(ratios) <= 0:
            raise ValueError("positive ratios that sum to 1")
        return largest_remainder(n, ratios)
    out = sizes if sizes is not None else [n // clusters + (i < n % clusters) for i in range(clusters)]
    if sum(out) != n or min(out) < 1:
        raise ValueError(f"sizes {out} of {n} series")
    return out


def create_iid_clusters(series: DataFrame, path: str, group: str = "default", seed: int = 0, **how) -> dict[int, list[int]]:
    """{cluster: series} drawn by `iid_sizes` and saved with its provenance: a specification, so its size is the number of series."""
    method = next(iter(how), None)
    got = cluster_ids(series, iid_sizes(series.count(), **how), seed).groupBy("cluster_id").agg(F.sort_array(F.collect_list("series_id")).alias("members")).collect()
    clusters = {r.cluster_id: list(r.members) for r in got}
    save_clusters(path, group, clusters, {"creation_mode": "generated", "access_mode": "created", "randomized": True, "method": method, "seed": seed} | how)
    return clusters
