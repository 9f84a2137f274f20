"""Windows from blocks of dates: each series is cut into blocks with a halo, and only the windows of kept queries are sliced from them.

A frame over rows would hold an array at every date before a stride drops most of them. A block holds each value once, and its halo (lookback and horizon) is what the next
block repeats; a long series is dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from .windows import KEYS

#: Cells of dense blocks, and of windows cut from them, that a task holds at a time.
HELD_CELLS = 1 << 19
MOST = (1 << 63) - 1


def block_size(lookback: int, horizon: int) -> int:
    """Dates of a block: at least twice its halo, so that a value is held in 1.5 blocks on average at most."""
    return max(256, 2 * (lookback + horizon))


def series_blocks(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, size: int) -> DataFrame:
    """(series_id, variate, block, cells): the dates of a block with its halo, in order; a cell holds t, c and the panel's other columns."""
    lo, hi = min(s[1] for s in splits), max(s[2] for s in splits)
    t = F.col("t")
    rows = panel.filter((t >= lo - lookback) & (t < hi))  # the first query of a split may lie right before it
    first, last = F.floor((t - horizon) / size), F.floor((t + lookback - 1) / size)
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(max(0, lo - 1) // size)), F.least(last, F.lit((hi - 1) // size)))))
    cell = F.struct("t", "c", *(F.col(c) for c in panel.columns if c not in (*KEYS, "t", "c")))
    return rows.groupBy(*KEYS, "block").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def kept_queries(splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int, size: int) -> Column:
    """Array of (t, split) of a block's admissible queries: the horizon lies in the split, the lookback in the panel; every `stride`-th, from the first admissible one."""
    parts = []
    for name, lo, hi in splits:
        start, stop = max(lookback - 1, lo - 1), hi - 1 - horizon
        begin = F.col("block") * size
        skip = F.greatest(F.ceil((begin - start) / stride), F.lit(0)) * stride
        a, b = F.lit(start) + skip, F.least(begin + size - 1, F.lit(stop))
        seq = F.when(a <= b, F.sequence(a.cast("long"), b.cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
        label = F.lit(name).alias("split")
        parts.append(F.transform(seq, lambda q: F.struct(q.alias("t"), label)))  # noqa: B023
    return F.concat(*parts)


def windows(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int = 1, past: bool = True, size: int | None = None) -> DataFrame:
    """The panel's columns, split, the lookback's moments (n, s1, s2, mx, mn), y and (with `past`) x of each admissible query of `splits`.

    The panel is dense: each series and variate has every date once. Null values are left out of x, y and moments. No splits or no admissible query: no rows.
    Of a panel that `densify` filled with zeros only the known cells are shuffled (`known_blocks`), and rows have no ts.
    """
    size = size or block_size(lookback, horizon)
    if getattr(panel, "known", None) is not None:
        return cut(known_blocks(panel, splits, lookback, horizon, size), splits, lookback, horizon, stride, past, size)
    b = series_blocks(panel, splits, lookback, horizon, size)
    q = b.withColumn("q", F.explode(kept_queries(splits, lookback, horizon, stride, size)))
    place = (F.col("q.t") - F.element_at("cells", 1)["t"]).cast("int")
    values = lambda start, n: F.array_compact(F.transform(F.slice("cells", start, n), lambda z: z["c"]))
    own = [c for c in panel.columns if c not in (*KEYS, "t")]
    q = q.select(*KEYS, F.col("q.t").alias("t"), F.element_at("cells", place + 1).alias("cell"), "q.split", values(place + 2 - lookback, lookback).alias("x"), values(place + 2, horizon).alias("y"))
    zero = F.lit(0).cast("long")
    moments = [F.size("x").cast("long").alias("n"), F.aggregate("x", zero, lambda a, v: a + v).alias("s1"), F.aggregate("x", zero, lambda a, v: a + v * v).alias("s2"), F.array_max("x").alias("mx"), F.array_min("x").alias("mn")]
    return q.select(*KEYS, "t", *(F.col(f"cell.{c}").alias(c) for c in own), *moments, "y", *(["x"] if past else []), "split")


def known_blocks(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, size: int) -> DataFrame:
    """(series_id, variate, block, cells) of all blocks that queries of `splits` lie in; cells are the (t, c) that aren't zero by absence, halo included, in no order."""
    lo, hi = min((s[1] for s in splits), default=0), max((s[2] for s in splits), default=0)
    low, high, t = max(0, lo - 1) // size, (hi - 1) // size, F.col("t")
    first, last = F.floor((t - horizon) / size), F.floor((t + lookback - 1) / size)
    cell = F.struct("t", "c")
    known = panel.known.filter((t >= lo - lookback) & (t < hi)).select(*KEYS, F.explode(F.sequence(F.greatest(first, F.lit(low)), F.least(last, F.lit(high)))).alias("block"), cell.alias("cell"))
    every = panel.keys.select(*KEYS, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("block"), F.lit(None).cast(known.schema["cell"].dataType).alias("cell"))
    return known.unionByName(every.filter(F.lit(bool(splits)))).groupBy(*KEYS, "block").agg(F.collect_list("cell").alias("cells"))


def _squares(x: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row; beyond a long they are an error, as they are in SQL."""
    if len(x) and max(int(x.max()), -int(x.min())) ** 2 * x.shape[1] > MOST:
        exact = (x.astype(object) ** 2).sum(1)
        if max(exact) > MOST:
            raise OverflowError("a window's sum of squares is beyond a long")
        return exact.astype(np.int64)
    return (x * x).sum(1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _cutter(splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int, past: bool, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width, names = lookback - 1 + size + horizon, [*KEYS, "t", "c", "n", "s1", "s2", "mx", "mn", "y", *(["x"] if past else []), "split"]

    def queries(block: int) -> Iterator[tuple[str, np.ndarray]]:
        for name, lo, hi in splits:
            start, begin = max(lookback - 1, lo - 1), block * size
            skip = max(-((start - begin) // stride), 0) * stride
            q = np.arange(start + skip, min(begin + size - 1, hi - 1 - horizon) + 1, stride)
            if len(q):
                yield name, q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, cells = b.column(2).to_numpy(), b.column(3)
            ends = np.r_[0, np.cumsum(cells.value_lengths().to_numpy())]
            t, c = (v.to_numpy() for v in cells.flatten().flatten())
            for block in np.unique(at):
                mine, found = np.flatnonzero(at == block), list(queries(int(block)))
                most = max((len(q) for _, q in found), default=0) * (lookback + horizon)
                step = max(1, HELD_CELLS // max(width, most))
                for k in range(0, len(mine) if found else 0, step):
                    rows = mine[k : k + step]
                    dense = np.zeros((len(rows), width), np.int64)
                    for i, r in enumerate(rows):
                        own = slice(ends[r], ends[r + 1])
                        dense[i, t[own] - (block * size - lookback + 1)] = c[own]
                    seen = np.lib.stride_tricks.sliding_window_view(dense, lookback + horizon, axis=1)
                    for name, q in found:
                        w = seen[:, q - block * size].reshape(-1, lookback + horizon)
                        x, y = w[:, :lookback], w[:, lookback:]
                        keys = pa.array(np.repeat(rows, len(q)))
                        moments = [np.full(len(x), lookback), x.sum(1), _squares(x), x.max(1), x.min(1)]
                        columns = [b.column(0).take(keys), b.column(1).take(keys), pa.array(np.tile(q, len(rows))), pa.array(x[:, -1]), *map(pa.array, moments), _lists(y), *([_lists(x)] if past else []), pa.repeat(name, len(x))]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut(known: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int, past: bool, size: int) -> DataFrame:
    """`windows` of `known_blocks`: dates without a cell are zeros, and only the windows of kept queries leave a task, a few blocks at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    longs = ", ".join(f"{c} long" for c in ("t", "c", "n", "s1", "s2", "mx", "mn"))
    schema = f"series_id {kinds['series_id']}, variate {kinds['variate']}, {longs}, y array<long>, {'x array<long>, ' if past else ''}split string"
    return known.mapInArrow(_cutter(splits, lookback, horizon, stride, past, size), schema)


def kept(panel: DataFrame) -> DataFrame:
    """A panel whose known cells are written once, for queries that cut windows several times."""
    if getattr(panel, "known", None) is None:
        return panel
    panel.known, panel.keys = stash(panel.known), stash(panel.keys)
    return panel


def varying_windows(panel: DataFrame, splits: list[tuple[str, int, int]], lookback: int, horizon: int, stride: int = 1, size: int | None = None) -> DataFrame:
    """`windows` (with x) of queries of which any variate varies in the lookback, all variates of them.

    A series' variates lie in one row a block, so whether any of them varies is asked there: the only exchange is the one that makes the blocks.
    """
    size = size or block_size(lookback, horizon)
    lo, hi = min(s[1] for s in splits), max(s[2] for s in splits)
    t = F.col("t")
    rows = panel.filter((t >= lo - lookback) & (t < hi))
    first, last = F.floor((t - horizon) / size), F.floor((t + lookback - 1) / size)
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(max(0, lo - 1) // size)), F.least(last, F.lit((hi - 1) // size))))).repartition("series_id", "block")
    own = [c for c in panel.columns if c not in (*KEYS, "t")]
    b = rows.groupBy("series_id", "variate", "block").agg(F.sort_array(F.collect_list(F.struct("t", *own))).alias("cells"))
    whole = b.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("variate", "cells"))).alias("all"))  # a series' variates over a block's dates
    q = whole.withColumn("q", F.explode(kept_queries(splits, lookback, horizon, stride, size)))
    q = q.withColumn("place", (F.col("q.t") - F.element_at("all", 1)["cells"][0]["t"]).cast("int"))
    cut = lambda cells, start, n: F.array_compact(F.transform(F.slice(cells, start, n), lambda z: z["c"]))
    past = lambda v: cut(v["cells"], F.col("place") + 2 - lookback, lookback)
    kept = q.filter(F.exists("all", lambda v: F.array_max(past(v)) > F.array_min(past(v)))).withColumn("v", F.explode("all"))
    x = kept.select("series_id", F.col("v.variate").alias("variate"), F.col("q.t").alias("t"), F.col("v.cells")[F.col("place")].alias("cell"), "q.split", past(F.col("v")).alias("x"), cut(F.col("v.cells"), F.col("place") + 2, horizon).alias("y"))
    zero = F.lit(0).cast("long")
    moments = [F.size("x").cast("long").alias("n"), F.aggregate("x", zero, lambda a, v: a + v).alias("s1"), F.aggregate("x", zero, lambda a, v: a + v * v).alias("s2"), F.array_max("x").alias("mx"), F.array_min("x").alias("mn")]
    return x.select(*KEYS, "t", *(F.col(f"cell.{c}").alias(c) for c in own), *moments, "y", "x", "split")
