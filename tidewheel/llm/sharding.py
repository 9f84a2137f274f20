"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pick, stash

#: Partial partitions that one task combines; with more, their results are combined again, level by level.
CHUNK = 4096


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of `sums`, k shard sizes each) until one is left; (place[i, j]: the shard that part j of row i goes to, the shard sizes).

    The two of largest spread are combined, one in rising and one in falling order, so that large parts meet small ones.
    Which parts share a shard is kept as a chain of (row, part) for every part, joined in constant time.
    """
    n, k = sums.shape
    nxt = np.full(n * k, -1, np.int64)
    live: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    heap = []
    for i in range(n):
        own = np.arange(i * k, (i + 1) * k)
        live[i] = (sums[i].astype(np.int64), own, own.copy())
        heap.append((-int(sums[i].max() - sums[i].min()), i))
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        (sx, hx, tx), (sy, hy, ty) = live.pop(x), live.pop(y)
        up, down = np.argsort(sx, kind="stable"), np.argsort(-sy, kind="stable")
        nxt[tx[up]] = hy[down]
        total = sx[up] + sy[down]
        live[count] = (total, hx[up], ty[down])
        heapq.heappush(heap, (-int(total.max() - total.min()), count))
        count += 1
    total, head, _ = live[heap[0][1]]
    place = np.empty(n * k, np.int64)
    for j in range(k):
        at = int(head[j])
        while at >= 0:
            place[at] = j
            at = int(nxt[at])
    return place.reshape(n, k), total


def _combine(items: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One level: items (chunk, item, sums) to ((item, part, parent, place), one row of sums for each chunk)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.sort_values("item")
            place, total = difference(np.stack(pdf["sums"].to_numpy()))
            yield pd.DataFrame({"item": [*pdf["item"], -1], "chunk": pdf["chunk"].iloc[0], "place": [*place.tolist(), total.tolist()], "sums": [*[None] * len(pdf), total.tolist()]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(run(iter([pdf])))

    done = stash(items.groupBy("chunk").applyInPandas(one, "item long, chunk long, place array<long>, sums array<long>"))
    return done.filter("sums is null").select("item", "chunk", "place"), done.filter("sums is not null").select(F.col("chunk").alias("item"), "sums")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes (none for null) plus 1; crc32 of null is that of the empty text. Rows of equal texts go to one shard; null texts are
    one group. Slots are gapless from 0 within a shard. An empty table gives no rows; other columns are ignored; a null id is an id like others.

    Groups (key, bytes) are pre-aggregated before their shuffle. Each chunk of groups is differenced in a task, its partial partitions
    are differenced again, and so on until one is left; only tables of k numbers per chunk move up, and each group's shard
    is found by joining down the levels. Rows find their group by a join on a 64-bit key, whose hot keys adaptive execution splits.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stash(pick(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col("text").isNull(), text).alias("key")))
    groups = stash(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    n = groups.count()
    chunks = max(1, -(-n // chunk))
    zeros = F.array_repeat(F.lit(0).cast("long"), shards - 1)
    total, most = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    # Groups beyond half a chunk's share of a shard (under 2048 of them) meet in chunk 0, with enough of the others to fill up around them.
    heavy = F.element_at("sums", 1) > (total or 0) // (2 * shards * min(chunks, 64))
    filler = F.pmod(F.xxhash64("item", F.lit(-1)), F.lit(1 << 20)) < int((1 << 20) * min(1, 3 * shards * (most or 0) / (total or 1), 8 * chunk / max(1, n)))
    level = groups.select(F.col("key").alias("item"), F.concat(F.array("bytes"), zeros).alias("sums"))
    assigned = None
    while True:
        chunked = F.pmod(F.xxhash64("item", F.lit(chunks)), F.lit(chunks))
        level = level.withColumn("chunk", F.when(heavy | filler, F.lit(0)).otherwise(chunked) if assigned is None else chunked)
        down, up = _combine(level.select("chunk", "item", "sums"), shards)
        if assigned is None:
            assigned = down.select(F.col("item").alias("key"), F.col("chunk").alias("parent"), F.element_at("place", 1).alias("part"))
        else:
            here = down.select(F.col("item").alias("parent"), F.col("chunk").alias("upper"), "place")
            assigned = assigned.join(here, "parent").select("key", F.col("upper").alias("parent"), F.element_at("place", (F.col("part") + 1).cast("int")).alias("part"))
        if chunks == 1:
            break
        chunks, level = max(1, -(-chunks // chunk)), up
    placed = rows.join(assigned.select("key", F.col("part").cast("int").alias("shard")), "key")

    # Slots: rows of a shard lie in strips of about 4096 rows by id; each strip starts where the strips before it end.
    strips = max(1, rows.count() // (4096 * shards))
    placed = stash(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(strips)).alias("strip")))
    sizes = placed.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.join(sizes.select("shard", "strip", F.coalesce("base", F.lit(0)).alias("base")), ["shard", "strip"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + nth).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
