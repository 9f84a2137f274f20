"""Shared helpers of the corpus operators: shared-folder tables, vectorised words, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte classes. Words of the similarity operators end at white space, those of decontamination at anything but letters, digits and non-ASCII.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACES = "[\\x20\\x09-\\x0D]+"

#: Texts of a batch between Spark and a Python worker.
BATCH_ROWS = 1000
#: Environment of Python workers: memory that a worker has freed goes back at once, since idle workers stay beside those at work.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2"}

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster it is installed or sent with --py-files), and keep what they hold small:
    batches of BATCH_ROWS texts, unless the session has another number than Spark's own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*filter(None, env.get("PYTHONPATH", "").split(os.pathsep)), root]))


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where it is unset a local session gets a temporary one, as in tests; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, sort_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stash_path = path
    return kept


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, key: str, files: int) -> DataFrame:
    """Like `stash`, in files by a hash of `key` (Spark's bucketing): grouping or joining by it later needs no exchange of this side."""
    spark, name, path = df.sparkSession, f"tidewheel_{uuid.uuid4().hex}", shared_path(df.sparkSession)
    df.write.bucketBy(files, key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # resolved, so the name can go; the files stay
    spark.sql(f"drop table {name}")
    return out


def tidy(run: Callable) -> Callable:
    """`run` over batches; when a task ends, memory that Arrow and the allocator still hold goes back, since its worker waits beside others."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that extra columns can't clash."""
    return docs.select(*(F.col(quoted(source)).alias(name) for name, source in columns.items()))


def others(docs: DataFrame, text_col: str):
    """All columns but the text as one struct: no name in it can clash, and the text is carried once."""
    return F.struct(F.lit(True).alias("held"), *(F.col(quoted(c)) for c in docs.columns if c != text_col)).alias("own")


def restored(docs: DataFrame, text_col: str) -> list:
    """The columns of `docs` in their order, from `others` (own) and `text`."""
    return [F.col("text" if c == text_col else f"own.{quoted(c)}").alias(c) for c in docs.columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and each row's offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batch: pa.RecordBatch, name: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `size` bytes of text, one row at least."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(name)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of a block of texts: `row`, `start`, `end` (bytes) and a 64-bit hash of the bytes (A-Z lower-cased) of each; `first` has each row's first word."""

    def __init__(self, col: pa.Array, kind: np.ndarray, lower: bool = True):
        self.data, self.off = text_bytes(col)
        data, off = self.data, self.off
        n = len(data)
        inside = kind[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        up, down = _powers(BLOCK_BYTES + 1) if n <= BLOCK_BYTES else _powers.__wrapped__(n)  # only those of a usual block are kept
        value = (LOWER[data] if lower else data).astype(np.uint64)
        value += np.uint64(1)
        value *= up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each k consecutive words of a row."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(h) - k + 1] == self.row[k - 1 :])
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[at + j]
        return at, mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) edges, by alternating large-star and small-star steps (Kiveris et al. 2014).

    Rounds go on until nothing changes (about log2 of the longest chain). Each is a group-by of the edges, kept in the shared folder; the one before is deleted. Nothing is collected. A node's neighbours are only
    aggregated with min(), so a hub is pre-aggregated before the shuffle. No edges: no rows.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = stash(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e.sparkSession, e.stash_path)
        e, same, before = new, mark == before, mark
        if same:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def model_file(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; the folder is a parameter (environment variable TOKENIZER_DIR, else /opt/tokenizers)."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
