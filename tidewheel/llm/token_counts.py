"""Token counts of documents in flat, unindexed token files, by scanning for separators."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import model_file, partitions, pick, shared_path

# Fixed value: the published split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Identifiers are stored plus 1, as 16-bit numbers; 0 ends a document.
SEPARATOR = 0
#: Tokens that are searched at once.
BLOCK_TOKENS = 1 << 20
#: Bytes of an id in an id file (known or null, the id, the separator), and ids that are read at once.
ID_BYTES, ID_BLOCK = 11, 1 << 16


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> None:
    """Encode each text with a byte-level vocabulary (a .tiktoken file of under 65,535 ranks) and append it and a separator to its task's file in `path`/kind=tokens.

    The files are bare 16-bit little-endian numbers: no lengths, no index. Null counts as empty text. The same task writes the documents' ids, in the same order, to the
    file of the same number in `path`/kind=ids: ID_BYTES each. The vocabulary (about 1 MB) is broadcast.
    """
    name = ranks or model_file("byte_bpe_50k.tiktoken")
    with open(name, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    if max(held.value.values()) >= (1 << 16) - 1:
        raise ValueError("the vocabulary doesn't fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=held.value, special_tokens={})
        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(i).slice(lo, 256).to_pylist() for i in (0, 1))
                tokens = [(np.array(own.encode_ordinary(x or ""), np.uint16) + np.uint16(1)).astype("<u2").tobytes() for x in texts]
                names = [struct.pack("<?q", x is not None, x or 0) for x in ids]
                order = pa.array(range(at, at + len(ids)), pa.int64())
                for kind, value in (("ids", names), ("tokens", tokens)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids)), order, pa.array(value, pa.binary())], names=["kind", "at", "value"])
                at += len(ids)

    # the text writer writes a row's bytes as they are, and the separator after each; the order within a task is stated, so that no other is made
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind string, at long, value binary")
    rows.sortWithinPartitions("kind", "at").select("kind", F.col("value").cast("string")).write.partitionBy("kind").option("lineSep", "\0\0").text(path)


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, block, content): byte ranges of `size` of the files in a folder. Each range is read by the task that searches it; a file of any length is never one value.

    Ranges are opened through Arrow's file systems. Where a folder's scheme isn't one of theirs, files are read whole by Spark and cut.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    cut = F.explode(F.expr(f"sequence(0L, (length - 1) div {size}L)"))
    if not re.match(r"(file:|hdfs:|s3a?:|gs:|/)", path):
        return files.filter("length > 0").select("path", "content", cut.alias("block")).select(F.col("path").alias("file"), "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("content"))
    ranges = files.select("path", "length").filter("length > 0").select(F.col("path").alias("file"), cut.alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", file)))
                with store.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([f.read_at(min(size, f.size() - block * size), block * size)], pa.binary())], names=["file", "block", "content"])

    return ranges.repartition(partitions(spark)).mapInArrow(run, "file string, block long, content binary")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            tokens = np.frombuffer(content.as_buffer(), "<u2")
            ends = np.flatnonzero(tokens == SEPARATOR)
            lengths = np.diff(ends, prepend=-1) - 1
            tail = int(len(tokens) - (ends[-1] + 1 if len(ends) else 0))
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([lengths], pa.list_(pa.int64())), pa.array([tail], pa.int64()), pa.array([len(ends)], pa.int64())], names=["file", "block", "lengths", "tail", "n_ends"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, block, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            rows = np.frombuffer(content.as_buffer(), np.dtype([("known", "?"), ("id", "<i8"), ("end", "<u2")]))
            at = block.as_py() * ID_BLOCK + np.arange(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows)), pa.array(at), pa.array(rows["id"], mask=~rows["known"])], names=["file", "document", "doc_id"])


def scan_tokens(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, document, n_tokens, ended) of every document of the token files in a folder; documents count from 0 in each file.

    Each block is searched by one vectorised comparison and gives the lengths it can see: of its first document the part that lies in
    it, and the tail after its last separator. A prefix scan over a file's blocks adds the tails before a block to its first
    document, however many blocks a document spans, and tells how many documents end before it. Tokens after a file's last
    separator are a document that has not ended. Empty files have none.
    """
    rows = _ranges(spark, path, 2 * block_tokens).mapInArrow(_search, "file string, block long, lengths array<long>, tail long, n_ends long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    since = Window.partitionBy("file", "base").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks of one `base` follow the same last separator: that of the block before the first of them
    last = F.lag("tail").over(Window.partitionBy("file").orderBy("block"))
    rows = rows.withColumn("before", F.coalesce(last, F.lit(0)))
    lead = F.first("before").over(Window.partitionBy("file", "base").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("carry", F.coalesce(F.sum("tail").over(since), F.lit(0)) + lead).withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    ended = rows.filter("n_ends > 0").select("file", "base", "carry", F.posexplode("lengths").alias("i", "n")).select("file", (F.col("base") + F.col("i")).alias("document"), F.when(F.col("i") == 0, F.col("n") + F.col("carry")).otherwise(F.col("n")).alias("n_tokens"), F.lit(True).alias("ended"))
    open_ = rows.filter("is_last").select("file", (F.col("base") + F.col("n_ends")).alias("document"), (F.col("tail") + F.when(F.col("n_ends") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.union(open_)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, from token files written and scanned again.

    Ids lie in files beside the tokens, written by the same tasks in the same order, so `docs` is read once and may be any query; a token file whose number of documents is
    another than that of its ids fails the query. Null and empty texts have 0 tokens. Repeated rows have a row each. An empty table gives
    no rows; other columns are ignored; a null id stays null.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark)
    write_tokens(docs, path, id_col, text_col, ranks)
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path").head(1):
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).cast("int").alias("part")
    found = scan_tokens(spark, f"{path}/kind=tokens", block_tokens).select(part, "document", "n_tokens", "ended")
    named = _ranges(spark, f"{path}/kind=ids", ID_BYTES * ID_BLOCK).mapInArrow(_ids, "file string, document long, doc_id long").select(part, "document", "doc_id", F.lit(True).alias("named"))
    both = named.join(found, ["part", "document"], "full")
    whole = F.coalesce(F.col("ended"), F.lit(False)) & F.coalesce(F.col("named"), F.lit(False))
    return both.select("doc_id", F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a token file doesn't fit its ids")).cast("long")).alias("n_tokens"))
