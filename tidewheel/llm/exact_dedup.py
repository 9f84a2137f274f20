"""Exact deduplication by an extendible-hash index kept in shared files. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, bucketed, discard, others, partitions, restored, stash

#: A directory or table of hot keys of up to so many rows (some 20 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Most bytes of text that an index file is meant for; there are as many files as the session's shuffle partitions at least.
FILE_BYTES = 256 << 20
#: Owners to a file: files take owners by a hash, so several even out.
OWNERS = 8


def normalised(text) -> F.Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _cell(key: str, depth: int):
    """The first `depth` bits of a 64-bit key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_rows: int, bits: int = 64) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth, weight) for every used cell of the directory, and its global depth.

    `keys` has a key with its rows n and their weight (1 each where these columns are missing). The directory starts with about one bucket for each `bucket_rows` rows and doubles
    until no bucket is overfull. A cell of one key can't be split: it is left to pages. A bucket is the shortest prefix whose rows fit. Only counts by cell are handled here; the
    directory itself stays a distributed table.
    """
    keys = keys.select("key", *(c if c in keys.columns else F.lit(1).cast("long").alias(c) for c in ("n", "weight")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    depth = start = min(bits, max(0, (max(1, total // bucket_rows)).bit_length()))
    depth = min(bits, depth + 2)
    while True:
        cells = keys.groupBy(_cell("key", depth).alias("cell")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        if depth >= bits or cells.filter((F.col("n") > bucket_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        depth = min(bits, depth + 2)
    cells = cells.drop("lo", "hi")
    local, bucket = F.lit(depth), F.col("cell")
    for d in range(depth, start - 1, -1):  # the shortest prefix that fits wins, so it is tested last
        prefix = F.shiftrightunsigned(F.col("cell"), depth - d) if depth - d < 64 else F.lit(0).cast("long")
        cells = cells.withColumn(f"n{d}", F.sum("n").over(Window.partitionBy(prefix)))
        fits = F.col(f"n{d}") <= bucket_rows
        local, bucket = F.when(fits, F.lit(d)).otherwise(local), F.when(fits, prefix).otherwise(bucket)
    return cells.select("cell", bucket.alias("bucket"), local.cast("int").alias("local_depth"), "weight"), depth


def _placed(entries: DataFrame) -> DataFrame:
    """`entries` (start: a key without its last bit, weight) with `before`: the weight of all entries of smaller keys. A prefix scan in 4096 ranges of keys, so no task sorts all entries."""
    entries = entries.withColumn("band", F.shiftright("start", 51))
    earlier = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = entries.groupBy("band").agg(F.sum("weight").alias("w")).select("band", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("band").orderBy("start", "pages").rowsBetween(Window.unboundedPreceding, -1)
    return entries.join(F.broadcast(bands), "band").withColumn("before", F.col("base") + F.coalesce(F.sum("weight").over(within), F.lit(0))).drop("band", "base")


def _small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the table's size allows it."""
    return F.broadcast(table) if table.count() <= rows else table


def _grouped(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int, hash_bits: int) -> DataFrame:
    """Every row of `docs` (struct `own` and text) with bucket, local_depth, owner, keep_id, group_size, kept and text_sha256.

    1. Keys are counted, with the bytes of their texts. Keys of more than `bucket_rows` rows are hot: their rows fill chained pages of that many rows. All others get their bucket
       from the directory.
    2. The directory gives each bucket and page its owner: entries lie in the order of their keys, and each owner gets a range of keys of about equal bytes, so that a split moves rows.
       Rows go to their owners and are written to the shared folder, OWNERS to a file: the index. There are more files the more bytes there are (FILE_BYTES).
    3. Owner tasks read their files. Rows of one bucket and page are sorted by key and normalised text, so that texts of one key are chained and compared byte by byte; what is
       equal is a group. Nothing is shuffled here, and a task sorts what its file has.
    4. Only groups of hot keys span pages: each page sends one row a group, pre-aggregated and compared by bytes again, and the totals go back to the pages.
    """
    spark = docs.sparkSession
    rows = docs.select(others(docs, text_col), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    key = F.xxhash64(normalised(F.col("text"))).bitwiseAND(F.lit(-1 << (64 - hash_bits)))
    counts = stash(rows.select(key.alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("bytes") + 1).alias("weight")))
    total = counts.agg(F.sum("weight")).first()[0] or 1
    files = max(partitions(spark), -(-total // FILE_BYTES))
    owners = files * OWNERS

    cells, depth = directory(counts.filter(F.col("n") <= bucket_rows), bucket_rows, hash_bits)
    cells = stash(cells)
    first_key = F.expr("shiftrightunsigned(shiftleft(bucket, 64 - local_depth), 1)").alias("start")
    hot_keys = counts.filter(F.col("n") > bucket_rows).select(F.col("key").alias("bucket"), F.lit(64).alias("local_depth"), "weight", F.ceil(F.col("n") / bucket_rows).cast("int").alias("pages"))
    entries = cells.groupBy("bucket", "local_depth").agg(F.sum("weight").alias("weight")).withColumn("pages", F.lit(0)).unionByName(hot_keys)
    entries = stash(_placed(entries.select("*", first_key)))
    discard(spark, counts.stash_path)

    def owner(weight_before) -> F.Column:
        return F.least(F.floor(weight_before / total * owners), F.lit(owners - 1)).cast("int")

    hot = entries.filter("pages > 0").select(F.col("bucket").alias("hot_key"), "pages", "before", "weight")
    found = cells.drop("weight").join(entries.filter("pages = 0").select("bucket", "local_depth", owner(F.col("before")).alias("owner")), ["bucket", "local_depth"])
    found = stash(found.select(F.col("cell").alias("at"), "bucket", "local_depth", "owner"))

    placed = rows.withColumn("key", key).withColumn("row", F.monotonically_increasing_id())
    placed = placed.join(_small(hot), F.col("key") == F.col("hot_key"), "left").withColumn("at", F.when(F.col("hot_key").isNull(), _cell("key", depth)))
    placed = placed.join(_small(found), "at", "left")
    page = F.when(F.col("pages").isNotNull(), F.pmod(F.xxhash64("row"), F.col("pages"))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("page", page).withColumn("owner", F.coalesce("owner", owner(F.col("before") + F.col("weight") * F.col("page") / F.col("pages"))))
    placed = placed.select("own", "doc_id", "text", "key", "row", F.col("pages").isNotNull().alias("hot"), F.coalesce("bucket", "key").alias("bucket"), F.coalesce("local_depth", F.lit(64)).alias("depth"), "page", "owner")
    index = bucketed(placed.repartition(files, "owner"), "owner", files)

    index = index.select("*", normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"))
    chain = ["owner", "bucket", "depth", "page", "key", "norm"]
    order = [F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    first, all_ = Window.partitionBy(*chain).orderBy(*order), Window.partitionBy(*chain).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def groups(of: F.Column) -> DataFrame:
        out = index.filter(of).select("own", "text", "row", "n_cp", "doc_id", "bucket", F.col("depth").alias("local_depth"), "owner", "norm", F.row_number().over(first).alias("nth"), F.first("doc_id").over(all_).alias("keep_id"), F.count("*").over(all_).alias("size"))
        return out.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))

    single = groups(~F.col("hot")).select("own", "text", "doc_id", "bucket", "local_depth", "owner", "keep_id", F.col("size").alias("group_size"), (F.col("nth") == 1).alias("kept"), "text_sha256")
    if hot.isEmpty():
        return single

    paged = groups(F.col("hot"))
    heads = paged.filter("nth = 1").select("bucket", "norm", "text_sha256", "size", F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "row").alias("rank"), "keep_id", "row")
    totals = heads.groupBy("bucket", "norm").agg(F.sum("size").alias("group_size"), F.min_by("keep_id", "rank").alias("hot_id"), F.min_by("row", "rank").alias("hot_row"))
    totals = totals.select(F.col("bucket").alias("hot_bucket"), F.sha2(F.col("norm").cast("binary"), 256).alias("hot_sha"), "group_size", "hot_id", "hot_row")
    agreed = totals.groupBy("hot_bucket", "hot_sha").agg(F.count("*").alias("texts"), F.sum("group_size").alias("group_size"), F.max("hot_id").alias("hot_id"), F.max("hot_row").alias("hot_row"))
    agreed = stash(agreed.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("texts of one digest differ in their bytes")).cast("long"))).drop("texts"))
    spread_out = paged.join(_small(agreed), (F.col("bucket") == F.col("hot_bucket")) & (F.col("text_sha256") == F.col("hot_sha")))
    return single.unionByName(spread_out.select("own", "text", "doc_id", "bucket", "local_depth", "owner", F.col("hot_id").alias("keep_id"), "group_size", (F.col("row") == F.col("hot_row")).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, owner. A bucket is a prefix of `local_depth` bits, or the whole key of a hot one.

    Texts are equal when identical after deleting white space; the row with the most code points of original text, then the
    smallest id, stays; a null id comes after all others. One row of each group of equal texts is kept, also where ids are null,
    repeated, or shared by different texts. Null texts count as empty. An empty table gives an empty result; columns other than the two named are ignored.

    Results come out of the index's owner tasks (see `_grouped`); `hash_bits` of the 64-bit key are used, fewer in tests.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _grouped(rows, "doc_id", "text", bucket_rows, hash_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "local_depth", "owner")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """The rows of `docs` that stay, one for each group of equal texts, unchanged: they come out of the index with all their columns."""
    return _grouped(docs, id_col, text_col, bucket_rows, 64).filter("kept").select(*restored(docs, text_col))
