"""Exact Jaccard join on word shingles by recursive Voronoi regions in the Jaccard metric.

d(x, y) = 1 - |x & y| / |x | y| is a metric. Two kinds of pivots are used.

* Single shingles. d(x, {s}) is 1 - 1/|x| for the shingles of x and 1 for all others, so a document lies in the cell of its
  first shingle in a global order, and a document within the radius of it shares one of its first |x| - ceil(t |x|) + 1: the window
  into which boundary documents are replicated. The order puts shingles that no other document has first, then rare ones, so
  cells of shared passages are reached only by documents that consist of little else.
* Documents. In a cell that stays large, every member is compared with one pivot document. Members within the radius are linked to
  it; two others can only link when their distances to the pivot differ by no more than the radius (triangle inequality),
  so the rest recurs into shells by distance, and only near shells are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, blocks, components, mix, pick, quoted, signed, stash

#: Cells of up to so many classes are joined directly; larger ones recur.
CELL_ROWS = 12
#: Share of the shingles whose frequency is counted, in sixteenths; a little over what the window needs at 0.8.
COUNTED_16THS = 4
#: Shells by similarity to a pivot, and the most sets and shingles of a block.
SHELLS, BLOCK_SETS, BLOCK_SHINGLES = 10, 1024, 1_000_000


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) pairs, distinct and sorted within a row (as signed numbers); a row of fewer words has its whole sequence as one shingle."""
    at, gram = words.grams(k)
    row = words.row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] * np.uint64(31) + words.hash[words.first[short[has]] + j] + np.uint64(j + 1))
        row, gram = np.r_[row, short], np.r_[gram, whole]
    value = signed(gram)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _classes(rows: int, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's set, its size, and a 64-bit fingerprint of it: rows of one set are one class."""
    at = np.searchsorted(row, np.arange(rows + 1))
    total = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(mix(value.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    size = np.diff(at)
    return at, size, signed(mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)))


def window_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _facts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                row, value = shingle_sets(Words(part.column(1), SPACE_WORDS), k)
                at, size, cls = _classes(part.num_rows, row, value)
                counted = np.r_[0, np.cumsum((value.view(np.uint64) >> np.uint64(60)) < COUNTED_16THS)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size), pa.array(cls, mask=size == 0), pa.array(counted[at[1:]] - counted[at[:-1]])], names=["doc_id", "mark", "n", "cls", "counted"])

    return run


def _window_rows(k: int, percent: int):
    """The shingles of each class that may be in its window: the counted ones and, where they are fewer than the window, the first others. A task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in blocks(batch, "text"):
                row, value = shingle_sets(Words(part.column(0), SPACE_WORDS), k)
                at, size, cls = _classes(part.num_rows, row, value)
                fresh = np.zeros(part.num_rows, bool)
                for r in np.flatnonzero(size):
                    c = int(cls[r])
                    fresh[r] = c not in seen
                    seen.add(c)
                counted = (value.view(np.uint64) >> np.uint64(60)) < COUNTED_16THS
                nth = np.r_[0, np.cumsum(~counted)]
                lack = window_size(size, percent) - (size - (nth[at[1:]] - nth[at[:-1]]))
                keep = fresh[row] & (counted | (nth[:-1] - nth[at[:-1]][row] < lack[row]))
                yield pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(cls[row[keep]])], names=["token", "cls"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                row, value = shingle_sets(Words(part.column(1), SPACE_WORDS), k)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["member", "shingles"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by centre, the centre's own first: only its set is held while its members stream by."""
    centre, own = None, np.zeros(0, np.int64)
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            other = np.frombuffer(s.as_buffer(), np.int64)
            if a == b:
                centre, own = a, other.copy()
                continue
            if a != centre:
                raise RuntimeError("a member came before its centre")
            small, large = (own, other) if len(own) < len(other) else (other, own)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            for x, y in zip(out, (a, b, both, len(own) + len(other) - both), strict=True):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "both", "either"])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, mark: different texts of one id, or of none, differ in the mark."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    return docs.withColumn("mark", F.xxhash64("text"))


def _least(by: str, rows: DataFrame, *others) -> DataFrame:
    """(`by`, rep, rep_mark, others): the row of least id, any row where no id is known, of each group."""
    return rows.groupBy(by).agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("rep_mark"), *others)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text), once for each class of `wanted`, from the row that its id and mark name (structs compare nulls as equal)."""
    named = docs.select(F.struct("doc_id", "mark").alias("_name"), "text")
    wanted = wanted.select("cls", F.struct(F.col("rep").alias("doc_id"), F.col("rep_mark").alias("mark")).alias("_rep"))
    return named.join(wanted, F.col("_name") == F.col("_rep")).dropDuplicates(["_name"]).select("cls", "text")


def _measure(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, both, either) for every distinct pair of classes. The sets are made from the texts again, where these lie; only sets move."""
    pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = texts.mapInArrow(_sets(k), "member long, shingles binary")
    # a centre's members are dealt to tasks of about 256
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
    spread = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    ends = spread.select("a", "part", F.col("b").alias("member")).union(spread.select("a", "part", F.col("a").alias("member")).distinct())
    rows = ends.join(sets, "member").repartition("a", "part").sortWithinPartitions("a", "part", F.col("member") != F.col("a"))
    return stash(rows.select("a", "member", "shingles").mapInArrow(_compare, "a long, b long, both long, either long"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(classes of documents, links between classes).

    The first has doc_id, mark (of the text), n (distinct shingles) and cls (null without words) for every row; the second (a, b) of classes that link or are
    connected by links within a block. A link may be missing only between classes that others connect.
    Shingles and sets are told apart by 64-bit hashes.
    """
    docs = _named(docs, id_col, text_col)
    facts = stash(docs.mapInArrow(_facts(k), "doc_id long, mark long, n long, cls long, counted long"))
    classes = stash(_least("cls", facts.filter("n > 0"), F.min("n").alias("n"), F.min("counted").alias("counted")))

    sent = docs.select("text").mapInArrow(_window_rows(k, percent), "token long, cls long")
    cell = Window.partitionBy("token")
    shared = sent.select("token", "cls", F.count("*").over(cell).alias("df"), F.min("cls").over(cell).alias("lo"), F.max("cls").over(cell).alias("hi")).filter("lo < hi").select("token", "cls", "df")
    shared = shared.repartition("cls").groupBy("cls", "token").agg(F.min("df").alias("df")).join(classes.select("cls", "n", "counted"), "cls")
    own = Window.partitionBy("cls")
    is_counted = F.shiftrightunsigned("token", 60) < COUNTED_16THS
    room = F.expr(f"n - ceil({percent} * n / 100D) + 1") - (F.col("counted") - F.sum(is_counted.cast("int")).over(own))
    nth = F.row_number().over(own.orderBy((~is_counted).cast("int"), "df", "token"))
    windows = stash(shared.select("token", "cls", "n", is_counted.alias("is_counted"), room.alias("room"), nth.alias("nth")).filter("not is_counted or nth <= room").select("token", "cls", "n"))

    cells = windows.withColumn("size", F.count("*").over(cell)).filter("size > 1")
    small = cells.filter(F.col("size") <= CELL_ROWS).select("token", "cls", "n")
    near = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2)")
    pairs = small.join(small.select("token", F.col("cls").alias("cls2"), F.col("n").alias("n2")), "token").filter("cls < cls2").filter(near).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))

    large = stash(cells.filter(F.col("size") > CELL_ROWS).select("token", "cls", "n"))
    linked = F.expr(f"100 * both >= {percent} * either")
    regions = None
    if not large.isEmpty():
        # A cell's pivot is its member in most large cells. Cells of one pivot are one region, so members meet once however many shingles they share.
        central = large.join(large.groupBy("cls").agg(F.count("*").alias("cells")), "cls")
        pivots = central.groupBy("token").agg(F.max_by(F.struct("cls", "n"), F.struct("cells", "cls")).alias("p")).select("token", F.col("p.cls").alias("pivot"), F.col("p.n").alias("n2"))
        regions = stash(large.join(pivots, "token").select("pivot", "n2", "cls", "n").distinct())
        pairs = pairs.union(regions.filter("cls <> pivot").filter(near).select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
    # the texts of all classes that may be compared are looked up once
    texts = stash(_texts(docs, classes.join(cells.select("cls").distinct(), "cls", "left_semi")))
    measured = _measure(pairs, texts, k)
    links = measured.filter(linked).select("a", "b")
    if regions is not None:
        links = links.union(_shells(regions, measured, links, texts, k, percent))
    return facts.select("doc_id", "mark", "n", "cls"), links


def _shells(regions: DataFrame, measured: DataFrame, links: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of one region that its pivot doesn't connect yet.

    Members lie in shells by their similarity to the pivot, and large shells are dealt into blocks. By the triangle inequality only
    shells that are no further apart than the radius can hold a link; pairs of blocks of one component hold none that is needed. Each
    pair of blocks is joined exactly in a task and gives a star for each of its components, never all pairs.
    """
    label = components(links)
    sims = measured.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), (F.col("both") / F.col("either")).alias("sim"))
    sims = sims.union(sims.select(F.col("pivot").alias("cls"), F.col("cls").alias("pivot"), "sim"))
    rows = regions.select("pivot", "cls", "n").join(sims, ["pivot", "cls"], "left").join(label, F.col("cls") == F.col("node"), "left")
    # a member whose size rules the pivot out has no similarity measured; its size bounds it, so it lies in any shell up to that bound
    rows = rows.select("pivot", "cls", "n", F.coalesce("component", "cls").alias("comp"), F.when(F.col("cls") == F.col("pivot"), 1.0).otherwise(F.col("sim")).alias("sim"))
    own = Window.partitionBy("pivot")
    rows = rows.withColumn("lo", F.min("comp").over(own)).withColumn("hi", F.max("comp").over(own)).filter("lo < hi").drop("lo", "hi")
    rows = stash(rows.withColumn("shell", F.coalesce(F.floor(F.col("sim") * SHELLS), F.lit(-1)).cast("int")))
    if rows.isEmpty():
        return links.limit(0)
    sizes = rows.groupBy("pivot", "shell").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    rows = rows.join(sizes, ["pivot", "shell"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    blocks_ = rows.groupBy("pivot", "shell", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    reach = (100 - percent) * SHELLS // 100 + 1
    other = blocks_.select("pivot", F.col("shell").alias("shell2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    ordered = F.expr("(shell < shell2 or (shell = shell2 and part <= part2))")
    close = F.expr(f"shell = -1 or shell2 - shell <= {reach}")
    both = blocks_.join(other, "pivot").filter(ordered & close).filter("not (lo = hi and lo2 = hi2 and lo = lo2)")
    both = both.select("pivot", "shell", "part", "shell2", "part2", F.xxhash64("pivot", "shell", "part", "shell2", "part2").alias("job"))
    members = rows.select("pivot", "shell", "part", "cls")
    left = both.join(members, ["pivot", "shell", "part"]).select("job", F.lit(0).alias("side"), F.col("cls").alias("member"))
    right = both.filter("shell < shell2 or part < part2").select("job", F.col("pivot"), F.col("shell2").alias("shell"), F.col("part2").alias("part")).join(members, ["pivot", "shell", "part"]).select("job", F.lit(1).alias("side"), F.col("cls").alias("member"))
    jobs = left.union(right)
    sets = texts.mapInArrow(_sets(k), "member long, shingles binary")
    sorted_ = jobs.join(sets, "member").select("job", "side", "member", "shingles").repartition("job").sortWithinPartitions("job", "side")
    return stash(sorted_.mapInArrow(_join_blocks(percent), "a long, b long").distinct())


def _join_blocks(percent: int):
    """Exact joins of pairs of blocks that come sorted by job; only one job's sets are held. Intersections of all pairs are a product of incidence matrices, made a few thousand shingles at a time."""

    def stars(sides: list[int], names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[token] > 1
        row, (_, token) = row[keep], np.unique(token[keep], return_inverse=True)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        one = np.array(sides) == 0
        first, second = np.flatnonzero(one), np.flatnonzero(~one) if not one.all() else np.arange(len(sets))
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            a, b = np.searchsorted(token, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], token[a:b] - lo] = 1
            both[np.ix_(first, second)] += m[first] @ m[second].T
        link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        link &= both > 0
        link |= link.T
        open_, out = np.ones(len(sets), bool), []
        for i in range(len(sets)):
            if open_[i]:
                open_[i] = False
                edge = [i]
                while len(edge):
                    new = np.flatnonzero(link[edge].any(0) & open_)
                    open_[new] = False
                    out += [(names[i], names[j]) for j in new]
                    edge = new
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, sides, names, sets = None, [], [], []

        def flush():
            found = stars(sides, names, sets) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for j, side, name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if j != job:
                    if names:
                        yield flush()
                    job, sides, names, sets = j, [], [], []
                sides.append(side)
                names.append(name)
                sets.append(np.frombuffer(s.as_buffer(), np.int64).copy())
        if names:
            yield flush()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable over links of at least percent/100).

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer than k words is one shingle; a text without words, empty or null
    links with nothing. Repeated rows and copies are one class. An empty table gives no rows; other columns are ignored. Rows with
    a null id take part but never name a component that has another id.
    """
    rows = _components(docs, id_col, text_col, k, percent)
    names = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, comp) of every row; comp is null without words."""
    facts, links = jaccard_join(docs, id_col, text_col, k, percent)
    label = components(links.select("a", "b"))
    return facts.join(label, facts["cls"] == label["node"], "left").select("doc_id", "mark", "n", F.coalesce("component", "cls").alias("comp"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (any row where all ids are null), and every row that is in no group; rows of one id and text count once."""
    rows = _components(docs, id_col, text_col, k, percent)
    kept = _least("comp", rows.filter("comp is not null")).select("rep", "rep_mark").union(rows.filter("comp is null").select("doc_id", "mark"))
    own = "_name"
    while own.lower() in {c.lower() for c in docs.columns}:  # a name that no column of the caller has
        own += "_"
    kept = kept.select(F.struct(F.col("rep").alias("doc_id"), F.col("rep_mark").alias("mark")).alias(own))
    name = F.struct(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(F.col(quoted(text_col))).alias("mark"))
    return docs.withColumn(own, name).join(kept, own, "left_semi").dropDuplicates([own]).select(*(F.col(quoted(c)) for c in docs.columns))
