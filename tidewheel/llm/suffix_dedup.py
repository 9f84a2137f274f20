"""Repeated passages across documents by sparse suffix arrays at minimiser positions.

Only suffixes at minimisers are retained. They are sorted by their words; neighbours are compared byte by byte to the right, and their words before the minimiser to the
left. Two texts share a passage around a minimiser if both extents together reach its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORDS, Words, blocks, partitions, pick, signed, stash

#: A passage is so many words at least. Suffixes are compared by SEED words first; one of each LEAST_WORDS - SEED + 1 consecutive seeds is retained.
LEAST_WORDS, SEED = 50, 24
#: Seeds of more suffixes than this aren't compared in one task: their passages are counted by digest, pre-aggregated in every task.
HOT_SUFFIXES = 1024


def minimisers(words: Words, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each passage of `least` words, the retained suffix in it, its seed's hash, the passage's hash).

    In each passage the seed of least hash (the leftmost of equals) is retained: the choice depends on the passage's words alone, so
    equal passages retain the same place of theirs.
    """
    at, gram = words.grams(seed)
    start, whole = words.grams(least)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    span = least - seed + 1
    where = np.full(len(words.hash), -1, np.int64)
    where[at] = np.arange(len(at))
    first = where[start]
    best = first.copy()
    # sliding minimum by doubling: after each round `best` is the place of the least seed of `width` consecutive ones
    low = np.arange(len(gram))
    width = 1
    while width * 2 <= span:
        right = np.minimum(np.arange(len(gram)) + width, len(gram) - 1)
        other = low[right]
        low = np.where(gram[other] < gram[low], other, low)
        width *= 2
    a, b = low[first], low[first + span - width]
    best = np.where((gram[b] < gram[a]) | ((gram[b] == gram[a]) & (b < a)), b, a)
    return start, at[best], signed(gram[best]), signed(whole)


def _seeds(least: int, seed: int):
    """(seed hash, text mark, number of places) of the retained suffixes: one row for a text however often it repeats a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(part.column(1), SPACE_WORDS)
                _, place, gram, _ = minimisers(words, least, seed)
                place, at = np.unique(place, return_index=True)
                row, seed_ = words.row[place], gram[at]
                order = np.lexsort((seed_, row))
                row, seed_ = row[order], seed_[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (seed_[1:] != seed_[:-1])]) if len(row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seed_[new]), part.column(0).take(pa.array(row[new])), pa.array(np.diff(np.r_[new, len(row)]))], names=["seed", "mark", "places"])

    return run


def _suffixes(least: int, seed: int):
    """Each retained suffix whose seed is shared: its first `least` words, the `least - seed` words before it, and where the text has it (all places with the same words around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                words = Words(part.column(1), SPACE_WORDS)
                _, place, gram, _ = minimisers(words, least, seed)
                place, at = np.unique(place, return_index=True)
                gram, row = gram[at], words.row[place]
                # words in lower case with one space between
                n = words.end - words.start
                end = np.cumsum(n + 1)
                plain = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                plain[np.repeat(end - n - 1, n) + step] = LOWER[words.data[np.repeat(words.start, n) + step]]
                plain = plain.tobytes()
                known = [frozenset(s) for s in part.column(3).to_pylist()]
                hot = [frozenset(s) for s in part.column(4).to_pylist()]
                found: dict[tuple, list[int]] = {}
                for p, g, r in zip(place.tolist(), gram.tolist(), row.tolist(), strict=True):
                    if g in known[r]:
                        lo, hi = int(words.first[r]), int(words.first[r + 1])
                        a, b = max(lo, p - least + seed), min(hi, p + least)
                        at = int(end[p] - n[p] - 1)
                        found.setdefault((r, g, plain[int(end[a] - n[a] - 1) : max(0, at - 1)] if a < p else b"", plain[at : int(end[b - 1]) - 1]), []).append(p - lo)
                rows = [x[0] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in found], pa.int64()), pa.array([x[1] in hot[x[0]] for x in found], pa.bool_()), *(part.column(i).take(pa.array(rows, pa.int64())) for i in (0, 2)), pa.array([x[2] for x in found], pa.binary()), pa.array([x[3] for x in found], pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["seed", "hot", "mark", "tid", "before", "after", "places"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """How many words two runs of words have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] != b[:n]:
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return a[: n - (differ.bit_length() + 7) // 8].count(b" ")
    if not n:
        return 0
    whole = (len(a) == n or a[n] == 0x20) and (len(b) == n or b[n] == 0x20)
    return a[:n].count(b" ") + whole


def _reach(befores: list[bytes], afters: list[bytes], alone: list[bool], ids: list, least: int, widest: int) -> list[list]:
    """For different suffixes of one seed, sorted by their words: for each and each number of words to the left, the least id of the texts that share the passage (an empty text: none does)."""
    n = len(afters)
    right = [_common(afters[i - 1], afters[i]) for i in range(1, n)]
    n_left, n_right = [x.count(b" ") + (x != b"") for x in befores], [x.count(b" ") + 1 for x in afters]
    words = [x.split(b" ") for x in befores]
    out: list[list] = [[""] * (widest + 1) for _ in range(n)]
    for left in range(widest + 1):
        groups: dict[tuple, list[int]] = {}
        run = 0
        for i in range(n):
            if i and right[i - 1] < least - left:
                run += 1
            if n_left[i] >= left and n_right[i] >= least - left:
                groups.setdefault((run, b" ".join(words[i][len(words[i]) - left :])) if left else (run, b""), []).append(i)
        for members in groups.values():
            if len(members) > 1 or not alone[members[0]]:
                origin = min((ids[i] for i in members if ids[i] is not None), default=None)
                for i in members:
                    out[i][left] = origin
    return out


def _neighbours(least: int, seed: int):
    """Suffixes come sorted by seed, words and the words before. Those of one seed are compared with their neighbours; matches are extended to the left and come out as ranges of passage starts."""
    widest = least - seed

    def spans(held: list[tuple]) -> Iterator[tuple[int, int, int, int | None]]:
        classes: dict[tuple[bytes, bytes], list[tuple]] = {}
        for x in held:
            classes.setdefault((x[1], x[0]), []).append(x)
        if len(held) == 1 and len(held[0][4]) == 1:
            return
        names = sorted(classes)
        members = [classes[x] for x in names]
        alone = [len(m) == 1 and len(m[0][4]) == 1 for m in members]
        ids = [min((x[3] for x in m if x[3] is not None), default=None) for m in members]
        for m, origin in zip(members, _reach([x[1] for x in names], [x[0] for x in names], alone, ids, least, widest), strict=True):
            lo = 0
            while lo <= widest:
                hi = lo
                while hi < widest and origin[hi + 1] == origin[lo]:
                    hi += 1
                if origin[lo] != "":
                    for _, _, mark, _, places in m:
                        for p in places:
                            yield mark, p - hi, p - lo, origin[lo]
                lo = hi + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["mark", "start", "last", "origin"])

        for batch in batches:
            found: list[tuple] = []
            for s, mark, tid, before, after, places in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if s != at:
                    found += spans(held) if held else ()
                    at, held = s, []
                held.append((before, after, mark, tid, places))
            yield batch_of(found)
        if held:
            yield batch_of(list(spans(held)))

    return run


def _passages(least: int, seed: int):
    """Every passage around a suffix of a hot seed, by digest, and where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                out: tuple[list, ...] = ([], [], [], [])
                for mark, tid, before, after, places in zip(*(batch.column(i).slice(lo, 1024).to_pylist() for i in range(4)), batch.column(4).slice(lo, 1024).to_pylist(), strict=True):
                    b, a = before.split(b" ") if before else [], after.split(b" ")
                    for left in range(min(len(b), least - seed) + 1):
                        if len(a) >= least - left:
                            name = hashlib.sha256(b" ".join([*b[len(b) - left :], *a[: least - left]])).digest()
                            for p in places:
                                for x, y in zip(out, (name, mark, tid, p - left), strict=True):
                                    x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["passage", "mark", "tid", "start"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document (id and text; different texts of one id, or of none, have a row each) that holds a passage of `least` words or more that occurs elsewhere too (in another document, or again in this one).

    doc_id, n_words, n_repeated (words inside such passages), first_doc_id (the least id among the texts that held one of its passages
    first), spans (array of first word and number of words; passages that touch or overlap are one). Words are `[^\\x20\\x09-\\x0D]+`,
    A-Z lower-cased. Shorter texts, null and empty ones have none. All passages are found, whatever their number of copies. Exact copies count as
    repeats of their whole text. Null ids come after all others and never name a first document. An empty table gives no rows; other columns are ignored.

    1. Copies of a text are one text, told from others by a 64-bit hash and ordered by its least id. 2. Each text keeps the suffixes at its minimisers; those whose seed no other place
    has are dropped. 3. Suffixes of shared seeds, with the words around them, are sorted by seed and words. Neighbours are compared and extended to both sides by bytes. A seed of
    more than HOT_SUFFIXES texts never meets in one task: its passages are counted by digest instead, pre-aggregated. 4. Ranges of repeated passages are merged to spans.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = stash(rows.groupBy("mark").agg(F.min("doc_id").alias("tid"), F.count("*").alias("copies")))

    seeds = stash(rows.select("mark", "text").mapInArrow(_seeds(least, seed), "seed long, mark long, places long"))
    # a seed is shared by two texts, or by two places of one; counts are pre-aggregated, and the join can be split at hot seeds
    shared = seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.max("places").alias("most")).filter("lo < hi or most > 1").select("seed", (F.col("n") > HOT_SUFFIXES).alias("hot"))
    shared = seeds.join(shared, "seed").groupBy("mark").agg(F.collect_set("seed").alias("seeds"), F.collect_set(F.when(F.col("hot"), F.col("seed"))).alias("hot")).join(texts.drop("copies"), "mark")
    # one row of each text, that of its least id; structs compare nulls as equal
    inside = rows.select(F.struct("doc_id", "mark").alias("_name"), "text")
    shared = shared.withColumn("_own", F.struct(F.col("tid").alias("doc_id"), "mark"))
    held = inside.join(shared, F.col("_name") == F.col("_own")).dropDuplicates(["_name"]).select("mark", "text", "tid", "seeds", "hot")
    suffixes = stash(held.mapInArrow(_suffixes(least, seed), "seed long, hot boolean, mark long, tid long, before binary, after binary, places array<long>"))
    sorted_ = suffixes.filter("not hot").select("seed", "mark", "tid", "before", "after", "places").repartition(partitions(docs.sparkSession), "seed").sortWithinPartitions("seed", "after", "before")
    found = sorted_.mapInArrow(_neighbours(least, seed), "mark long, start long, last long, origin long")
    hot = suffixes.filter("hot").select("mark", "tid", "before", "after", "places").mapInArrow(_passages(least, seed), "passage binary, mark long, tid long, start long")
    often = hot.groupBy("passage").agg(F.min("tid").alias("origin"), F.count("*").alias("n"), F.min(F.struct("mark", "start")).alias("lo"), F.max(F.struct("mark", "start")).alias("hi")).filter("lo <> hi").select("passage", "origin")
    found = found.union(hot.join(often, "passage").select("mark", "start", F.col("start").alias("last"), "origin").distinct())

    order = Window.partitionBy("mark").orderBy("start", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("mark").orderBy("start", "last").rowsBetween(Window.unboundedPreceding, 0)
    ranges = found.groupBy("mark", "start", "last").agg(F.min("origin").alias("origin"))
    ranges = ranges.withColumn("new", F.coalesce((F.col("start") > F.max("last").over(order) + least).cast("int"), F.lit(1)))
    runs = ranges.withColumn("run", F.sum("new").over(upto)).groupBy("mark", "run").agg(F.min("start").alias("first"), (F.max("last") + least - F.min("start")).alias("words"), F.min("origin").alias("origin"))
    spans = runs.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("n_repeated"), F.min("origin").alias("first_doc_id"))
    counts = rows.select("doc_id", "mark", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long").alias("n_words")).filter(F.col("n_words") >= least)
    counts = counts.groupBy("doc_id", "mark").agg(F.max("n_words").alias("n_words"))
    out = counts.join(texts.join(spans, "mark", "left"), "mark").filter("copies > 1 or n_repeated is not null")
    whole = F.col("copies") > 1
    return out.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_repeated")).alias("n_repeated"), F.when(whole, F.least("tid", F.coalesce("first_doc_id", "tid"))).otherwise(F.col("first_doc_id")).alias("first_doc_id"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("words")))).otherwise(F.col("spans")).alias("spans"),
    )
