"""Benchmark decontamination with suffix arrays over the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, LOWER, Words, blocks, discard, others, pick, restored, stash

#: Most bytes of benchmark text in one block; a longer benchmark is searched block after block, each in a pass over the documents.
BLOCK_LIMIT = 16 << 20


class Items:
    """Test items of one block: their words as numbers of a sorted vocabulary of 64-bit hashes, with the vocabulary's bytes for the exact check."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        w = Words(pa.array(texts, pa.large_string()), ALNUM_WORDS)
        self.window = window
        self.vocabulary, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
        self.number = number.astype(np.int64)
        lower = LOWER[w.data]
        self.start, self.length, self.bytes = w.start[first], (w.end - w.start)[first], lower
        if not same_bytes(lower, w.start, w.end - w.start, lower, self.start[number], self.length[number]).all():
            raise ValueError("two words of the benchmark have one hash")
        self.item = w.row
        self.first = w.first
        self.ids = ids
        length = np.diff(w.first)
        left = w.first[1:][w.row] - np.arange(len(w.row))
        need = np.minimum(length, window)[w.row]
        ok = left >= need
        self.at, self.need, self.left = np.flatnonzero(ok), need[ok], left[ok]
        self.starts = [(int(k), *self._starts(w, np.flatnonzero(self.need == k), int(k))) for k in np.unique(self.need)]

    def _starts(self, w: Words, suffixes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the first `k` words of these test suffixes, the suffixes in that order, and where each hash's suffixes begin."""
        at, gram = w.grams(k)
        gram = gram[np.searchsorted(at, self.at[suffixes])]
        order = np.argsort(gram, kind="stable")
        hashes, first = np.unique(gram[order], return_index=True)
        return hashes, suffixes[order], np.r_[first, len(order)]

    def near(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word of a shard may lie in a match, test suffixes that may have one): a match holds a suffix's window, so the hash of its words is among the shard's.

        Hashes only choose; the words are compared by bytes afterwards. The search goes from the shard's words to the sorted windows, so its cost grows with the shard, not with the
        benchmark times the corpus.
        """
        covered, chosen = np.zeros(len(words.hash) + 1, np.int64), [np.zeros(0, np.int64)]
        for k, hashes, suffixes, first in self.starts:
            at, gram = words.grams(k)
            place = np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)
            hit = hashes[place] == gram
            covered[at[hit]] += 1
            covered[at[hit] + k] -= 1
            place = np.unique(place[hit])
            n = first[place + 1] - first[place]
            chosen.append(suffixes[np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        return np.cumsum(covered)[:-1] > 0, np.sort(np.concatenate(chosen))


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether words of two texts have the same bytes, one for one."""
    same = a_len == b_len
    at = np.flatnonzero(same)
    n = a_len[at]
    total = np.cumsum(n)
    step = np.arange(int(n.sum())) - np.repeat(total - n, n)
    differ = a[np.repeat(a_start[at], n) + step] != b[np.repeat(b_start[at], n) + step]
    seen = np.r_[0, np.cumsum(differ)]
    same[at] = seen[total] == seen[total - n]
    return same


def _suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `seq` sorted by what follows, to `depth` words at least (prefix doubling); separators are negative and never equal."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(seq)
    while k < depth:
        nxt = np.full(n, -1, np.int64)
        nxt[:-k] = rank[k:] if k < n else nxt[:-k]
        rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        k *= 2
        if len(rank) and rank.max() == n - 1:
            break
    return np.argsort(rank, kind="stable")


def _bound(seq: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, value: np.ndarray, right: bool) -> np.ndarray:
    """For each query, the first place in its [lo, hi) whose word at `depth` isn't below (or is above) its value: one binary search for all."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = sa[np.minimum(mid, len(sa) - 1)] + depth
        word = np.where(at < len(seq), seq[np.minimum(at, len(seq) - 1)], np.iinfo(np.int64).min)
        below = (word <= value if right else word < value) & open_
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def search(words: Words, items: Items) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Occurrences of test suffixes in one shard: (shard word positions, test suffix, match lengths in words).

    The shard's suffix array has every suffix that lies where windows of the benchmark may (`Items.near`): no other suffix can hold a match, since all windows of a match are windows of
    its item. Every test suffix whose window the shard may have is binary-searched word by word, as far as anything matches; the places lost at each depth give each place its longest
    match. A place where the same item matches one word earlier too is part of that match and left out at once, so repeated words hold no places times suffixes.
    """
    if not len(items.at) or not len(words.hash):
        return
    known, query = items.near(words)
    at = np.flatnonzero(known)  # every word that may match is compared byte by byte
    place = np.zeros(len(known), np.int64)
    place[at] = np.minimum(np.searchsorted(items.vocabulary, words.hash[at]), len(items.vocabulary) - 1)
    known[at] = (items.vocabulary[place[at]] == words.hash[at]) & same_bytes(LOWER[words.data], words.start[at], (words.end - words.start)[at], items.bytes, items.start[place[at]], items.length[place[at]])
    keep = np.flatnonzero(known)
    if not len(keep):
        return
    gap = np.flatnonzero((np.diff(keep) != 1) | (np.diff(words.row[keep]) != 0)) + 1
    seq = np.insert(place[keep].astype(np.int64), gap, -1 - np.arange(len(gap)))
    pos = np.insert(keep, gap, -1)
    before = np.r_[-1, seq[:-1]]  # the word before each place; negative at the start of a run

    def longest(places: np.ndarray, q: int, length: int) -> tuple[np.ndarray, int, np.ndarray]:
        own = items.at[q]
        if own > items.first[items.item[own]]:
            places = places[before[places] != items.number[own - 1]]
        return pos[places], q, np.full(len(places), length)

    sa = _suffix_array(seq, int(items.left[query].max()))
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(sa), np.int64)
    depth = 0
    while len(query):
        value = items.number[items.at[query] + depth]
        new_lo = _bound(seq, sa, lo, hi, depth, value, False)
        new_hi = _bound(seq, sa, new_lo, hi, depth, value, True)
        depth += 1
        going = (new_lo < new_hi) & (items.left[query] > depth)
        lost_any = (items.need[query] <= depth - 1) & ((lo < new_lo) | (new_hi < hi))
        for i in np.flatnonzero(lost_any | (items.left[query] == depth) & (new_lo < new_hi)):
            q = query[i]
            if items.need[q] <= depth - 1:  # places that matched so far and no further
                lost = np.r_[sa[lo[i] : new_lo[i]], sa[new_hi[i] : hi[i]]]
                if len(lost):
                    yield longest(lost, int(q), depth - 1)
            if not going[i] and new_lo[i] < new_hi[i]:
                yield longest(sa[new_lo[i] : new_hi[i]], int(q), depth)
        query, lo, hi = query[going], new_lo[going], new_hi[going]


def matches(words: Words, items: Items) -> np.ndarray:
    """Rows (row of the shard, item, word of the item, word of the row, length) of the longest verbatim matches: none can be continued by its item to the left or right."""
    found = [np.stack([at, np.full(len(at), items.at[q]), length]) for at, q, length in search(words, items)]
    if not found:
        return np.zeros((0, 5), np.int64)
    at, own, length = np.concatenate(found, axis=1)
    row, item = words.row[at], items.item[own]
    return np.stack([row, item, own - items.first[item], at - words.first[row], length], axis=1)


def _item_blocks(benchmark: DataFrame, window: int) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_LIMIT bytes (one longer item alone); the driver holds one block at a time."""
    ids, texts, size, made = [], [], 0, 0
    for item_id, text in benchmark.toLocalIterator():
        n = len((text or "").encode())
        if ids and size + n > BLOCK_LIMIT:
            yield Items(ids, texts, window)
            ids, texts, size, made = [], [], 0, made + 1
        if item_id is not None:
            ids.append(str(item_id))
            texts.append(text)
            size += n
    if ids or not made:
        yield Items(ids, texts, window)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("words", T.IntegerType())]))),
])
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))])


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(own, text, found): each row of `docs`, all but its text as a struct, so that no name can clash, and its n_words, n_hit, items (sorted ids) and matches: the longest verbatim matches of test suffixes with their places.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive words of an
    item, or a shorter item whole. A word inside any occurrence of a window is hit. Null and empty texts have no words and no hits; an
    item without words has no window; items of a null id are left out; an empty benchmark hits nothing. Rows are kept as they are, repeated ones too.

    Each block of documents is a shard with a suffix array of its own, searched in the task that read it: nothing is shuffled. A worker holds one block of
    the benchmark (BLOCK_LIMIT bytes of text). A longer benchmark takes a pass for each block, kept in the shared folder in between.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(others(docs, text_col), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast(RESULT).alias("found"))

    def scan_with(held):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                for part in blocks(batch, "text") if batch.num_rows else [batch]:
                    words = Words(part.column(1), ALNUM_WORDS)
                    got = matches(words, items)
                    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 3], got[:, 0]))]
                    bounds = np.searchsorted(got[:, 0], np.arange(part.num_rows + 1))
                    rows = []
                    for r in range(part.num_rows):
                        before, n = part.column(2)[r].as_py(), int(words.first[r + 1] - words.first[r])
                        f = [{"item_id": items.ids[i], "item_word": a, "doc_word": p, "words": k} for _, i, a, p, k in got[bounds[r] : bounds[r + 1]].tolist()]
                        f = sorted([*before["matches"], *f], key=lambda x: (x["doc_word"], x["item_id"], x["item_word"])) if before else f
                        step = np.zeros(n + 1, np.int64)
                        if f:
                            at, k = np.array([x["doc_word"] for x in f]), np.array([x["words"] for x in f])
                            np.add.at(step, at, 1)
                            np.add.at(step, at + k, -1)
                        rows.append({"n_words": n, "n_hit": int((np.cumsum(step)[:n] > 0).sum()), "items": sorted({x["item_id"] for x in f}), "matches": f})
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, _KIND)], names=["own", "text", "found"])

        return scan

    passes, kept = 0, None
    for items in _item_blocks(pick(benchmark, item=item_col, text=item_text_col), window):
        if passes:
            before, kept = kept, stash(out)
            out = kept
            if before is not None:
                discard(docs.sparkSession, before.stash_path)
        out, passes = out.mapInArrow(scan_with(sc.broadcast(items)), out.schema), passes + 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches."""
    found = find_matches(pick(docs, doc_id=id_col, text=text_col), benchmark, window=window)
    digest = F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("own.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), digest, (F.col("found.n_hit") > 0).alias("contaminated"), "found.matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without any occurrence of a window, unchanged."""
    return find_matches(docs, benchmark, text_col, window=window).filter(F.col("found.n_hit") == 0).select(*restored(docs, text_col))
