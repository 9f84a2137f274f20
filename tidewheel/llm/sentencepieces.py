"""SentencePiece encoding and decoding on a relational lattice.

Each distinct word of a region of the corpus is encoded once: its substrings of bounded length are exploded, joined to the piece table and
grouped by word, and a higher-order aggregate folds the edges. Unigram models are folded by Viterbi. Byte-pair models are not: the path of
largest total score isn't what such a model's own library gives, so there the fold joins the best neighbours until none is left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bucketed, model_file, partitions, pick, text_bytes, tidy

MARK = "▁"
#: Letters and punctuation that pieces of common vocabularies keep apart (checked against the pieces).
LETTER, MARKS = "[A-Za-z\u00C0-\u024F]", "[!-/:-@\\[-`{-~]"
#: Bytes of text that share one numbering of their words; input partitions whose words are encoded once for all of them; shares of a region's words.
BLOCK_BYTES, REGION, SHARES = 8 << 20, 1024, 1024
#: An edge is one number: the piece's place by falling score, then start and end, each below 2^20. So edges sort best first, leftmost first.
BITS = 20
SPOT = (1 << BITS) - 1
SPAN = (1 << 2 * BITS) - 1
LENGTHS = 64
#: Longer words get no edges: they are joined by a queue of neighbours where they are put together.
LONG = 60


class Model:
    """Pieces, scores and kinds of a model file: what the lattice needs to know."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.get_piece_size())
        self.pieces = [own.id_to_piece(i) for i in ids]
        self.normal = [(self.pieces[i], i, float(own.get_score(i))) for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.byte_ids = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(p) for p, _, _ in self.normal)
        self.unigram = _is_unigram(path)
        # pieces of one score have one place; with its length, a place must name one piece
        scores = {v: i for i, v in enumerate(sorted({x[2] for x in self.normal}, reverse=True))}
        self.places = [scores[x[2]] for x in self.normal]
        self.named = {LENGTHS * at + len(p): i for at, (p, i, _) in zip(self.places, self.normal, strict=True)}
        if len(self.named) < len(self.normal) or self.longest >= LENGTHS:
            raise ValueError("pieces of one score need lengths of their own")
        inside = [p for p, _, _ in self.normal if MARK in p.lstrip(MARK)]
        if inside or own.is_unknown(self.byte_ids[0]):
            raise ValueError("pieces must not span words, and bytes must be pieces")
        self.newline_apart = not any("\n" in p for p, _, _ in self.normal)
        joined = re.compile(f"{LETTER}{MARKS}|{MARKS}{LETTER}")
        self.marks_apart = not any(joined.search(p) for p, _, _ in self.normal)

    def starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where words start in the UTF-8 bytes of texts (`off` bounds each text; spaces stand for marks).

        No piece spans two words: they start at marks, around line ends and between letters and punctuation, as far as the pieces allow. Every byte lies in a word.
        """
        start = np.zeros(len(data) + 1, bool)
        start[off] = True
        start = start[:-1]
        space = data == 0x20
        start[1:] |= space[1:] & ~space[:-1]
        if self.newline_apart:
            line = data == 0x0A
            start[1:] |= line[1:] | line[:-1]
        if self.marks_apart:
            wide = (data >= 0xC3) & (data <= 0xC8)  # U+00C0 to U+023F, then U+0240 to U+024F
            wide[:-1] |= (data[:-1] == 0xC9) & (data[1:] <= 0x8F)
            letter = wide | (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))
            letter[1:] |= wide[:-1]
            mark = (data > 0x20) & (data < 0x7F) & ~letter & ~((data >= 0x30) & (data <= 0x39))
            start[1:] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        return np.flatnonzero(start)

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, place, score): as large as the vocabulary, whatever the corpus, so it may be broadcast."""
        return spark.createDataFrame([(p, i, v) for i, (p, _, v) in zip(self.places, self.normal, strict=True)], "piece string, place long, score double")

    def spelled(self) -> list[bytes]:
        """What each identifier stands for in a text; nothing for control pieces."""
        out = [b""] * len(self.pieces)
        for piece, i, _ in self.normal:
            out[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    def long_word(self):
        """A function from a word of any length to the names (places with lengths, -1 - b for byte b) of its pieces, by the rule of `best_bounds` but in n log n steps."""
        known = {p: (at, score) for at, (p, _, score) in zip(self.places, self.normal, strict=True)}
        bounds = _best_path if self.unigram else _best_joins

        def names(word: str) -> list[int]:
            out: list[int] = []
            b = bounds(word, known, self.longest)
            for start, end in zip(b[:-1], b[1:], strict=True):
                piece = word[start:end]
                out += [known[piece][0] * LENGTHS + end - start] if piece in known else [-1 - x for x in piece.encode()]
            return out

        return names

    def identifiers(self, names: np.ndarray) -> np.ndarray:
        """Identifiers of places and lengths; -1 - b stands for byte b."""
        table = np.zeros(max(self.named) + 1, np.int32)
        table[list(self.named)] = list(self.named.values())
        return np.where(names >= 0, table[np.maximum(names, 0)], np.array(self.byte_ids, np.int32)[np.maximum(-1 - names, 0)]).astype(np.int32)


def _is_unigram(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM


def _best_joins(word: str, known: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """The neighbours whose union has the best place are joined, the leftmost first; after a join only its two neighbours make new unions."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # by start of a piece; an end of 0 is a start no more
    queue: list[tuple[int, int, int, int]] = []

    def offer(start: int, middle: int) -> None:
        last = end[middle]
        found = known.get(word[start:last]) if last - start <= longest else None
        if found:
            heapq.heappush(queue, (found[0], start, last, middle))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, start, last, middle = heapq.heappop(queue)
        if end[start] != middle or end[middle] != last:
            continue
        end[start], end[middle], before[last] = last, 0, start
        if start:
            offer(before[start], start)
        if last < n:
            offer(start, last)
    return [i for i in range(n) if end[i]] + [n]


def _best_path(word: str, known: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """The path of largest total score; a character that is no piece costs more than any piece."""
    total, back = [0.0], [0]
    for i in range(1, len(word) + 1):
        reach = ((total[j] + known[word[j:i]][1], j) for j in range(max(0, i - longest), i) if word[j:i] in known)
        best, at = max(reach, default=(total[i - 1] - 1000, i - 1))
        best, at = max((best, at), (total[i - 1] - 1000, i - 1))
        total.append(best)
        back.append(at)
    bounds = [len(word)]
    while bounds[-1]:
        bounds.append(back[bounds[-1]])
    return bounds[::-1]


def _decoded(ids: np.ndarray, spelled: list[bytes]) -> str:
    """The text of one document's identifiers, without the space that encoding puts before it."""
    text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def lattice(words: DataFrame, pieces: DataFrame, longest: int, keys: tuple[str, ...] = (), scored: bool = True) -> DataFrame:
    """(words' columns, n, edges, scores): every substring of up to `longest` characters that is a piece, grouped by word; scores are those of the edges (if `scored`).

    Words come partitioned by their keys and stay so: substrings meet the broadcast piece table by a 64-bit hash and are compared, and edges are grouped where
    they are. An empty substring stands for the word itself, so a word without pieces, or of more than LONG characters, has a row too; it alone carries the word, so that edges stay narrow.
    """
    words = words.withColumn("at_word", F.monotonically_increasing_id())  # rising, so that grouping sorts what is in order
    others = [c for c in words.columns if c not in keys and c != "at_word"]
    table = pieces.unionByName(words.sparkSession.createDataFrame([("", -1, 0.0)], "piece string, place long, score double"))
    table = table.select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("known"), "place", "score")
    ends = words.select("*", F.explode(F.expr(f"sequence(0, if(length(word) > {LONG}, 0, length(word) - 1))")).alias("s")).select("*", F.expr(f"substring(word, s + 1, {longest})").alias("rest"))
    spots = ends.select("*", F.explode(F.expr(f"sequence(if(s = 0, 0, 1), if(length(word) > {LONG}, 0, length(rest)))")).alias("l")).select(*words.columns, "s", "l", F.expr("substring(rest, 1, l)").alias("piece"))
    real = F.col("place") >= 0
    edge = F.when(real, F.expr(f"shiftleft(place, {2 * BITS}) + shiftleft(cast(s as bigint), {BITS}) + s + l")).alias("edge")
    score = [F.when(real, F.col("score")).alias("score")] if scored else []
    # a join on a number is much faster than one on text; two bounds make the comparison of texts no key of the join
    same = (F.xxhash64("piece") == F.col("hash")) & (F.col("piece") >= F.col("known")) & (F.col("piece") <= F.col("known"))
    edges = spots.join(F.broadcast(table), same).select(*keys, "at_word", *(F.when(F.col("l") == 0, F.col(c)).alias(c) for c in others), edge, *score)
    lists = [F.collect_list("edge").alias("edges"), *([F.collect_list("score").alias("scores")] if scored else [])]
    grouped = edges.groupBy("at_word", *keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in others), *lists)
    return grouped.drop("at_word").withColumn("n", F.length("word"))


def _ends(x: str) -> tuple[str, str]:
    """Where an edge starts and ends."""
    return f"cast(shiftright({x}, {BITS}) & {SPOT}L as int)", f"cast({x} & {SPOT}L as int)"


def best_bounds(unigram: bool):
    """Bounds of the best pieces of a word of up to LONG characters, folded over its positions.

    Unigram models: Viterbi, the path of largest total score (characters that are no piece cost more than any piece). Byte-pair
    models: the neighbours whose union scores best are joined, the leftmost first, until none can be.
    """
    if unigram:
        into = f"filter(arrays_zip(edges, scores), x -> (x.edges & {SPOT}L) = i)"
        one = f"transform({into}, x -> struct(path[cast(shiftright(x.edges, {BITS}) & {SPOT}L as int)].total + x.scores as total, shiftright(x.edges, {BITS}) & {SPOT}L as back))"
        path = f"aggregate(sequence(1, n), array(struct(0D as total, 0L as back)), (path, i) -> concat(path, array(array_max(concat({one}, array(struct(path[i - 1].total - 1000D as total, cast(i - 1 as bigint) as back)))))))"
        return F.expr(f"aggregate(sequence(1, n), struct(array(cast(n as int)) as b, {path} as path), (st, i) -> if(st.b[0] = 0, st, struct(concat(array(cast(st.path[st.b[0]].back as int)), st.b) as b, st.path as path)), st -> st.b)")
    return F.expr(f"transform(array({_joined_mask()}), m -> filter(sequence(0, n), i -> (shiftright(m, i) & 1L) = 1L))[0]")


def _joined_mask() -> str:
    """Bounds of a byte-pair word as bits of a number: a piece joins two neighbours if both its ends are bounds and one bound lies between."""
    start, end = _ends("x")
    listed = f"transform(filter(array_sort(edges), x -> {end} - {start} > 1), x -> struct(shiftleft(1L, {start}) | shiftleft(1L, {end}) as ends, shiftleft(1L, {end}) - shiftleft(2L, {start}) as inner))"
    bits = "aggregate(sequence(1, least(greatest(1, n - 1), 1 + size(es))), shiftleft(1L, n + 1) - 1L, (m, k) -> m & ~coalesce(try_element_at(filter(es, x -> (m & x.ends) = x.ends and bit_count(m & x.inner) = 1), 1).inner, 0L))"
    return f"transform(array({listed}), es -> {bits})[0]"


def encode_words(words: DataFrame, model: Model, keys: tuple[str, ...] = (), long: bool = True) -> DataFrame:
    """(words' columns, places) of distinct words: places (with lengths) of their pieces, -1 - b for byte b of a character that is no piece.

    Without `long`, the places of words beyond LONG characters stay null, for who puts them together.
    """
    found = lattice(words, model.table(words.sparkSession), model.longest, keys, model.unigram)
    mask = F.expr("aggregate(bounds, 0L, (m, i) -> m | shiftleft(1L, i))") if model.unigram else F.expr(_joined_mask())
    found = found.withColumn("bounds", best_bounds(True)) if model.unigram else found
    found = found.withColumn("m", F.when(F.col("n") <= LONG, mask))
    # an edge is taken if both its ends are bounds and no bound lies between; what no edge covers is spelled in bytes
    start, end = _ends("x")
    taken = f"filter(edges, x -> (m & (shiftleft(1L, {start}) | shiftleft(1L, {end}))) = (shiftleft(1L, {start}) | shiftleft(1L, {end})) and (m & (shiftleft(1L, {end}) - shiftleft(2L, {start}))) = 0L)"
    found = found.withColumn("taken", F.when(F.col("n") <= LONG, F.expr(f"array_sort(transform({taken}, x -> shiftleft(x & {SPAN}L, {2 * BITS - 16}) | shiftright(x, {2 * BITS})))")))
    simple = f"transform(taken, x -> cast((x & {(1 << 2 * BITS - 16) - 1}L) * {LENGTHS} + (shiftright(x, {2 * BITS - 16}) & {SPOT}L) - shiftright(x, {3 * BITS - 16}) as int))"
    bounds = "filter(sequence(0, n), i -> (shiftright(m, i) & 1L) = 1L)"
    edge = f"try_element_at(filter(edges, x -> (x & {SPAN}L) = shiftleft(cast(b[i] as bigint), {BITS}) + b[i + 1]), 1)"
    piece = "cast(substring(word, b[i] + 1, b[i + 1] - b[i]) as binary)"
    spelled = f"transform(sequence(1, octet_length({piece})), k -> -1 - cast(conv(hex(substring({piece}, k, 1)), 16, 10) as int))"
    slow = f"transform(array({bounds}), b -> flatten(transform(sequence(0, size(b) - 2), i -> transform(array({edge}), o -> if(o is null, {spelled}, array(cast(shiftright(o, {2 * BITS}) as int) * {LENGTHS} + b[i + 1] - b[i])))[0])))[0]"
    found = found.select(*words.columns, F.expr(f"case when n > {LONG} then null when size(taken) = bit_count(m) - 1 then {simple} else {slow} end").alias("places"))
    if not long:
        return found
    at, last = words.columns.index("word"), len(words.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = model.long_word()
        for batch in batches:
            filled = [p if p is not None else encoded(w) for w, p in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(filled, pa.list_(pa.int32()))], names=batch.schema.names)

    return found.mapInArrow(run, found.schema)


def _packed(values: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte of their significance."""
    wide = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(wide.T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(wide.T).view("<u4").ravel()


def _numbered(model: Model, block_bytes: int, check: bool):
    """Blocks of texts as numbers of their words: one row a block. The words stand beside, by the share that encodes them.

    A block's documents (identifiers, word counts, digests or texts, and all word numbers, those of frequent words being small)
    are compressed values; no text is moved between tasks.
    """

    def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of some texts, and how many each has. A mark goes before each text that isn't empty; a mark inside a text is as good as a space."""
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        data, off = text_bytes(pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string()))))
        start = model.starts(data, off) if len(data) else np.zeros(0, np.int64)
        bounds = pa.py_buffer(np.r_[start, len(data)].astype(np.int64))
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, bounds, pa.py_buffer(data)]), np.diff(np.searchsorted(start, off))

    def pack(block: int, region: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts = (pa.chunked_array([x.column(i) for x in held]) for i in (0, 1))
        parts, counts, kept = [], [], []
        for whole in held:
            for x in blocks(whole, whole.schema.names[1]):
                words, count = words_of(x.column(1))
                parts.append(words)
                counts.append(count)
                if check:
                    raw, off = text_bytes(x.column(1))
                    kept += [xxhash.xxh3_128_digest(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        every = pa.chunked_array(parts, pa.large_string()).dictionary_encode().combine_chunks()
        every = every.chunk(0) if isinstance(every, pa.ChunkedArray) and every.num_chunks else every
        del parts
        number = every.indices.to_numpy(zero_copy_only=False)
        often = np.bincount(number, minlength=len(every.dictionary))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = pc.replace_substring(every.dictionary.take(pa.array(order)), " ", MARK)
        long = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) > LONG)
        share = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % SHARES for w in words.to_pylist()), np.int64, len(words))
        share[long] = SHARES
        by_share = np.argsort(share, kind="stable")
        by_share = by_share[: len(by_share) - len(long)]
        names, first = np.unique(share[by_share], return_index=True)
        # words are numbered by share, then by themselves; they have no spaces, so a share's words are one text
        sorted_ = words.take(pa.array(by_share)).to_pylist()
        rising = [sorted(range(a, b), key=sorted_.__getitem__) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by_share)], strict=True)]
        columns = [pa.array(region * SHARES + names, pa.int64()), pa.array(first, pa.int32()), pa.array([" ".join([sorted_[i] for i in x]) for x in rising], pa.string())]
        shares = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.StructArray.from_arrays(columns, names=["share", "base", "words"]))
        by_share = by_share[np.array([i for x in rising for i in x], np.int64)]
        name = np.empty(len(words), np.uint32)  # of each word by frequency
        name[by_share], name[long] = np.arange(len(by_share)), len(by_share) + np.arange(len(long))
        held_docs = pa.table({"doc_id": ids, "count": pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64()), "kept": pa.array(kept, pa.binary()) if check else texts})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held_docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(held_docs)
        long_words = pa.array([[{"number": int(name[i]), "word": words[int(i)].as_py()} for i in long]], pa.list_(pa.struct([("number", pa.int32()), ("word", pa.string())])))
        return pa.RecordBatch.from_arrays([pa.array([block]), shares, pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_packed(rank[number])], pa.binary()), pa.array([_packed(name)], pa.binary()), long_words], names=["block", "shares", "docs", "numbers", "names", "long_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            lo = 0
            _, off = text_bytes(batch.column(1))
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + block_bytes - size, "right"))))
                held.append(batch.slice(lo, hi - lo))
                size += int(off[hi] - off[lo])
                lo = hi
                if size >= block_bytes:
                    yield pack((part << 24) + made, part // REGION, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield pack((part << 24) + made, part // REGION, held)

    return run


PACKED = "block long, shares array<struct<share long, base int, words string>>, docs binary, numbers binary, names binary, long_words array<struct<number int, word string>>"


def _by_block(model: Model, most: int = 4_000_000):
    """Encoded words, each with the blocks and numbers that hold it, to one compressed value for each block of a task."""

    def emit(holders: list[np.ndarray], counts: list[np.ndarray], ids: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        holder, times_ = np.concatenate(holders), np.concatenate(times)
        count, value = np.concatenate(counts), np.concatenate(ids)
        word = np.repeat(np.arange(len(times_)), times_)
        order = np.argsort(holder, kind="stable")
        holder, word = holder[order], word[order]
        block, number = holder >> 32, holder & 0xFFFFFFFF
        names, first = np.unique(block, return_index=True)
        start = np.cumsum(count) - count
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(first, np.r_[first[1:], len(block)], strict=True):
            w = word[a:b]
            n = count[w]
            at = np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for x, y in zip(out, (np.diff(number[a:b], prepend=0), n, value[at]), strict=True):
                x.append(_packed(y))
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x, pa.binary()) for x in out)], names=["dictionary", "steps", "counts", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            holders, places = batch.column(0), batch.column(1)
            new = (holders.flatten().to_numpy(zero_copy_only=False), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), model.identifiers(places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), holders.value_lengths().to_numpy(zero_copy_only=False))
            for x, y in zip(parts, new, strict=True):
                x.append(y)
            size += len(new[0])
            if size >= most:
                yield emit(*parts)
                parts, size = ([], [], [], []), 0
        if size:
            yield emit(*parts)

    return run


def _assemble(model: Model, check: bool):
    """A block's documents, and the encoding of each of its words, to identifiers; decoded again and compared if `check`."""
    spelled = model.spelled() if check else []
    flat, length = np.frombuffer(b"".join(spelled) or b"\0", np.uint8), np.array([len(x) for x in spelled], np.int64)
    place = np.cumsum(length) - length

    def gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The `n` values from each `start`, one after the other."""
        return values[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def run(block: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        row = {c: block.column(c)[0] for c in ("docs", "numbers", "names", "long_words")}
        name = _unpacked(row["names"].as_py())
        count, start = np.full(len(name), -1, np.int64), np.zeros(len(name), np.int64)
        values, base = [], 0
        for i in range(len(words)):
            steps, n, ids = (_unpacked(words.column(c)[i].as_py()) for c in ("steps", "counts", "ids"))
            at = np.cumsum(steps.astype(np.int64))
            n = n.astype(np.int64)
            count[at], start[at] = n, base + np.cumsum(n) - n
            values.append(ids.astype(np.int32))
            base += len(ids)
        encoded = model.long_word() if row["long_words"].as_py() else None
        for x in row["long_words"].as_py():
            ids = model.identifiers(np.array(encoded(x["word"]), np.int64))
            count[x["number"]], start[x["number"]] = len(ids), base
            values.append(ids)
            base += len(ids)
        if (count < 0).any():
            raise RuntimeError("a word has no encoding")
        value = np.concatenate([*values, np.zeros(0, np.int32)])
        number = name[_unpacked(row["numbers"].as_py())]
        docs = pa.ipc.open_stream(row["docs"].as_py()).read_all().combine_chunks()
        held = np.r_[0, np.cumsum(docs.column("count").to_numpy())]
        lo, n_docs = 0, len(docs)
        while lo < n_docs:  # about a quarter of a million words at once
            hi = max(lo + 1, int(np.searchsorted(held, held[lo] + (1 << 18), "right")) - 1)
            w = number[held[lo] : held[hi]]
            n = count[w]
            ids = gather(value, start[w], n)
            ends = np.r_[0, np.cumsum(n)][held[lo : hi + 1] - held[lo]]
            kept = docs.column("kept").slice(lo, hi - lo)
            if check:
                size = length[ids]
                text = gather(flat, place[ids], size)
                at = np.r_[0, np.cumsum(size)][ends]
                from_ = at[:-1] + ((np.diff(at) > 0) & (text[np.minimum(at[:-1], max(0, len(text) - 1))] == 0x20) if len(text) else 0)
                last = pa.array([xxhash.xxh3_128_digest(text[a:b].tobytes()) == k for a, b, k in zip(from_.tolist(), at[1:].tolist(), kept.to_pylist(), strict=True)], pa.bool_())
            else:
                last = kept.combine_chunks().cast(pa.string()) if isinstance(kept, pa.ChunkedArray) else kept.cast(pa.string())
                last = last.chunk(0) if isinstance(last, pa.ChunkedArray) else last
            doc_id = docs.column("doc_id").slice(lo, hi - lo).combine_chunks()
            doc_id = doc_id.chunk(0) if isinstance(doc_id, pa.ChunkedArray) else doc_id
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc_id, lists, pa.array(np.diff(ends)), last], names=["doc_id", "ids", "n_tokens", "round_trip" if check else "text"])
            lo = hi

    def whole(block: pa.Table, words: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(run(block, words))
        pa.default_memory_pool().release_unused()
        return out

    return whole


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, bucket_bytes: int = BLOCK_BYTES, check: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, text, as the model's own library would encode the text.

    With `check`, round_trip takes the place of text: each document is decoded where it was encoded and its bytes are compared with the text's by a 128-bit
    digest (false where the text itself has marks).

    Null and empty texts have no identifiers. Repeated rows have a row each; a null id stays null; an empty table gives no rows; other columns are ignored.

    Documents are read once. Each task turns blocks of about `bucket_bytes` of its texts into word numbers and keeps them, with the block's distinct words, in the shared
    folder, in files by block. Only words move: a region's words are dealt by hash, each is encoded once for all blocks that hold it (a hot word is one row for each block), and
    its identifiers go back to those blocks. Blocks are put together where their files are read; there words of more than LONG characters are encoded by a queue of neighbours.
    """
    model = Model(model_path or model_file("piece_bpe_32k.model"))
    spark = docs.sparkSession
    packed = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_numbered(model, bucket_bytes, check)), PACKED)
    packed = bucketed(packed, "block", 2 * partitions(spark))
    shares = packed.select("block", F.inline("shares")).repartition(partitions(spark), "share")
    held = shares.select("share", "block", "base", F.posexplode(F.split("words", " ")).alias("i", "word")).select("share", "word", F.expr("shiftleft(block, 32) | (base + i)").alias("holder"))
    words = held.groupBy("share", "word").agg(F.collect_list("holder").alias("holders"))
    encoded = encode_words(words, model, ("share", "word"), long=False).select("holders", "places")
    back = encoded.mapInArrow(tidy(_by_block(model)), "dictionary long, steps binary, counts binary, ids binary")
    schema = f"doc_id long, ids array<int>, n_tokens long, {'round_trip boolean' if check else 'text string'}"
    return packed.select("block", "docs", "numbers", "names", "long_words").groupBy("block").cogroup(back.groupBy("dictionary")).applyInArrow(_assemble(model, check), schema)


def decode(frame: DataFrame, ids_col: str = "ids", model_path: str | None = None, name: str = "decoded") -> DataFrame:
    """`frame` with the text of its identifiers: bytes put together, marks to spaces, without the space that encoding puts before a text. Null stays null."""
    model = Model(model_path or model_file("piece_bpe_32k.model"))
    spelled = model.spelled()
    held = frame.sparkSession.sparkContext.broadcast(spelled)  # as large as the vocabulary
    at = frame.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            texts = [_decoded(x.values.to_numpy(zero_copy_only=False), table) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.StringType())]))


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, round_trip (decoding gives the text again; false where the text itself has marks)."""
    return encode(docs, id_col, text_col, model_path, check=True).select("doc_id", "n_tokens", "ids", "round_trip")
