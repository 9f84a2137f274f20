"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, Words, blocks, mix, pick, tidy

BITS = 18
#: Labelled rows to fit on, at most: an equal share of each grade (what a small grade lacks goes to the others), those of the least hash of their id. The bound of what the driver holds.
TRAIN_ROWS = 8000
#: Strength of the penalty on a weight. A bucket's values are scaled by how surely its share of some grade differs from its share of all
#: (z^2 / (z^2 + SURE^2), z in standard errors): evidence of chance strength is shrunk smoothly, whatever the number of rows.
L2, SURE = 0.03, 4.0


def _share(mask: np.ndarray, w: Words) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask)]
    n = np.diff(w.first)
    return np.diff(total[w.first]) / np.maximum(n, 1)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of a block of texts, one weight vector for all.

    Words (A-Z lower-cased) and what stands between words, hashed to buckets: presence for words, share for separators. Shares of
    capitalised words, of words that repeat the one before, and of word triples seen earlier in the text have buckets too.
    """
    w = Words(col, ALNUM_WORDS)
    rows = len(w.off) - 1
    shift = np.uint64(64 - BITS)

    def distinct(row, bucket):
        key, count = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | bucket, return_counts=True)
        return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), count

    r1, b1, _ = distinct(w.row, w.hash >> shift)
    s = Words(col, ~ALNUM_WORDS, lower=False)
    r2, b2, c2 = distinct(s.row, mix(s.hash ^ np.uint64(0xABCDEF)) >> shift)
    v2 = 4 * np.sqrt(c2 / np.maximum(np.diff(s.first), 1)[r2])
    upper = np.r_[0, np.cumsum((w.data >= 0x41) & (w.data <= 0x5A))]
    caps = (upper[w.end] - upper[w.start] > 1) & (upper[w.end] - upper[w.start] >= (w.end - w.start + 1) // 2)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    at, gram = w.grams(3)
    seen = np.zeros(len(w.hash), bool)
    order = np.lexsort((at, gram, w.row[at]))
    same = np.zeros(len(order), bool)
    same[1:] = (gram[order][1:] == gram[order][:-1]) & (w.row[at][order][1:] == w.row[at][order][:-1])
    seen[at[order[same]]] = True
    extra = [(int(mix(np.array([k], np.uint64))[0] >> shift), 4 * np.sqrt(_share(m, w))) for k, m in ((901, caps), (902, again), (903, seen))]
    every = np.arange(rows)
    row = np.r_[r1, r2, *[every] * 3]
    bucket = np.r_[b1, b2, *[np.full(rows, b) for b, _ in extra]]
    return row, bucket, np.r_[np.ones(len(r1)), v2, *[v for _, v in extra]].astype(np.float32)


@dataclass
class Ordinal:
    """P(grade >= j) = sigmoid(weights . x - thresholds[j - 1]); thresholds rise."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def surely(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int) -> np.ndarray:
    """Scale of each bucket, 0 to 1, from documents that hold it: a bucket of one document has next to none, with few rows or many."""
    each = np.bincount(grade, weight, grades)
    held = np.stack([np.bincount(bucket[grade[row] == g], minlength=1 << BITS) for g in range(grades)]).astype(float)
    rows = np.maximum(np.bincount(grade, minlength=grades), 1)[:, None]
    share = (each / each.sum())[:, None]
    inside = held / rows  # share of each grade's rows that hold the bucket
    overall = (inside * share).sum(0)
    z2 = np.zeros(1 << BITS)
    for g in range(grades):
        rest = (overall - inside[g] * share[g]) / np.maximum(1 - share[g], 1e-9)
        n_rest = rows.sum() - rows[g]
        pooled = (held.sum(0) + 0.5) / (rows.sum() + 1)
        z2 = np.maximum(z2, (inside[g] - rest) ** 2 / (pooled * (1 - np.minimum(pooled, 1 - 1e-6)) * (1 / rows[g] + 1 / max(1, n_rest))))
    z2 *= 1 - 1 / np.maximum(held.sum(0), 1)  # one document alone tells nothing
    return z2**2 / (z2**2 + SURE**4)


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 400, weight: np.ndarray | None = None) -> Ordinal:
    """Penalised maximum likelihood by Adam on all rows at once, each of the given weight. Without rows all weights are 0 and thresholds lie around 0."""
    n = len(grade)
    weights, theta = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    if not n:
        return Ordinal(weights, theta - 10)
    each = np.ones(n) if weight is None else weight * (n / weight.sum())
    scale = surely(row, bucket, grade, each, grades)
    kept = scale[bucket] > 1e-3  # what is shrunk to nothing needs no column
    names, col = np.unique(bucket[kept], return_inverse=True)
    row, value = row[kept], value[kept].astype(float) * scale[bucket[kept]]
    p = np.r_[np.zeros(len(names)), theta[:1], np.log(np.diff(theta))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w = p[: len(names)]
        th = np.cumsum(np.r_[p[len(names)], np.exp(p[len(names) + 1 :])])
        score = np.bincount(row, w[col] * value, n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - th[None, :], -30, 30)))
        full = np.c_[np.ones(n), tail, np.zeros(n)]
        slope = np.c_[np.zeros(n), tail * (1 - tail), np.zeros(n)]
        at = np.arange(n)
        prob = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        g_score = -each * (slope[at, grade] - slope[at, grade + 1]) / prob
        g_th = np.zeros((n, grades + 1))
        g_th[at, grade] += each * slope[at, grade] / prob
        g_th[at, grade + 1] -= each * slope[at, grade + 1] / prob
        g_th = g_th[:, 1:grades].sum(0)
        step_th = np.cumsum(g_th[::-1])[::-1]
        grad = np.r_[np.bincount(col, g_score[row] * value, len(names)) + L2 * w, step_th[0], step_th[1:] * np.exp(p[len(names) + 1 :])] / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= 0.05 * (0.02 + 0.98 * (1 - t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights[names] = p[: len(names)] * scale[names]
    return Ordinal(weights, np.cumsum(np.r_[p[len(names)], np.exp(p[len(names) + 1 :])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good. Rows without either label are left out; of several the lowest grade counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, grades: int = 3) -> Ordinal:
    """Fit on `rows` labelled rows at most, weighted so that grades count as in all labels. Texts are turned to features where they lie; the driver gets numbers of one text for each of these rows."""
    marked = graded(labels)
    number = {r.grade: r.n for r in marked.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    room, taken = rows, {}
    for i, g in enumerate(sorted(number, key=lambda g: (number[g], g))):  # the smallest grade first
        taken[g] = min(number[g], room // (len(number) - i))
        room -= taken[g]
    sample = reduce(DataFrame.union, [marked.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(taken[g]) for g in sorted(number)], marked.limit(0))
    held = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("text", "grade", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                row, bucket, value = features(part.column(0))
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                bucket, value = bucket[order].astype(np.int32), value[order]
                lists = [pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (bucket, value)]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), *lists], names=["doc_id", "grade", "bucket", "value"])

    # of texts with one id the least counts, so that the fit is repeatable
    of_id = held.mapInArrow(tidy(run), "doc_id long, grade int, bucket binary, value binary").groupBy("doc_id", "grade").agg(F.min(F.struct("bucket", "value")).alias("x"))
    got = of_id.select("doc_id", "grade", "x.*").toPandas().sort_values("doc_id")
    bucket = [np.frombuffer(x, np.int32) for x in got["bucket"]]
    row = np.repeat(np.arange(len(got)), [len(x) for x in bucket])
    empty = [np.zeros(0, np.int32)]
    return fit(row, np.concatenate([*bucket, *empty]), np.concatenate([*(np.frombuffer(x, np.float32) for x in got["value"]), np.zeros(0, np.float32)]), got["grade"].to_numpy(np.int64), grades, weight=got["grade"].map(lambda g: number[g] / taken[g]).to_numpy(float))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", name: str = "_score") -> DataFrame:
    """`docs` with a column `name`: expected grade and the probability of each tail (grade 1 at least, 2 at least, ...). Null counts as empty text."""
    sc = docs.sparkSession.sparkContext
    used = np.flatnonzero(model.weights)
    held = sc.broadcast((used, model.weights[used], model.thresholds))
    at = docs.columns.index(text_col)
    kind = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, some, thresholds = held.value
        weights = np.zeros(1 << BITS)
        weights[used] = some
        own = Ordinal(weights, thresholds)
        for batch in batches:
            for part in blocks(batch, text_col) if batch.num_rows else [batch]:
                row, bucket, value = features(part.column(at))
                tails = own.tails(np.bincount(row, weights[bucket] * value, part.num_rows))
                out = pa.array([{"expected_grade": float(t.sum()), "tails": t.tolist()} for t in tails], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, expected_grade (0 to 2), tail_probability (that the grade is the highest), keep (tail_probability >= least).

    Empty and null texts are scored like others, by what they lack. Without labelled documents every tail is near 1 and all is kept.
    """
    scored = score(pick(docs, doc_id=id_col, text=text_col), train(docs, labels, id_col, text_col, rows))
    tail = F.element_at("_score.tails", -1)
    return scored.select("doc_id", F.col("_score.expected_grade").alias("expected_grade"), tail.alias("tail_probability"), (tail >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, unchanged and in place: nothing is shuffled."""
    name = "_score"
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    scored = score(docs, train(docs, labels, id_col, text_col), text_col, name)
    return scored.filter(F.element_at(f"{name}.tails", -1) >= least).drop(name)
