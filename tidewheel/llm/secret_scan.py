"""Secret scans: patterns, and a character network that looks at every other candidate and what surrounds it.

Labelled findings are the candidates that patterns find, against those that they don't. All distinct ones of all texts, of any length, train the network: one convolution over the
characters of left context, candidate and right context, pooled each for itself, with one output a kind. They lie in shares by a hash; in a pass, each share takes steps from the
same network where it lies, and the mean over all shares is the next pass's start. A quarter is held out: all of it calibrates each output (Platt's scaling, sums by Spark) and gives each
kind the largest threshold that still recalls RECALL of its held-out findings, exactly. Candidates above it that no pattern found are added.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, discard, quoted, stash, text_bytes, tidy

# Kinds in their order and their patterns. The last number is the least length of what counts: of group 2 for assignments, else of the whole match.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    (re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), 2, 6),
    (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(rb"[0-9a-f]{24,}"), 0, 24),  # what [0-9a-f]+ finds of 24 characters and more
)
#: Characters of candidates: runs of these with CANDIDATE characters and a digit, or LONG_CANDIDATE characters.
TOKEN = np.zeros(256, bool)
TOKEN[np.frombuffer(b"+/_.=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
CANDIDATE, LONG_CANDIDATE = 8, 16
#: Bytes of context to the left and right of a candidate.
LEFT, RIGHT = 24, 8
#: Bytes of windows in a share on average, files of shares besides one for so many bytes, and groups in which sums of tasks are added before the driver has them.
SHARE_BYTES, FILES, FILE_BYTES, GROUPS = 1 << 18, 64, 1 << 26, 16
#: Findings of a kind below which nothing is learnt about it, the share held out, and the recall that thresholds keep there.
LEAST_FINDINGS, HELD_OUT, RECALL = 40, 4, 0.95
WIDTH, FILTERS, CLASSES, EPOCHS, BATCH, RATE = 5, 16, 128, 8, 128, 0.01
#: Positions of characters that are convolved at a time.
POSITIONS = 1 << 14
#: Bins of a round, and values that may come to the driver, when a value of a given rank is looked for.
BINS, FEW = 1024, 10_000


@dataclass
class Network:
    """table (WIDTH, CLASSES, FILTERS) and bias: the convolution over characters; out: pooled features to a logit a kind; scale, shift: calibration; threshold: by kind."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    threshold: np.ndarray


def classes(data: np.ndarray) -> np.ndarray:
    """Characters as the network sees them: ASCII, 127 for all others, 0 for none."""
    return np.where(data < 127, data, 127).astype(np.uint8)


def _convolved(x: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(rows, n, FILTERS) of classes (rows, n + WIDTH - 1)."""
    n = x.shape[1] - WIDTH + 1
    h = table[0][x[:, :n]] + bias
    for w in range(1, WIDTH):
        h += table[w][x[:, w : w + n]]
    return np.maximum(h, 0, out=h)


def _padded(data: np.ndarray, lo: np.ndarray, s: np.ndarray, e: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of each window with two empty characters at both ends, part of each position: 1 left, 2 candidate, 3 right, 0 beyond)."""
    n, half = int((hi - lo).max()), WIDTH // 2
    at = lo[:, None] + np.arange(n)
    inside = at < hi[:, None]
    x = np.zeros((len(lo), n + 2 * half), np.uint8)
    x[:, half : half + n] = np.where(inside, classes(data[np.minimum(at, max(len(data) - 1, 0))]), 0)
    return x, np.where(~inside, 0, np.where(at < s[:, None], 1, np.where(at < e[:, None], 2, 3))).astype(np.uint8)


def _pooled(h: np.ndarray, part: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Largest values over left context, candidate and right context, the candidate's mean, its length's logarithm, and 1."""
    most = [np.where((part == k)[:, :, None], h, 0).max(1) for k in (1, 2, 3)]
    mean = np.where((part == 2)[:, :, None], h, 0).sum(1) / length[:, None]
    return np.concatenate([*most, mean, np.log(length)[:, None], np.ones((len(h), 1))], 1)


def features(net: Network, data: np.ndarray, lo: np.ndarray, s: np.ndarray, e: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Pooled features of windows [lo, hi) with candidates [s, e) in `data`. Windows of like length go together; one longer than POSITIONS goes in pieces, so no length is too long."""
    out = np.zeros((len(lo), 4 * FILTERS + 2))
    for at in _alike(hi - lo):
        if _fits(hi - lo, at):
            x, part = _padded(data, lo[at], s[at], e[at], hi[at])
            out[at] = _pooled(_convolved(x, net.table, net.bias), part, (e - s)[at].astype(float))
        else:
            out[at[0]] = _in_pieces(net, data, *(int(v[at[0]]) for v in (lo, s, e, hi)))[0]
    return out


def _alike(length: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of windows of like length, of POSITIONS together when padded; a longer window comes alone."""
    order, k = np.argsort(length, kind="stable"), 0
    while k < len(order):
        n = 1
        while k + n < len(order) and (n + 1) * int(length[order[k + n]]) <= POSITIONS:
            n += 1
        yield order[k : k + n]
        k += n


def _fits(length: np.ndarray, at: np.ndarray) -> bool:
    return len(at) > 1 or length[at[0]] <= POSITIONS


def _pieces(data: np.ndarray, lo: int, s: int, hi: int, hidden: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes with two more characters at both ends, places) of a window's pieces; a hidden left context is empty characters."""
    half = WIDTH // 2
    for a in range(lo, hi, POSITIONS):
        b = min(a + POSITIONS, hi)
        x = np.zeros((1, b - a + 2 * half), np.uint8)
        left, right = max(a - half, lo), min(b + half, hi)
        x[0, left - a + half : right - a + half] = classes(data[left:right])
        if hidden:
            x[0, : max(0, s - a + half)] = 0
        yield x, np.arange(a, b)


def _in_pieces(net: Network, data: np.ndarray, lo: int, s: int, e: int, hi: int, hidden: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(pooled features, place of the largest value of each part and filter, -1 where none is above 0) of one window."""
    most, top, total = np.zeros((3, FILTERS)), np.full((3, FILTERS), -1), np.zeros(FILTERS)
    for x, at in _pieces(data, lo, s, hi, hidden):
        h = _convolved(x, net.table, net.bias)[0]
        for k, inside in enumerate((at < s, (at >= s) & (at < e), at >= e)):
            if inside.any():
                here = h[inside]
                larger = here.max(0) > most[k]
                top[k] = np.where(larger, at[inside][here.argmax(0)], top[k])
                most[k] = np.maximum(most[k], here.max(0))
        total += h[(at >= s) & (at < e)].sum(0)
    return np.concatenate([*most, total / (e - s), [np.log(e - s), 1.0]]), top


def probabilities(net: Network, feats: np.ndarray) -> np.ndarray:
    """Calibrated probabilities (rows, kinds)."""
    return 1 / (1 + np.exp(-np.clip((feats @ net.out) * net.scale + net.shift, -60, 60)))


def _table_gradient(x: np.ndarray, dh: np.ndarray) -> np.ndarray:
    """Gradient of the table, from that of the convolved values (rows, n, FILTERS), most of which are 0."""
    row, at, f = np.nonzero(dh)
    v, x = dh[row, at, f], x.astype(np.int64) * FILTERS
    return np.stack([np.bincount(x[row, at + w] + f, v, CLASSES * FILTERS).reshape(CLASSES, FILTERS) for w in range(WIDTH)])


def _loss(net: Network, feats: np.ndarray, labels: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(cross entropy, gradients of logits and of features), rows weighted by `each`."""
    z = np.clip(feats @ net.out, -60, 60)
    dz = (1 / (1 + np.exp(-z)) - labels) * each[:, None]
    return float(((np.logaddexp(0, z) - labels * z) * each[:, None]).sum()), dz, dz @ net.out.T


def gradient(net: Network, x: np.ndarray, part: np.ndarray, length: np.ndarray, labels: np.ndarray, each: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(cross entropy, gradients of table, bias, out) of a batch: the mean, or rows weighted by `each`."""
    h = _convolved(x, net.table, net.bias)
    feats = _pooled(h, part, length)
    loss, dz, dfeats = _loss(net, feats, labels, np.full(len(x), 1 / labels.size) if each is None else each)
    dh = np.zeros_like(h)
    for k in range(3):
        held = np.where((part == k + 1)[:, :, None], h, 0)
        top = held.argmax(1)[:, None]
        on = np.take_along_axis(held, top, 1) > 0
        np.put_along_axis(dh, top, np.take_along_axis(dh, top, 1) + on * dfeats[:, None, k * FILTERS : (k + 1) * FILTERS], 1)
    dh += ((part == 2)[:, :, None] & (h > 0)) * (dfeats[:, 3 * FILTERS : 4 * FILTERS] / length[:, None])[:, None]
    return loss, _table_gradient(x, dh), dh.sum((0, 1)), feats.T @ dz


def gradient_in_pieces(net: Network, data: np.ndarray, lo: int, s: int, e: int, hi: int, labels: np.ndarray, each: float, hidden: bool = False) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """`gradient` of one window, however long it is."""
    feats, top = _in_pieces(net, data, lo, s, e, hi, hidden)
    loss, dz, dfeats = _loss(net, feats[None], labels[None], np.array([each]))
    dtable, dbias = np.zeros_like(net.table), np.zeros_like(net.bias)
    for x, at in _pieces(data, lo, s, hi, hidden):
        h = _convolved(x, net.table, net.bias)
        dh = ((at >= s) & (at < e))[:, None] * (h > 0) * (dfeats[0, 3 * FILTERS : 4 * FILTERS] / (e - s))
        for k in range(3):
            f = np.flatnonzero((top[k] >= at[0]) & (top[k] <= at[-1]))
            dh[0, top[k, f] - at[0], f] += dfeats[0, k * FILTERS + f]
        dtable += _table_gradient(x, dh)
        dbias += dh.sum((0, 1))
    return loss, dtable, dbias, feats[:, None] * dz


def _platt(sums: Callable[[np.ndarray], np.ndarray], kinds: int, rounds: int) -> np.ndarray:
    """Slope and shift of each kind by Newton steps. `sums` gives, for each kind, those of r z, r, q z z, q z and q, with r = p - target and q = p (1 - p). A slope below 0 isn't taken."""
    ab = np.tile([1.0, 0.0], (kinds, 1))
    for _ in range(rounds):
        got = sums(ab)
        grad = got[:, :2] + 1e-3 * (ab - [1.0, 0.0])
        move = np.linalg.solve(got[:, [2, 3, 3, 4]].reshape(-1, 2, 2) + 1e-3 * np.eye(2), grad[:, :, None])[:, :, 0]
        most = np.abs(move).max(1, keepdims=True)
        ab = ab - move * np.minimum(1.0, 2.0 / (most + 1e-12))
        if most.max() < 1e-9:
            break
    return np.where(ab[:, :1] > 0, ab, [1.0, 0.0])


def calibrated(z: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's scaling: slope and shift of a logistic regression of held-out labels on logits, with his smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    t = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def sums(ab: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(ab[0, 0] * z + ab[0, 1], -60, 60)))
        r, q = p - t, p * (1 - p)
        return np.array([[r @ z, r.sum(), q @ (z * z), q @ z, q.sum()]])

    a, b = _platt(sums, 1, rounds)[0]
    return float(a), float(b)


def _has(k: int) -> Column:
    return F.col("bits").bitwiseAND(1 << k) > 0


def calibrate(held: DataFrame, kinds: list[int], rounds: int = 50) -> np.ndarray:
    """`calibrated` of `kinds` over all rows (bits, z), (kinds, 2): Spark adds, five sums of a kind come to the driver in a round."""
    has = [_has(k) for k in kinds]
    n, *pos = held.agg(F.count("*"), *(F.count_if(c) for c in has)).first()

    def sums(ab: np.ndarray) -> np.ndarray:
        out = []
        for i, (a, b) in enumerate(ab):
            z = F.col("z")[kinds[i]]
            p = 1 / (1 + F.exp(-F.greatest(F.least(z * float(a) + float(b), F.lit(60.0)), F.lit(-60.0))))
            r, q = p - F.when(has[i], (pos[i] + 1) / (pos[i] + 2)).otherwise(1 / (n - pos[i] + 2)), p * (1 - p)
            out += [r * z, r, q * z * z, q * z, q]
        return np.array(held.agg(*(F.sum(x).alias(f"s{i}") for i, x in enumerate(out))).first(), float).reshape(-1, 5)

    return _platt(sums, len(kinds), rounds)


def ranked(values: DataFrame, m: int) -> float:
    """The value x with m others before it in rising order, exactly: counts in bins narrow the range until FEW values, or equal ones, are left."""
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    while n > FEW and lo < hi:
        at = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        for r in values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect():
            if m < r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            m -= r.n
        values = values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
    return lo if lo == hi else values.orderBy("x").limit(m + 1).collect()[m].x


_SHAPES = ((WIDTH, CLASSES, FILTERS), (FILTERS,), (4 * FILTERS + 2, len(KINDS)))
_PARAMS = sum(int(np.prod(s)) for s in _SHAPES)


def _network(params: np.ndarray) -> Network:
    """A network that lies in `params`, not calibrated."""
    cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES])[:-1]
    return Network(*(p.reshape(s) for p, s in zip(np.split(params, cuts), _SHAPES, strict=True)), np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), np.inf))


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and each row's offsets."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _labels(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(len(KINDS))) & 1).astype(float)


def _steps(state: np.ndarray, own: pa.StructArray, weights: tuple[float, float], rng: np.random.Generator) -> int:
    """Adam's steps over a share, in `state`: parameters, both moments, number of steps. Left contexts are hidden in half of the examples, so that the candidate itself must tell."""
    data, off = _bytes_of(own.field("w"))
    lo, hi = off[:-1], off[1:]
    s, e = lo + own.field("s").to_numpy(), lo + own.field("e").to_numpy()
    bits = own.field("bits").to_numpy()
    labels, each = _labels(bits), np.where(bits > 0, *weights)
    p, m, v = (state[i * _PARAMS : (i + 1) * _PARAMS] for i in range(3))
    net, order = _network(p), rng.permutation(len(lo))
    for k in range(0, len(order), BATCH):
        at, g = order[k : k + BATCH], np.zeros(_PARAMS)
        hidden, part_of = rng.random(len(at)) < 0.5, each[at] / (len(at) * len(KINDS))
        for i in _alike((hi - lo)[at]):
            j = at[i]
            if _fits((hi - lo)[at], i):
                x, part = _padded(data, lo[j], s[j], e[j], hi[j])
                x[:, WIDTH // 2 : WIDTH // 2 + part.shape[1]][hidden[i][:, None] & (part == 1)] = 0
                _, *grads = gradient(net, x, part, (e - s)[j].astype(float), labels[j], part_of[i])
            else:
                _, *grads = gradient_in_pieces(net, data, *(int(u[j[0]]) for u in (lo, s, e, hi)), labels[j[0]], float(part_of[i[0]]), bool(hidden[i[0]]))
            g += np.concatenate([x.ravel() for x in grads])
        state[-1] += 1
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= RATE * (m / (1 - 0.9 ** state[-1])) / (np.sqrt(v / (1 - 0.999 ** state[-1])) + 1e-8)
    return -(-len(order) // BATCH)


_SUMS = pa.schema([("part", pa.int32()), ("steps", pa.int64()), ("state", pa.binary())])


def _pass(start: np.ndarray, weights: tuple[float, float], seed: tuple[int, int]):
    """One row a task: the sum of its shares' states after their steps from `start`, each as often as it took steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps = np.zeros(len(start)), 0
        for batch in batches:
            for i, share in enumerate(batch.column(0).to_pylist()):
                state = start.copy()
                n = _steps(state, batch.column(1).slice(i, 1).flatten(), weights, np.random.default_rng((*seed, share)))
                total += n * state
                steps += n
        if steps:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId() % GROUPS, "steps": steps, "state": total.tobytes()}], _SUMS)

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, float) for b in rows.column("state").to_pylist()], axis=0)
    return pa.Table.from_pylist([{"part": rows.column("part")[0].as_py(), "steps": sum(rows.column("steps").to_pylist()), "state": total.tobytes()}], _SUMS)


def _logits(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = _bytes_of(batch.column(0))
            lo, s, e = off[:-1], *(off[:-1] + batch.column(i).to_numpy() for i in (1, 2))
            z = features(net, data, lo, s, e, off[1:]) @ net.out
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * len(KINDS), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(3), lists], ["bits", "z"])

    return run


def train(windows: DataFrame | list[tuple[bytes, int, int, int]], seed: int = 0) -> Network | None:
    """A network of all (w, s, e, bits): window, start of the candidate, its end, bits of kinds. None where no kind has LEAST_FINDINGS findings, or nothing else is there to tell them from.

    In the loss, findings together weigh as much as other candidates; calibration and thresholds count each held-out example once. A pass takes one job, whose sums come to the driver in GROUPS
    rows of 3 * _PARAMS numbers; means are rounded to 32 bits, so that the order of additions, and with it the number of tasks, doesn't matter.
    """
    if isinstance(windows, list):
        known = _labels(np.array([w[3] for w in windows], int)).sum(0) >= LEAST_FINDINGS
        if not known.any() or sum(w[3] == 0 for w in windows) < LEAST_FINDINGS:
            return None
        windows = SparkSession.active().createDataFrame(windows, "w binary, s long, e long, bits int")
    spark = windows.sparkSession
    seen = stash(windows.select("w", "s", "e", "bits", F.xxhash64("w", "s", "e").alias("h")))
    held, one = F.pmod("h", F.lit(HELD_OUT)) == 0, F.col("bits") > 0
    counts = [_has(k) for k in range(len(KINDS))] + [~one, ~held & one, ~held & ~one] + [held & _has(k) for k in range(len(KINDS))]
    size, *n = seen.agg(F.sum(F.length("w")), *(F.count_if(c) for c in counts)).first()
    number, others, findings, rest, out = n[: len(KINDS)], n[-len(KINDS) - 3], n[-len(KINDS) - 2], n[-len(KINDS) - 1], n[-len(KINDS) :]
    known = np.array(number) >= LEAST_FINDINGS
    if not known.any() or others < LEAST_FINDINGS:
        discard(spark, seen.stash_path)
        return None
    many = -(-size // SHARE_BYTES)
    # so many files that passes are dealt over the cores, however few bytes shares have
    files = min(many, FILES + size // FILE_BYTES)
    dealt = seen.filter(~held).withColumn("share", F.pmod(F.xxhash64("h"), F.lit(many))).repartition(files, "share")
    used = dealt.groupBy("share").agg(F.sort_array(F.collect_list(F.struct("h", "w", "s", "e", "bits"))).alias("own"))
    shares = stash(used)
    weights = ((findings + rest) / (2 * max(findings, 1)), (findings + rest) / (2 * max(rest, 1)))
    rng = np.random.default_rng(seed)
    start = np.concatenate([rng.normal(0, 0.1, _SHAPES[0]).ravel(), np.zeros(FILTERS), rng.normal(0, 0.1, _SHAPES[2]).ravel(), np.zeros(2 * _PARAMS + 1)])
    kind = "part int, steps long, state binary"
    for epoch in range(EPOCHS):
        rows = shares.mapInArrow(tidy(_pass(start, weights, (seed, epoch))), kind).groupBy("part").applyInArrow(_added, kind).collect()
        if rows:
            start = np.sum([np.frombuffer(r.state, float) for r in sorted(rows, key=lambda r: r.part)], axis=0) / sum(r.steps for r in rows)
            start = start.astype(np.float32).astype(float)
    net = _network(start[:_PARAMS])
    scored = stash(seen.filter(held).select("w", "s", "e", "bits").mapInArrow(tidy(_logits(net)), "bits int, z array<double>"))
    for path in (seen.stash_path, shares.stash_path):
        discard(spark, path)
    kinds = [k for k in range(len(KINDS)) if known[k] and out[k]]
    if kinds:
        net.scale[kinds], net.shift[kinds] = calibrate(scored, kinds).astype(np.float32).T
    for k in kinds:
        found = scored.filter(_has(k)).select(F.col("z")[k].alias("x"))
        x = ranked(found, int(np.floor(out[k] * (1 - RECALL))))
        net.threshold[k] = max(0.5, 1 / (1 + np.exp(-np.clip(x * net.scale[k] + net.shift[k], -60, 60))))
    discard(spark, scored.stash_path)
    return net


class Scanned:
    """A block of texts: `base` (kind, row, start, end in bytes of the block) by patterns, and all candidates: `row`, `s`, `e`, window `lo` to `hi`, `bits` of kinds whose matches they touch."""

    def __init__(self, col: pa.Array):
        self.data, self.off = data, off = text_bytes(col)
        self.base: list[tuple[int, int, int, int]] = []
        raw = data.tobytes()
        for k, (pattern, group, least) in enumerate(PATTERNS):
            for i in range(len(off) - 1):
                for m in pattern.finditer(raw, int(off[i]), int(off[i + 1])):
                    if m.end(group) - m.start(group) >= least:
                        self.base.append((k, i, m.start(), m.end()))
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = TOKEN[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:]
        end[:-1] &= ~inside[1:] | edge[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        digits = np.r_[0, np.cumsum((data >= 0x30) & (data <= 0x39), dtype=np.int64)]
        keep = (e - s >= LONG_CANDIDATE) | ((e - s >= CANDIDATE) & (digits[e] > digits[s]))
        self.s, self.e = s[keep], e[keep]
        self.row = np.searchsorted(off, self.s, "right") - 1
        self.lo, self.hi = np.maximum(self.s - LEFT, off[self.row]), np.minimum(self.e + RIGHT, off[self.row + 1])
        self.bits = np.zeros(len(self.s), np.int64)
        for k, _, a, b in self.base:
            self.bits[np.searchsorted(self.e, a, "right") : np.searchsorted(self.s, b, "left")] |= 1 << k

    def places(self) -> np.ndarray:
        """Code points before each byte of the block, less those before its text."""
        return np.r_[0, np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of all candidates, some BLOCK_BYTES at a time."""
    for batch in batches:
        for part in blocks(batch, "text"):
            got = Scanned(part.column(part.schema.get_field_index("text")))
            off = np.r_[0, np.cumsum(got.hi - got.lo)]
            a = 0
            while a < len(got.lo):
                b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, "right")) - 1)
                lo, hi, own = got.lo[a:b], got.hi[a:b], off[a : b + 1] - off[a]
                w = got.data[np.arange(own[-1]) + np.repeat(lo - own[:-1], hi - lo)]
                windows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(w)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([windows, pa.array(got.s[a:b] - lo), pa.array(got.e[a:b] - lo), pa.array(got.bits[a:b].astype(np.int32))], ["w", "s", "e", "bits"])
                a = b


def examples(texts: DataFrame) -> DataFrame:
    """(w, s, e, bits) of every distinct candidate of all texts, none left out: its window, its place there, bits of kinds."""
    return texts.select("text").mapInArrow(tidy(_examples), "w binary, s long, e long, bits int").distinct()


#: A former name, of when it gave some of them only.
sample = examples


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>"


def _scan(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                got = Scanned(part.column(part.schema.get_field_index("text")))
                spans: list[list[tuple]] = [[] for _ in range(part.num_rows)]
                place = got.places()
                put = lambda row, k, s, e, *more: spans[row].append((int(place[s] - place[got.off[row]]), k, int(place[e] - place[got.off[row]]), *more))  # noqa: B023, E731
                for k, row, s, e in got.base:
                    put(row, k, s, e, True, None)
                free = np.flatnonzero(got.bits == 0)
                if net is not None and len(free):
                    p = probabilities(net, features(net, got.data, got.lo[free], got.s[free], got.e[free], got.hi[free]))
                    for j, k in zip(*np.nonzero(p >= net.threshold), strict=True):
                        i = free[j]
                        put(got.row[i], int(k), got.s[i], got.e[i], False, float(p[j, k]))
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": base, "probability": p} for s, k, e, base, p in sorted(own, key=lambda x: x[:2])] for own in spans]
                own = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(_SPAN))], [*(n for n in part.schema.names if n != "text"), "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: array of (kind, start, end, base, probability) by start and kind; places are code points, the end is exclusive.

    base: found by a pattern (probability is null); others are what the network adds. An assignment's span is its whole match. A null or empty text has no spans; repeated ids are
    rows of their own; other columns are ignored. With fewer than LEAST_FINDINGS distinct findings of a kind nothing is added for it. No documents: no rows.
    """
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    net = train(examples(texts))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidy(_scan(net)), f"doc_id {kind}, spans {_SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """`find_secrets` in columns: counts of pattern findings by kind, a digest of them, and all spans as text."""
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
