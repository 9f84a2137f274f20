"""Mini-batch training of linear forecasters: Spark adds up one weighted Gram matrix for each batch, optimizers step over those; absolute losses step over the windows themselves.

A batch is a share of the windows by the hash of their key, so its size grows with the data while the number of batches (a parameter) doesn't: what reaches the driver
is `batches` matrices of (lags + 1) x (lags + 1 + horizon) numbers, whatever the number of windows. Quadratic losses need nothing else, for gradients and for validation alike.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams, linear
from . import normalize as nrm
from ..sources.shared import discard, stash
from .windows import EPS, ranked, std

#: Weights under which a loss of (y - pred) is a weighted mean of squares, from a window's moments in hundredths. `floor` bounds the scale from below (0: EPS is added).
LOSSES = ("mse", "nmse", "relative_mse")
#: Losses whose gradient needs the windows: absolute errors over the same scales.
ABSOLUTE = {"mae": "mse", "nmae": "nmse"}
Step = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


@dataclass
class Grams:
    """Sums over a batch of windows: xx (lags + 1 squared), xy (lags + 1 by horizon), yy (sum of squared targets), weight (sum of weights times steps)."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    weight: float

    def loss(self, w: np.ndarray) -> float:
        return max(0.0, float(self.yy - 2 * np.sum(w * self.xy) + np.sum(w * (self.xx @ w)))) / self.weight

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return 2 * (self.xx @ w - self.xy) / self.weight

    def __add__(self, other: Grams) -> Grams:
        return Grams(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.weight + other.weight)


def scale_of(loss: str, floor: float = 0.0) -> Column:
    """What an error is divided by, in hundredths: 1, the lookback's deviation or the size of its mean. With a floor the scale is at least that (in units), else EPS is added."""
    if loss not in LOSSES:
        raise ValueError(f"{loss} is not quadratic; its gradient isn't one of Gram matrices")
    if loss == "mse":
        return F.lit(100.0)
    size = std(F.col("n"), F.col("s1"), F.col("s2")) if loss == "nmse" else F.abs(F.col("s1").cast("double") / F.col("n"))
    return F.greatest(size, F.lit(100 * floor)) if floor else size + 100 * EPS


def normalized_windows(windows: DataFrame, name: str = "identity") -> DataFrame:
    """Windows with x and y through a normalization, in its units. Global ones need the columns gm, gd, lo and hi."""
    forward = nrm.NORMALIZATIONS[name][0]
    each = lambda c: F.transform(c, lambda v: forward(v.cast("double") / 100))
    return windows.withColumn("zx", each("x")).withColumn("zy", each("y"))


def batch_grams(windows: DataFrame, batches: int | None = 16, seed: int = 0, normalization: str = "identity", loss: str = "mse", floor: float = 0.0, key: tuple[str, ...] = ("series_id", "t")) -> list[Grams]:
    """One Grams for each batch that has windows; losses are those of the predictions brought back to the panel's units. Tasks send partial sums of each batch; a batch's sums are added in parts, so no batch's windows meet anywhere. `batches` None takes the batches
    of `sized_batches`; their matrices must fit GRAM_BYTES, else batches are too small for their number and should be larger."""
    if normalization in ("sigmoid", "tanh", "revin_arcsinh"):
        raise ValueError(f"{normalization} isn't affine, so its losses aren't quadratic")
    inverse = nrm.NORMALIZATIONS[normalization][1]
    scale = (inverse(F.lit(1.0)) - inverse(F.lit(0.0))) * 100 / scale_of(loss, floor)
    batch = (F.col("batch") if batches is None else F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(batches)).cast("int")).alias("key")
    rows = normalized_windows(windows, normalization).select(batch, "zx", "zy", scale.alias("s"))

    if batches is None:
        r = windows.select("batch", F.size("x").alias("l"), F.size("y").alias("h")).agg(F.max("batch").alias("n"), F.max("l").alias("l"), F.max("h").alias("h")).first()
        if r.n is not None and (r.n + 1) * (r.l + 1) * (r.l + 1 + r.h) * 8 > GRAM_BYTES:
            raise ValueError(f"{r.n + 1} batches of {r.l} lags and {r.h} steps are more than the driver takes; make batches larger")
    out = []
    for r in grams.sums(rows).orderBy("key").collect():  # a row a batch, bounded above
        xx, xy, (yy, k) = grams.unpacked(np.frombuffer(r.packed), r.lags, 2)
        out.append(Grams(xx, xy, yy, k))
    return out


def sized_batches(windows: DataFrame, size: int, seed: int = 0, key: tuple[str, ...] = ("series_id", "t")) -> DataFrame:
    """`windows` with batch, from 0: every batch but the last has `size` of them, in the order of a seeded hash of their key.

    Ranks are counted inside buckets of the hash and bucket counts tell how many come before, so no task numbers all windows.
    """
    order = F.xxhash64(F.lit(seed), *key)
    placed = ranked(windows, [], F.shiftright(order, 52), [order, *key], "_rank")
    return placed.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


#: Bytes of Gram matrices that the driver takes at most.
GRAM_BYTES = 1 << 30
#: Numbers of second derivatives that a task sends at most; a larger head is fitted by gradients alone.
CURVES = 1 << 17


class Scattered:
    """A batch whose windows stay on executors: each loss and gradient is one pass, with the weights sent along and the sums added in a tree.

    rows: (zx, zy, s), or their `grams.window_blocks`, which passes over kept tables should read; the error of a step is s |x W + b - y|, with x divided by `scale`. With `smooth` a small
    error counts as its square, so that the loss has a gradient everywhere: sqrt(e^2 + smooth^2) - smooth. `number` tells which of the blocks' numbers is s.
    """

    def __init__(self, rows: DataFrame, smooth: float = 0.0, scale: np.ndarray | None = None, number: int = 0):
        self.rows = rows if "packed" in rows.columns else grams.window_blocks(rows.select(F.lit(0).alias("key"), "zx", "zy", F.col("s").cast("double").alias("s")))
        self.smooth, self.scale, self.number, self._known = smooth, scale, number, None

    @property
    def xy(self) -> np.ndarray:
        """Zeros of the weights' shape."""
        first = self.rows.select("lags", "steps").first()
        return np.zeros((first.lags + 1, first.steps))

    def _added(self, w: np.ndarray, curves: bool) -> np.ndarray:
        """Sums over all windows, as one vector: the gradient, (with `curves`) each step's second derivatives, each step's losses and the number of windows."""
        smooth, scale, number, held = self.smooth, self.scale, self.number, self.rows.sparkSession.sparkContext.broadcast(w.copy())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, w = None, held.value
            upper = np.triu_indices(len(w))
            for b in batches:
                for _, x, y, numbers in grams.windows_of(b):
                    x, s = np.c_[x if scale is None else x / scale, np.ones(len(x))], numbers[number][:, None]
                    e = (x @ w - y) * s
                    size = np.sqrt(e * e + smooth * smooth)
                    slope = (np.sign(e) if not smooth else e / size) * s
                    bend = smooth * smooth / size**3 * s * s if curves else None
                    second = [((x * c[:, None]).T @ x)[upper] for c in bend.T] if curves else []
                    got = np.concatenate([(x.T @ slope).ravel(), *second, np.sum(size - smooth, 0), [float(len(e))]])
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([0], pa.int32())], ["key", "packed", "lags"])

        try:
            got = grams.tree(self.rows.mapInArrow(run, "key int, packed binary, lags int"), grams.levels_for(w.size + curves * curved_numbers(w))).first()
        finally:
            held.unpersist()
        if got is None:
            raise ValueError("no windows to fit on")
        return np.frombuffer(got.packed)

    def both(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        if self._known is not None and np.array_equal(self._known[0], w):
            return self._known[1:]
        v, steps = self._added(w, False), w.shape[1]
        self._known = (w.copy(), float(v[-1 - steps : -1].sum() / v[-1] / steps), v[: w.size].reshape(w.shape) / v[-1] / steps)
        return self._known[1:]

    def curved(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean loss, gradient, second derivatives) of each step of the horizon for itself: steps, lags + 1 by steps, and steps by lags + 1 squared."""
        (n, steps), v = w.shape, self._added(w, True)
        second = np.zeros((steps, n, n))
        second[:, *np.triu_indices(n)] = v[w.size : -1 - steps].reshape(steps, -1)
        second += np.triu(second, 1).transpose(0, 2, 1)
        return v[-1 - steps : -1] / v[-1], v[: w.size].reshape(w.shape) / v[-1], second / v[-1]

    def loss(self, w: np.ndarray) -> float:
        return self.both(w)[0]

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.both(w)[1]

    def __add__(self, other: Scattered) -> Scattered:
        return Scattered(self.rows.unionByName(other.rows), self.smooth, self.scale, self.number)


def curved_numbers(w: np.ndarray) -> int:
    """Numbers of the second derivatives of a head: a packed triangle a step."""
    n, steps = w.shape
    return steps * n * (n + 1) // 2


def error_scale(normalization: str, loss: str, floor: float) -> Column:
    """What brings an error in a normalization's units back to those of a loss."""
    if normalization in ("sigmoid", "tanh", "revin_arcsinh"):
        raise ValueError(f"{normalization} isn't affine")
    inverse = nrm.NORMALIZATIONS[normalization][1]
    return (inverse(F.lit(1.0)) - inverse(F.lit(0.0))) * 100 / scale_of(ABSOLUTE.get(loss, loss), floor)


def error_rows(windows: DataFrame, normalization: str = "identity", loss: str = "mae", floor: float = 0.0) -> DataFrame:
    """(batch if there is one, zx, zy, s): windows in a normalization's units, and what brings an error back to those of the loss."""
    kept = ["batch"] if "batch" in windows.columns else []
    return normalized_windows(windows, normalization).select(*kept, "zx", "zy", error_scale(normalization, loss, floor).alias("s"))


def scattered_batches(windows: DataFrame, normalization: str = "identity", loss: str = "mae", floor: float = 0.0) -> list[Scattered]:
    """One `Scattered` for each value of `batch` (`sized_batches`), or one of all windows. Rows are written once, sorted by batch, so a batch reads its own row groups."""
    rows = error_rows(windows, normalization, loss, floor)
    if "batch" not in rows.columns:
        return [Scattered(stash(Scattered(rows).rows))]
    kept = stash(grams.window_blocks(rows.repartitionByRange("batch").sortWithinPartitions("batch").select(F.col("batch").alias("key"), "zx", "zy", F.col("s").cast("double").alias("s"))))
    last = kept.agg(F.max("key")).first()[0]
    return [] if last is None else [Scattered(kept.filter(F.col("key") == b).withColumn("key", F.lit(0))) for b in range(last + 1)]


def minimized(batch: Scattered | Grams, start: np.ndarray, rounds: int | None = 60, memory: int = 8, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """(weights, losses of the rounds) by L-BFGS with halved steps until the loss falls enough; stops when it falls by less than `tolerance` of itself."""
    w, pairs = start.copy(), []
    loss, g = batch.loss(w), batch.gradient(w)
    history = [loss]
    for _ in itertools.count() if rounds is None else range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append(np.sum(s * q) / np.sum(s * y))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= np.sum(s * y) / np.sum(y * y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - np.sum(y * q) / np.sum(s * y)) * s
        slope, step = float(np.sum(g * q)), 1.0 if pairs else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        if slope <= 0:
            break
        while step > 1e-8:
            new = w - step * q
            now = batch.loss(new)
            if now <= loss - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        after = batch.gradient(new)
        s, y = new - w, after - g
        if np.sum(s * y) > 1e-14 * np.sum(y * y):
            pairs = [*pairs, (s, y)][-memory:]
        fell, w, g, loss = loss - now, new, after, now
        history.append(loss)
        if fell <= tolerance * max(loss, 1e-300):
            break
    return w, history


def settled(batch: Scattered, start: np.ndarray, rounds: int | None = None, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """(weights, losses of the rounds) by damped Newton steps, one pass each: steps of the horizon share passes but not weights, so each has its own damping, which rises where its loss would.

    A step is done when an undamped move, or a second damped one, lowers its loss by less than `tolerance` of it, or when no move lowers it.
    """
    w, n = start.copy(), len(start)
    loss, g, second = batch.curved(w)
    damping, slow, going, history = np.full(len(loss), 1e-3), np.zeros(len(loss), bool), np.ones(len(loss), bool), [float(loss.mean())]
    while going.any() and (rounds is None or len(history) <= rounds):
        new = w.copy()
        for i in np.flatnonzero(going):
            new[:, i] -= np.linalg.lstsq(second[i] + damping[i] * np.trace(second[i]) / n * np.eye(n), g[:, i], rcond=None)[0]
        now, slope, bend = batch.curved(new)
        lower = going & (now <= loss)
        little = lower & (loss - now <= tolerance * loss)
        going &= ~(little & (slow | (damping <= 1e-3))) & (lower | (damping < 1e6))
        slow = np.where(lower, little, slow)
        damping = np.where(lower, np.maximum(damping / 10, 1e-9), damping * 10)
        w[:, lower], g[:, lower], second[lower], loss = new[:, lower], slope[:, lower], bend[lower], np.where(lower, now, loss)
        history.append(float(loss.mean()))
    return w, history


def fit_heads(windows: DataFrame, losses: Sequence[str], normalization: str = "identity", floor: float = 0.0, rounds: int | None = None, smooth: tuple[float, ...] = (0.3, 0.03, 0.003)) -> dict[str, tuple[np.ndarray, list[float]]]:
    """(weights, losses of the rounds) of a head of least loss over all windows, for each of `losses`: quadratic ones by least squares, absolute ones from there by losses that are smoothed less
    and less (shares of its own error), each until a round gains next to nothing, or for `rounds`.

    The windows are cut and written once, with a scale for each kind of loss, and read in every round; what moves is weights and sums of tasks.
    """
    kinds = list(dict.fromkeys(ABSOLUTE.get(loss, loss) for loss in losses))
    scales = [error_scale(normalization, kind, floor).cast("double").alias(f"s{i}") for i, kind in enumerate(kinds)]
    rows = stash(grams.window_blocks(normalized_windows(windows, normalization).select(F.lit(0).alias("key"), "zx", "zy", *scales)))
    out, first = {}, {kinds[r.key]: grams.unpacked(np.frombuffer(r.packed), r.lags, 2)[:2] for r in grams.block_sums(rows).collect()}  # a row a kind
    if not first:
        raise ValueError("no windows to fit on")
    for loss in losses:
        xx, xy = first[ABSOLUTE.get(loss, loss)]
        if loss not in ABSOLUTE:
            out[loss] = linear.solve(xx, xy), []
            continue
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300) / max(xx[-1, -1], 1e-300))
        w = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale[:, None], rcond=None)[0]
        w[-1] /= scale[-1]
        batch = lambda share: Scattered(rows, share, scale[:-1], kinds.index(ABSOLUTE[loss]))  # noqa: B023, E731
        fit, least, history = settled if curved_numbers(w) <= CURVES else minimized, batch(0.0).loss(w), []
        for share in smooth:
            w, got = fit(batch(share * max(least, 1e-12)), w, rounds)
            history += got
        out[loss] = np.r_[w[:-1] / scale[:-1, None], w[-1:]], history
    discard(rows)
    return out


def fit_absolute(windows: DataFrame, normalization: str = "identity", loss: str = "mae", floor: float = 0.0, rounds: int | None = None, smooth: tuple[float, ...] = (0.3, 0.03, 0.003)) -> tuple[np.ndarray, list[float]]:
    """(weights, losses) of the least mean absolute error over all windows: see `fit_heads`."""
    return fit_heads(windows, [loss], normalization, floor, rounds, smooth)[loss]


def optimizer(name: str | Callable[[], Step], rate: float = 1e-5, **options: float) -> Step:
    """A step (weights, gradient, number of the step from 1) -> weights, by the usual rules of adam, adamw, sgd and rmsprop, or what a factory gives."""
    if callable(name):
        return name()
    kind, state = name.lower(), {}
    decay, momentum, eps = options.get("weight_decay", 0.01 if kind == "adamw" else 0.0), options.get("momentum", 0.0), options.get("eps", 1e-8)

    def adam(w: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        b1, b2 = options.get("beta1", 0.9), options.get("beta2", 0.999)
        w, g = (w * (1 - rate * decay), g) if kind == "adamw" else (w, g + decay * w)
        state["m"] = b1 * state.get("m", 0.0) + (1 - b1) * g
        state["v"] = b2 * state.get("v", 0.0) + (1 - b2) * g * g
        return w - rate * (state["m"] / (1 - b1**t)) / (np.sqrt(state["v"] / (1 - b2**t)) + eps)

    def sgd(w: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        g = g + decay * w
        state["m"] = momentum * state["m"] + g if "m" in state else g
        return w - rate * state["m"]

    def rmsprop(w: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
        g, alpha = g + decay * w, options.get("alpha", 0.99)
        state["v"] = alpha * state.get("v", 0.0) + (1 - alpha) * g * g
        move = g / (np.sqrt(state["v"]) + eps)
        state["m"] = momentum * state.get("m", 0.0) + move
        return w - rate * (state["m"] if momentum else move)

    steps = {"adam": adam, "adamw": adam, "sgd": sgd, "rmsprop": rmsprop}
    if kind not in steps:
        raise ValueError(f"no such optimizer: {name}")
    return steps[kind]


def fit(train: list[Grams], epochs: int, step: Step, valid: dict[str, list[Grams]] | None = None, valid_every: int | None = None, log_every: int | None = None,
        clip: float | None = None, seed: int = 0, start: np.ndarray | None = None, schedule: Callable[[int], float] | None = None) -> tuple[np.ndarray, dict]:
    """(weights, history). Batches come in an order drawn anew each epoch.

    history: `train` has each step's loss, `train_batch` the mean since the last record and `valid` each validation split's loss, both every `valid_every` steps (an epoch by
    default) and at the end if steps are left; `log` names the recorded steps that fall on `log_every`, a multiple of `valid_every`. `schedule` scales each step's move.
    Without epochs or batches: the start (zeros) and an empty history that says why.
    """
    every = valid_every or max(1, len(train))
    logged = log_every or max(1, len(train))
    if every < 1 or logged < 1:
        raise ValueError("intervals must be positive")
    if logged % every:
        raise ValueError("log_every must be a multiple of valid_every")
    history: dict = {"train": [], "train_batch": [], "valid": {}, "log": [], "elapsed_seconds": 0.0}
    if epochs <= 0 or not train:
        return (np.zeros((0, 0)) if start is None and not train else np.zeros_like(train[0].xy) if start is None else start), history | {"skipped": "epochs <= 0" if epochs <= 0 else "no windows"}
    began, rng = time.perf_counter(), np.random.default_rng(seed)
    w, recent, t = np.zeros_like(train[0].xy) if start is None else start.copy(), [], 0
    checks = {name: sum(parts[1:], parts[0]) for name, parts in (valid or {}).items() if parts}

    def record() -> None:
        history["train_batch"].append({"step": t, "loss": sum(recent) / len(recent)})
        recent.clear()
        for name, g in checks.items():
            history["valid"].setdefault(name, []).append({"step": t, "loss": g.loss(w)})

    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            loss, g = train[i].loss(w), train[i].gradient(w)
            if clip is not None:
                g = g * min(1.0, clip / (float(np.linalg.norm(g)) + 1e-12))
            t += 1
            moved = step(w, g, t)
            w = moved if schedule is None else w + (moved - w) * schedule(t)
            history["train"].append(loss)
            recent.append(loss)
            if t % every == 0:
                record()
                if t % logged == 0:
                    history["log"].append(t)
    if recent:
        record()
    history["elapsed_seconds"] = time.perf_counter() - began
    return w, history


def trend_matrix(lookback: int, kernel: int = 25) -> np.ndarray:
    """The moving average over `kernel` (odd) values with ends repeated, as a matrix: trend = A x."""
    near = np.arange(lookback)[:, None] + np.arange(kernel) - (kernel - 1) // 2
    out = np.zeros((lookback, lookback))
    np.add.at(out, (np.arange(lookback)[:, None], np.clip(near, 0, lookback - 1)), 1 / kernel)
    return out


def two_heads(lookback: int, kernel: int = 25) -> tuple[np.ndarray, Callable[[Grams], Grams]]:
    """(T, map): a head on the residual and one on the trend, each with an intercept, over the windows of a `Grams` of lags.

    Residual and trend are linear in the lags, so their Gram matrices follow from those of the lags and no window is read again. Weights V of the two heads
    are weights T V of the lags.
    """
    trend, n = trend_matrix(lookback, kernel), lookback
    t = np.zeros((n + 1, 2 * n + 2))
    t[:n, :n], t[n, n] = (np.eye(n) - trend).T, 1
    t[:n, n + 1 : -1], t[n, -1] = trend.T, 1
    return t, lambda g: Grams(t.T @ g.xx @ t, t.T @ g.xy, g.yy, g.weight)


def fit_two_heads(train: list[Grams], epochs: int, step: Step, valid: dict[str, list[Grams]] | None = None, kernel: int = 25, **options) -> tuple[np.ndarray, dict]:
    """`fit` of decomposed heads that start at 1 / lookback without intercepts; the weights are given back over the lags, as for any linear model."""
    if not train:
        return fit(train, epochs, step, valid, **options)
    lookback, horizon = len(train[0].xx) - 1, train[0].xy.shape[1]
    t, mapped = two_heads(lookback, kernel)
    one = np.r_[np.full(lookback, 1 / lookback), 0.0]
    start = np.repeat(np.r_[one, one][:, None], horizon, 1)
    heads, history = fit([mapped(g) for g in train], epochs, step, {k: [mapped(g) for g in v] for k, v in (valid or {}).items()}, start=start, **options)
    return t @ heads, history


def predict(windows: DataFrame, weights: np.ndarray, normalization: str = "identity") -> DataFrame:
    """`windows` with pred (an array of hundredths) of weights that were fitted in a normalization's units."""
    z = normalized_windows(windows, normalization)
    inverse = nrm.NORMALIZATIONS[normalization][1]
    done = grams.with_product(z, weights, "zx").drop("zx", "zy")
    return done.withColumn("pred", F.transform("pred", lambda v: inverse(v) * 100))


def save_state(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    """Weights as a table (step, lag, weight), where any later session reads them."""
    cells = [(h, i, float(weights[i, h])) for h in range(weights.shape[1]) for i in range(weights.shape[0])]
    spark.createDataFrame(cells, "step int, lag int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> np.ndarray:
    cells = spark.read.parquet(path).collect()  # lags x horizon cells
    out = np.zeros((1 + max(c.lag for c in cells), 1 + max(c.step for c in cells)))
    for c in cells:
        out[c.lag, c.step] = c.weight
    return out
