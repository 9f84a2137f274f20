"""Linear forecasters from distributed normal equations: Gram matrices are added up in a tree, so nothing grows with the number of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams


def normal_equations(windows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y (with an intercept) of rows with arrays x and y: one packed matrix comes to the driver."""
    rows = windows.select(F.lit(0).alias("key"), F.col("x").alias("zx"), F.col("y").alias("zy"), F.lit(1.0).alias("s"))
    got = grams.sums(rows).first()
    if got is None:
        raise ValueError("no windows to fit on")
    xx, xy, _ = grams.unpacked(np.frombuffer(got.packed), got.lags, 2)
    return xx, xy


def fit_linear(windows: DataFrame, ridge: float = 0.0) -> np.ndarray:
    """(lags + 1, horizon) weights of least squares or ridge; the intercept is not penalised."""
    return solve(*normal_equations(windows), ridge)


def solve(xx: np.ndarray, xy: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    penalty = ridge * np.eye(len(xx))
    penalty[-1, -1] = 0
    return np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]


def phase_lags(lookback: int, horizon: int, period: int, offset: int = 0, cycles: int | None = None) -> list[list[int]]:
    """Lookback positions of each step's phase, the last `cycles` of them. A step without any fails."""
    if period < 1 or horizon < 1 or (cycles is not None and cycles < 1):
        raise ValueError("period, horizon and cycles must be positive")
    lags = [list(range((lookback + offset + h) % period, lookback, period)) for h in range(horizon)]
    if not all(lags):
        raise ValueError("a step has no lag of its phase")
    return [x[-cycles:] for x in lags] if cycles else lags


def fit_periodic(windows: DataFrame, lags: list[list[int]]) -> np.ndarray:
    """(lags + 1, horizon) weights by least squares: each step has a head on its own lags (`phase_lags`) and zeros elsewhere.

    One pass fits all heads, since a head's Gram matrix is a part of that of all lags. Centred, so that large values cost no digits.
    """
    xx, xy = normal_equations(windows)
    n = xx[-1, -1]
    x0, y0 = xx[-1, :-1] / n, xy[-1] / n
    cov, cross = xx[:-1, :-1] / n - np.outer(x0, x0), xy[:-1] / n - np.outer(x0, y0)
    w = np.zeros_like(xy)
    for h, at in enumerate(lags):
        w[at, h] = np.linalg.lstsq(cov[np.ix_(at, at)], cross[at, h], rcond=None)[0]
        w[-1, h] = y0[h] - x0[at] @ w[at, h]
    return w


def predict_linear(windows: DataFrame, weights: np.ndarray) -> DataFrame:
    """`windows` with pred, an array over the horizon."""
    return grams.with_product(windows, weights)


def weights_table(spark, weights: np.ndarray) -> DataFrame:
    """(step, lag, weight); lag -1 is the intercept."""
    lags = weights.shape[0] - 1
    return spark.createDataFrame([(h + 1, i if i < lags else -1, float(weights[i, h])) for h in range(weights.shape[1]) for i in range(lags + 1)], "step int, lag int, weight double")


def fit_adam(windows: DataFrame, steps: int = 300, rate: float = 0.05, clip: float = 50.0) -> np.ndarray:
    """The same linear model by Adam on the mean squared error. The gradient is linear in the Gram matrices, so they are all that the steps need."""
    xx, xy = normal_equations(windows)
    n = xx[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx) / n, 1e-12))
    gram, cross = xx / n / np.outer(scale, scale), xy / n / scale[:, None]
    w = np.zeros_like(cross)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = 2 * (gram @ w - cross)
        norm = np.linalg.norm(g)
        g = g * min(1.0, clip / (norm + 1e-12))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w / scale[:, None]


def fit_per_series(windows: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, step, slope, intercept) of each series' own regression on the last value: one aggregation for all series."""
    rows = windows.select(key, F.element_at("x", -1).cast("double").alias("last"), F.posexplode("y").alias("step", "target"))
    return rows.groupBy(key, (F.col("step") + 1).alias("step")).agg(F.regr_slope(F.col("target").cast("double"), F.col("last")).alias("slope"), F.regr_intercept(F.col("target").cast("double"), F.col("last")).alias("intercept"))


def _solved(ridge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                xx, xy, _ = grams.unpacked(np.frombuffer(b.column(1)[i].as_buffer(), float), b.column(2)[i].as_py(), 2)
                out.append(_centred(xx, xy, ridge).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["key", "weights", "lags"])

    return run


def _centred(xx: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    """Weights with an intercept by least squares (of least norm where windows are few) or ridge, from centred sums, so that large values cost no digits."""
    n = xx[-1, -1]
    x0, y0 = xx[-1, :-1] / n, xy[-1] / n
    cov, cross = xx[:-1, :-1] - n * np.outer(x0, x0), xy[:-1] - n * np.outer(x0, y0)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    scale[scale <= 1e-9 * max(scale.max(), 1e-140)] = np.inf  # a lag without variance has no weight
    if ridge:
        w = np.linalg.solve(cov + ridge * np.eye(len(cov)), cross)
    else:
        w = np.linalg.lstsq(cov / np.outer(scale, scale), cross / scale[:, None], rcond=1e-12)[0] / scale[:, None]
    return np.r_[w, (y0 - x0 @ w)[None]]


def fit_users(windows: DataFrame, key: str = "series_id", ridge: float = 0.0) -> DataFrame:
    """(key, weights, lags): each user's own least squares on all lags, with an intercept; weights are (lags, horizon) numbers as bytes.

    A user's Gram matrix is added up from partial sums where the windows are, however many tasks hold them, and solved on an executor. A user of fewer windows than lags gets
    the solution of least norm.
    """
    rows = windows.select(F.col(key).alias("key"), F.col("x").alias("zx"), F.col("y").alias("zy"), F.lit(1.0).alias("s"))
    kind = windows.schema[key].dataType.simpleString()
    return grams.sums(rows).mapInArrow(_solved(ridge), f"key {kind}, weights binary, lags int").withColumnRenamed("key", key)


#: Shares that a user's windows are dealt over when they meet the user's weights.
USER_SALTS = 8


def predict_users(windows: DataFrame, weights: DataFrame, key: str = "series_id", salts: int = USER_SALTS) -> DataFrame:
    """`windows` with pred by their user's own weights (`fit_users`), null for users without any.

    Weights come once a user and share, right before that share's windows in their order, so that no row carries a matrix and a user with most windows is dealt over tasks.
    """
    schema = grams.with_field(windows.schema, "pred")
    names = windows.columns
    kind = windows.schema[key].dataType.simpleString()
    mine = windows.select(F.col(key).alias("_key"), F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int").alias("_salt"), F.lit(1).alias("_order"), F.lit(None).cast("binary").alias("_weights"), F.lit(0).alias("_lags"), F.struct(*names).alias("_row"))
    heads = weights.select(F.col(key).cast(kind).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_order"), F.col("weights").alias("_weights"), F.col("lags").alias("_lags"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    together = mine.unionByName(heads).repartition("_key", "_salt").sortWithinPartitions("_key", "_salt", "_order")
    x_at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, w = object(), None
        for b in batches:
            keys, order, at = b.column(0).to_pylist(), b.column(2).to_numpy(), 0
            rows = b.column(5)
            while at < b.num_rows:
                if order[at] == 0:
                    have, w = keys[at], np.frombuffer(b.column(3)[at].as_buffer(), float).reshape(b.column(4)[at].as_py(), -1)
                    at += 1
                    continue
                end = at + 1
                while end < b.num_rows and order[end] == 1 and keys[end] == keys[at]:
                    end += 1
                part = rows.slice(at, end - at)
                columns = part.flatten()
                if w is not None and keys[at] == have:
                    z = grams.matrix(columns[x_at], end - at) @ w[:-1] + w[-1]
                    pred = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                else:
                    pred = pa.nulls(end - at, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*columns, pred], [*names, "pred"])
                at = end

    return together.mapInArrow(run, schema)
