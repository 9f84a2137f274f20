"""Training of gated normalizations: gates and affine layers by gradients through each window's moments, the linear head by weighted Gram matrices, in turns.

With the gates fixed the head is a weighted least-squares problem over x-hat; with the head fixed the gradient of the gates is eight sums over the windows. Both are one pass
over kept windows each; a third pass tries several steps at once and takes the best, so that no round makes the loss larger. Clusters may have gates of their own under one head:
with the head fixed their losses don't depend on each other, so each takes its own best step in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, stash
from . import grams, linear
from . import normalize as nrm
from .windows import EPS, std

NAMES = ("a", "b", "c", "d", "gamma", "nu", "alpha", "beta")
#: Step sizes that are tried along a gradient whose largest entry is 1.
STEPS = tuple(0.5 * 4.0**-k for k in range(10))
#: Key of windows without a cluster, whose parameters are the shared ones. Clusters with parameters of their own, at most: the driver holds these.
SHARED, MOST_CLUSTERS = -1, 4096


def _rows(windows: DataFrame, cluster: str | None = None) -> DataFrame:
    """(key, x, y in units, mean, 1 / (deviation + EPS)) of each window. A null or negative cluster has the shared key."""
    units = lambda c: F.transform(c, lambda v: v.cast("double") / 100)
    key = F.lit(SHARED) if cluster is None else F.when(F.col(cluster) >= 0, F.col(cluster)).otherwise(SHARED)
    return windows.select(key.cast("long").alias("key"), units("x").alias("x"), units("y").alias("y"), (F.col("s1").cast("double") / F.col("n") / 100).alias("m"), (1 / (std(F.col("n"), F.col("s1"), F.col("s2")) / 100 + EPS)).alias("inv"))


def kept_rows(windows: DataFrame, cluster: str | None = None) -> DataFrame:
    """Windows as a written table of blocks that fits and errors read, by cluster if one is named; for several fits of the same windows."""
    return stash(grams.window_blocks(_rows(windows, cluster)))


def terms(p: dict[str, float], w: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, inv: np.ndarray, slopes: bool = True, xw: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(sum of squared errors, its gradient by NAMES or, without `slopes`, nothing) of windows under effective parameters. `xw` is x times the head's weights, if it is known."""
    m, more = m[:, None], inv[:, None] - 1
    ub, ud = 1 + p["b"] * more, 1 + p["d"] * more
    total = w[:-1].sum(0)
    low = (x @ w[:-1] if xw is None else xw) - p["a"] * m * total
    z = p["gamma"] * low * ub + p["nu"] * total + w[-1]
    out = (p["alpha"] * z + p["beta"]) / ud
    e = 2 * (out + p["c"] * m - y)
    if not slopes:
        return float(np.sum(e * e) / 4), np.zeros(0)
    s = p["alpha"] / ud
    parts = (-s * p["gamma"] * m * ub * total, s * p["gamma"] * more * low, m, -out * more / ud, s * low * ub, s * total, z / ud, 1 / ud)
    return float(np.sum(e * e) / 4), np.array([float(np.sum(e * part)) for part in parts])


def through_ties(name: str, params: dict[str, float], g: np.ndarray) -> np.ndarray:
    """The gradient by a preset's own parameters from that of its effective ones: tied presets restore what they remove."""
    if name not in nrm.TIED:
        return g
    a, b, c, d, gamma, nu, alpha, beta = g
    size = max(params["gamma"], nrm.LEAST_GAMMA)
    free = params["gamma"] > nrm.LEAST_GAMMA
    return np.array([a + c, b + d, 0.0, 0.0, gamma + free * (-alpha + beta * params["nu"]) / size**2, nu - beta / size, 0.0, 0.0])


def _summed(rows: DataFrame, w: np.ndarray, sets: dict[int, list[dict[str, float]]], slopes: bool) -> dict[int, np.ndarray]:
    """Sums over each key's windows for each of its sets of parameters: squared errors, (with `slopes`) the gradient, and the number of targets."""
    held = rows.sparkSession.sparkContext.broadcast((w, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sets = held.value
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for key, x, y, (m, inv) in grams.windows_of(b):
                xw, got = x @ w[:-1], []
                for p in sets[key]:
                    loss, g = terms(p, w, x, y, m, inv, slopes, xw)
                    got.append(np.r_[loss, g, y.size])
                totals[key] = totals.get(key, 0.0) + np.array(got)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary()), pa.array([0] * len(totals), pa.int32())], ["key", "packed", "lags"])

    try:
        got = grams.tree(rows.mapInArrow(run, "key long, packed binary, lags int"), grams.levels_for(sum(len(v) for v in sets.values()) * (len(NAMES) + 2))).collect()  # one row a key
    finally:
        held.unpersist()
    return {r.key: np.frombuffer(r.packed).reshape(len(sets[r.key]), -1) for r in got}


def _head(rows: DataFrame, params: dict[int, dict[str, float]]) -> np.ndarray:
    """The head of least squared error over all windows, under each key's effective parameters."""
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lags = None, 0
        for b in batches:
            for key, x, y, (m, inv) in grams.windows_of(b):
                p, m, more, lags = held.value[key], m[:, None], inv[:, None] - 1, x.shape[1] + 1
                s = p["alpha"] / (1 + p["d"] * more)
                zx = np.c_[(x - p["a"] * m) * (1 + p["b"] * more) * p["gamma"] + p["nu"], np.ones(len(x))] * s
                zy = ((y - p["c"] * m) * (1 + p["d"] * more) - p["beta"]) / p["alpha"] * s
                got = grams.packed(zx.T @ zx, zx.T @ zy, float(np.sum(zy * zy)), float(zy.size))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([lags], pa.int32())], ["key", "packed", "lags"])

    try:
        got = grams.tree(rows.mapInArrow(run, "key int, packed binary, lags int")).first()
    finally:
        held.unpersist()
    xx, xy, _ = grams.unpacked(np.frombuffer(got.packed), got.lags, 2)
    return linear.solve(xx, xy)


def _descent(name: str, params: dict[str, float], sums: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The gradient of the mean error by a preset's free parameters; a gate at its bound doesn't move beyond it."""
    _, *g, n = sums
    g = through_ties(name, params, np.array(g)) * mask / n
    return np.array([0.0 if k in "abcd" and ((params[k] <= 0 and v > 0) or (params[k] >= 1 and v < 0)) else v for k, v in zip(NAMES, g, strict=True)])


def _in_turns(rows: DataFrame, name: str, free: tuple[str, ...] | None, start: dict[str, float] | None, rounds: int, tolerance: float) -> tuple[np.ndarray, dict[int, dict[str, float]], list[float]]:
    """(head, parameters of each key, losses) of kept rows."""
    first = nrm.preset(name) | (start or {})
    moving = nrm.updated(name, dict.fromkeys(NAMES, 0.0), dict.fromkeys(NAMES, 1.0), free)
    mask = np.array([moving[k] for k in NAMES])
    keys = sorted(r.key for r in rows.select("key").distinct().limit(MOST_CLUSTERS + 2).collect())
    if not keys:
        raise ValueError("no windows to fit on")
    if len(keys) > MOST_CLUSTERS + 1:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: the driver holds their parameters")
    params = dict.fromkeys(keys, first)
    effective = lambda own: {k: [nrm.effective(name, p) for p in v] for k, v in own.items()}

    def head_of(own: dict[int, dict[str, float]]) -> tuple[np.ndarray, float]:
        """The best head and its mean error."""
        sets = effective({k: [p] for k, p in own.items()})
        w = _head(rows, {k: p for k, (p,) in sets.items()})
        loss, n = sum(v[0] for v in _summed(rows, w, sets, False).values())
        return w, float(loss / n)

    w, loss = head_of(params)
    history = [loss]
    for _ in range(rounds if mask.any() else 0):
        slopes = {k: _descent(name, params[k], v[0], mask) for k, v in _summed(rows, w, effective({k: [p] for k, p in params.items()}), True).items()}
        tried = {k: [params[k]] for k in keys}
        for k, g in slopes.items():
            if np.abs(g).max() > 0:
                unit = dict(zip(NAMES, g / np.abs(g).max(), strict=True))
                tried[k] += [nrm.updated(name, params[k], nrm.clamp_gates({n: params[k][n] - t * unit[n] for n in NAMES}), free) for t in STEPS]
        if all(len(v) == 1 for v in tried.values()):
            break
        best = {k: tried[k][int(np.nanargmin(v[:, 0]))] for k, v in _summed(rows, w, effective(tried), False).items()}
        head, now = head_of(best)
        if not now <= history[-1]:
            break
        params, w = best, head
        history.append(now)
        if history[-2] - history[-1] <= tolerance * history[-2]:
            break
    return w, params, history


def fit_gated(windows: DataFrame, name: str = "grevin", free: tuple[str, ...] | None = None, start: dict[str, float] | None = None, rounds: int = 8, tolerance: float = 1e-6) -> tuple[np.ndarray, dict[str, float], list[float]]:
    """(head, parameters, losses): a preset's free groups (or the ones given) and a linear head, fitted in turns to the mean squared error in units.

    losses has the error after the first head and after each round, never rising. Frozen groups keep their start. Stops when a round gains less than `tolerance` of the
    loss. No windows: an error. Windows that don't vary should be left out, since a gate below 1 leaves them a scale of 1 / EPS. `kept_rows` are read as they are, whatever their clusters.
    """
    if "packed" in windows.columns:
        w, params, history = _in_turns(windows.withColumn("key", F.lit(SHARED).cast("long")), name, free, start, rounds, tolerance)
        return w, params[SHARED], history
    rows = kept_rows(windows)
    w, params, history = _in_turns(rows, name, free, start, rounds, tolerance)
    discard(rows)
    return w, params[SHARED], history


def fit_gated_clusters(windows: DataFrame, name: str = "previn", cluster: str = "cluster_id", free: tuple[str, ...] | None = None, start: dict[str, float] | None = None, rounds: int = 8, tolerance: float = 1e-6) -> tuple[np.ndarray, dict[str, float], dict[int, dict[str, float]], list[float]]:
    """(head, shared parameters, each cluster's own, losses): as `fit_gated`, with one head for all windows and the free groups of each cluster trained on its own windows.

    Windows whose cluster is null or negative train the shared parameters, which clusters that aren't known have too; without such windows the shared ones keep their start.
    A cluster may hold most windows: its sums are added up where they are. More than MOST_CLUSTERS clusters, or no windows: an error.
    """
    rows = windows if "packed" in windows.columns else kept_rows(windows, cluster)
    w, params, history = _in_turns(rows, name, free, start, rounds, tolerance)
    if rows is not windows:
        discard(rows)
    shared = params.pop(SHARED, nrm.preset(name) | (start or {}))
    return w, shared, params, history


def mean_errors(rows: DataFrame, w: np.ndarray, name: str, params: dict[str, float], own: dict[int, dict[str, float]] | None = None) -> dict[int, tuple[float, float]]:
    """(mean squared error in units, number of targets) of each key of `kept_rows` under a head, and a cluster's own parameters or the shared ones, as `predict_gated` forecasts: one pass."""
    keys = [r.key for r in rows.select("key").distinct().limit(MOST_CLUSTERS + 2).collect()]
    if len(keys) > MOST_CLUSTERS + 1:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: the driver holds their errors")
    sums = _summed(rows, w, {k: [nrm.effective(name, (own or {}).get(k, params))] for k in keys}, False) if keys else {}
    return {k: (float(v[0, 0] / v[0, 1]), float(v[0, 1])) for k, v in sums.items()}


def predict_gated(windows: DataFrame, w: np.ndarray, name: str, params: dict[str, float], own: dict[int, dict[str, float]] | None = None, cluster: str = "cluster_id") -> DataFrame:
    """`windows` with pred in hundredths, by the shared parameters or a cluster's own."""
    forward, inverse = nrm.of_clusters(name, params, own, cluster) if own else nrm.gated(**nrm.effective(name, params))
    z = windows.withColumn("_z", F.transform("x", lambda v: forward(v.cast("double") / 100)))
    return grams.with_product(z, w, "_z").drop("_z").withColumn("pred", F.transform("pred", lambda v: inverse(v) * 100))
