"""Reversible normalizations as column expressions over a window's moments (n, s1, s2, mx, mn in hundredths; c the last value)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import EPS, std

Transform = tuple[Callable[[Column], Column], Callable[[Column], Column]]

#: What an inverse may see of a bounded value.
CLAMP = 1e-6


def _mean() -> Column:
    return F.col("s1").cast("double") / F.col("n") / 100


def _std() -> Column:
    return std(F.col("n"), F.col("s1"), F.col("s2")) / 100


def scaled(center: Callable[[], Column], scale: Callable[[], Column]) -> Transform:
    """(x - center) / (scale + eps) and its inverse."""
    return (lambda x: (x - center()) / (scale() + EPS)), (lambda z: z * (scale() + EPS) + center())


def affine(base: Transform, gamma: float, beta: float, squash: bool = False) -> Transform:
    """An affine layer over a normalization, after an optional arcsinh. The inverse divides by gamma + eps, so it isn't exact."""

    def forward(x: Column) -> Column:
        z = base[0](x)
        return (F.asinh(z) if squash else z) * gamma + beta

    def inverse(z: Column) -> Column:
        u = (z - beta) / (gamma + EPS)
        return base[1](F.sinh(u) if squash else u)

    return forward, inverse


def gated(a: float | Column, b: float | Column, c: float | Column, d: float | Column, gamma: float | Column, nu: float | Column, alpha: float | Column, beta: float | Column) -> Transform:
    """Gated instance normalization: gates a and b say how much of mean and deviation to remove, c and d how much to restore; affine layers in and out."""
    gate = lambda g: 1 + g * (1 / (_std() + EPS) - 1)
    return (lambda x: (x - a * _mean()) * gate(b) * gamma + nu), (lambda z: (alpha * z + beta) / gate(d) + c * _mean())


def _bounded(z: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(z, F.lit(hi)), F.lit(lo))


def _logit(z: Column) -> Column:
    p = _bounded(z, CLAMP, 1 - CLAMP)
    return F.log(p / (1 - p))


def _atanh(z: Column) -> Column:
    p = _bounded(z, -1 + CLAMP, 1 - CLAMP)
    return 0.5 * (F.log(1 + p) - F.log(1 - p))


INSTANCE = scaled(_mean, _std)

NORMALIZATIONS: dict[str, Transform] = {
    "identity": (lambda x: x, lambda z: z),
    "standard": scaled(lambda: F.col("gm"), lambda: F.col("gd")),
    "min_max": scaled(lambda: F.col("lo"), lambda: F.col("hi") - F.col("lo")),
    "in_min_max": scaled(lambda: F.col("mn") / 100, lambda: F.col("mx") / 100 - F.col("mn") / 100),
    "instance": INSTANCE,
    "revin": affine(INSTANCE, 1.5, 0.25),
    "revin_last": affine(scaled(lambda: F.col("c") / 100, _std), 1.5, 0.25),
    "revin_arcsinh": affine(INSTANCE, 1.5, 0.25, squash=True),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), _logit),
    "tanh": (F.tanh, _atanh),
    "relative_mean": (lambda x: x / (F.abs(_mean()) + EPS), lambda z: z * (F.abs(_mean()) + EPS)),
    "rms": (lambda x: x / (F.sqrt(F.col("s2").cast("double") / F.col("n")) / 100 + EPS), lambda z: z * (F.sqrt(F.col("s2").cast("double") / F.col("n")) / 100 + EPS)),
    "grevin": gated(0.9, 0.8, 0.9, 0.8, 1.2, 0.1, 1.1, 0.05),
    "guarded": ((lambda x: (x - _mean()) / F.when(_std() <= 1e-8, 1.0).otherwise(_std())), (lambda z: z * F.when(_std() <= 1e-8, 1.0).otherwise(_std()) + _mean())),
}

# Presets that start with gates of 1 and those of 0, groups of parameters, and the groups that training may change.
IN, NONE = dict(a=1, b=1, c=1, d=1, gamma=1, nu=0, alpha=1, beta=0), dict(a=0, b=0, c=0, d=0, gamma=1, nu=0, alpha=1, beta=0)
PRESETS = {"in": IN, "none": NONE, "revin": IN, "previn": IN, "cmin": IN, "grevin": IN}
GROUPS = {"ab": ("a", "b"), "cd": ("c", "d"), "gamma_nu": ("gamma", "nu"), "alpha_beta": ("alpha", "beta")}
FREE = {"in": (), "none": (), "revin": ("gamma_nu",), "previn": ("gamma_nu",), "cmin": ("alpha_beta",), "grevin": ("ab", "cd", "gamma_nu", "alpha_beta")}
TIED = {"revin", "previn"}
#: Least gamma that is divided by.
LEAST_GAMMA = 1e-6


def clamp_gates(gates: dict[str, float]) -> dict[str, float]:
    return {k: min(1.0, max(0.0, v)) if k in "abcd" else v for k, v in gates.items()}


def preset(name: str, stats: dict[str, float | None] | None = None) -> dict[str, float]:
    """Starting parameters. Finite alpha and beta of loader statistics (`agg6`, `agg8`) take the place of 1 and 0."""
    if name not in PRESETS:
        raise ValueError(f"no such preset: {name}")
    known = {k: float(v) for k, v in (stats or {}).items() if k in GROUPS["alpha_beta"] and v is not None and math.isfinite(v)}
    return PRESETS[name] | known


def updated(name: str, params: dict[str, float], changes: dict[str, float], free: tuple[str, ...] | None = None) -> dict[str, float]:
    """Parameters after a training step: only those in the preset's free groups (or the ones given) change, frozen ones stay."""
    groups = FREE[name] if free is None else free
    if unknown := set(groups) - set(GROUPS):
        raise ValueError(f"no such groups: {sorted(unknown)}")
    moving = {k for g in groups for k in GROUPS[g]}
    return params | {k: v for k, v in changes.items() if k in moving}


def effective(name: str, params: dict[str, float]) -> dict[str, float]:
    """What forward and inverse take: gates in [0, 1]. Tied presets restore what they removed and undo their affine layer, whatever alpha and beta say."""
    p = clamp_gates(params)
    if name not in TIED:
        return p
    g = max(p["gamma"], LEAST_GAMMA)
    return p | {"c": p["a"], "d": p["b"], "alpha": 1 / g, "beta": -p["nu"] / g}


def of_clusters(name: str, shared: dict[str, float], own: dict[int, dict[str, float]], cluster: str = "cluster_id") -> Transform:
    """Gated normalization with a cluster's own parameters, or the shared ones where it has none: a CASE of literals, so nothing is joined."""
    sets = {k: effective(name, shared | v) for k, v in own.items()}
    base = effective(name, shared)

    def column(key: str) -> Column:
        out = F.lit(float(base[key]))
        for k, v in sets.items():
            out = F.when(F.col(cluster) == k, float(v[key])).otherwise(out)
        return out

    return gated(**{k: column(k) for k in base})
