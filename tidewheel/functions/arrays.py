"""Functions on arrays of numbers: smoothing, decomposition, patches, covariates. All are higher-order functions, so rows stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(x: Column, left: int, right: int) -> Column:
    """Ends repeated."""
    return F.concat(F.array_repeat(x[0], left), x, F.array_repeat(F.element_at(x, -1), right))


def convolve(x: Column, weights: list[float], size: Column) -> Column:
    """sum_j weights[j] * x[i + j] for i of 0 .. size - 1."""
    w = F.array(*(F.lit(v) for v in weights))
    span = lambda i: F.slice(x, i + 1, len(weights))
    dot = lambda i: F.aggregate(F.zip_with(span(i), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), size - 1), dot)


def moving_average(x: Column, kernel: int = 25) -> Column:
    """Trend: the mean over a window of `kernel` (odd) values, ends repeated."""
    half = (kernel - 1) // 2
    total = convolve(padded(x, half, half), [1.0] * kernel, F.size(x))
    return F.transform(total, lambda v: v / kernel)


def decompose(x: Column, kernel: int = 25) -> tuple[Column, Column]:
    """(residual, trend)."""
    trend = moving_average(x, kernel)
    return F.zip_with(x, trend, lambda a, b: a - b), trend


def gaussian_weights(kernel: int) -> list[float]:
    raw = [math.exp(-((i - kernel // 2) ** 2) / 2) for i in range(kernel)]
    return [v / sum(raw) for v in raw]


def smooth(x: Column, kernel: int = 5) -> Column:
    """Gaussian smoothing with zeros beyond the ends."""
    zeros = F.array_repeat(F.lit(0.0), kernel // 2)
    return convolve(F.concat(zeros, x, zeros), gaussian_weights(kernel), F.size(x))


def patches(x: Column, length: int = 16, stride: int = 8) -> Column:
    """Overlapping slices of x, whose last value is repeated `stride` times."""
    long = padded(x, 0, stride)
    return F.transform(F.sequence(F.lit(1), F.size(long) - length + 1, F.lit(stride)), lambda i: F.slice(long, i, length))


def kind(x: Column, lookback: int, horizon: int) -> Column:
    """What a covariate is by its length: one value is static, then past, future, both."""
    n = F.size(x)
    return F.when(n == 1, "static").when(n == lookback, "past").when(n == horizon, "future").when(n == lookback + horizon, "both").otherwise(F.raise_error(F.lit("no such covariate")))


def coerce(x: Column, lookback: int, horizon: int) -> tuple[Column, Column]:
    """(past, future) of a covariate; null where it has none; a static value is repeated."""
    k = kind(x, lookback, horizon)
    past = F.when(k == "static", F.array_repeat(x[0], lookback)).when(k == "past", x).when(k == "both", F.slice(x, 1, lookback))
    future = F.when(k == "static", F.array_repeat(x[0], horizon)).when(k == "future", x).when(k == "both", F.slice(x, lookback + 1, horizon))
    return past, future


def channels(x: Column) -> Column:
    """Generated channels by name."""
    return F.create_map(
        F.lit("identity"), x, F.lit("square"), F.transform(x, lambda v: v * F.abs(v)), F.lit("root"), F.transform(x, lambda v: F.signum(v) * F.sqrt(F.abs(v) + 1e-8)),
        F.lit("sign"), F.transform(x, F.signum), F.lit("mirror"), F.transform(x, lambda v: -v), F.lit("kernel"), smooth(x),
    )


def uniform(seed: int, *key: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) that depend on the key only, so retried tasks draw them again: 32 bits each of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key)))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / float(2**32 + 1)
    return part(1), part(9)


def noise(size: Column, seed: int, *key: Column) -> Column:
    """`size` standard normal numbers for a row's key."""

    def normal(i: Column) -> Column:
        u, v = uniform(seed, *key, i)
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)

    return F.transform(F.sequence(F.lit(0), size - 1), normal)


def generated(spec: dict, lookback: int, horizon: int, *key: Column, seed: int = 0) -> list[tuple[Column, Column | None]]:
    """(past, future) of each channel of a `noise` or `constant` specification; `past_only` channels have no future. Channels of one row differ by their number."""
    size = {"past_only": lookback, "future_included": lookback + horizon}.get(spec["target"] or "past_only")
    if size is None:
        raise ValueError(f"no such target: {spec['target']}")
    value = 1.0 if spec["value"] is None else spec["value"]
    whole = lambda k: F.array_repeat(F.lit(value), size) if spec["mode"] == "constant" else F.transform(noise(F.lit(size), seed, *key, F.lit(k)), lambda v: v * value)
    return [(F.slice(x, 1, lookback), F.slice(x, lookback + 1, horizon) if size > lookback else None) for x in map(whole, range(spec["count"]))]


# Names of the generated channels, and the options that stand for `value`.
MODES = {"identity", "square", "root", "sign", "mirror", "kernel", "noise", "constant"}
VALUE_NAMES = {"noise": ("value", "noise_scale", "scale"), "constant": ("value", "constant_value")}


def covariate_modes(specs: str | dict | list) -> list[dict]:
    """Specifications (mode, count, value, target) of mode strings `a-b-c` and of dictionaries with a name."""
    out = []
    for item in specs if isinstance(specs, list | tuple) else [specs]:
        if isinstance(item, str):
            out += [{"mode": m, "count": 1, "value": None, "target": None} for m in item.strip().split("-") if m]
            continue
        if item.get("name") is None:
            raise ValueError("a channel needs a name")
        mode, count = str(item["name"]), int(item.get("count", 1))
        value = next((float(item[k]) for k in VALUE_NAMES.get(mode, ("value",)) if item.get(k) is not None), None)
        out.append({"mode": mode, "count": count, "value": value, "target": None if item.get("target") is None else str(item["target"])})
    if unknown := [s["mode"] for s in out if s["mode"] not in MODES]:
        raise ValueError(f"no such mode: {unknown}")
    if any(s["count"] < 1 for s in out):
        raise ValueError("a count must be positive")
    return out
