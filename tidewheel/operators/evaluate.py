"""Forecasts, losses and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from .tails import tail_means
from .windows import EPS, std, with_future, with_moments, with_past

#: Loss names; `rmse` is an alias of relative_mse, not a root.
LOSSES = ("mse", "nmse", "mae", "nmae", "relative_mse")


def base_windows(panel: DataFrame, lookback: int, horizon: int, arrays: bool = True) -> DataFrame:
    """Moments, targets and (where a model needs them) lookback values of every row: one exchange, one sort."""
    out = with_future(with_moments(panel, lookback), horizon)
    return with_past(out, lookback) if arrays else out


def forecast(method: str, step: Column, lookback: int, horizon: int, period: int = 24, index: int = 0) -> Column:
    """Prediction in hundredths at `step` (from 1) by a fixed rule.

    persistence: the last value. expected: the lookback's mean. repeat: the last `horizon` values. lookback: values from `index`. periodic: the
    mean of the values at the step's phase.
    """
    at = lambda i: F.element_at("x", i.cast("int")).cast("double")
    if method == "persistence":
        return F.col("c").cast("double")
    if method == "expected":
        return F.col("s1").cast("double") / F.col("n")
    if method == "repeat":
        if lookback < horizon:
            raise ValueError("repeat needs a lookback of the horizon at least")
        return at(step + lookback - horizon)
    if method == "lookback":
        return at(step + index)
    if method == "periodic":
        phase = F.expr(f"filter(x, (v, i) -> i % {period} = ({lookback} + step - 1) % {period})")
        return F.aggregate(phase, F.lit(0).cast("long"), lambda a, v: a + v).cast("double") / F.size(phase)
    raise ValueError(method)


def losses(rows: DataFrame) -> DataFrame:
    """Element-wise losses of rows with y and pred (hundredths) and the lookback's moments."""
    e = (F.col("y") - F.col("pred")) / 100
    dev = std(F.col("n"), F.col("s1"), F.col("s2")) / 100 + EPS
    mean = F.abs(F.col("s1").cast("double") / F.col("n") / 100) + EPS
    return rows.select("*", (e * e).alias("mse"), ((e / dev) * (e / dev)).alias("nmse"), F.abs(e).alias("mae"), F.abs(e / dev).alias("nmae"), ((e / mean) * (e / mean)).alias("relative_mse"))


def floored_losses(rows: DataFrame, floor: float) -> DataFrame:
    """Losses relative to the lookback whose scale is at least `floor` (in units), in place of a scale with EPS added."""
    e = (F.col("y") - F.col("pred")) / 100
    dev = F.greatest(std(F.col("n"), F.col("s1"), F.col("s2")) / 100, F.lit(floor))
    mean = F.greatest(F.abs(F.col("s1").cast("double") / F.col("n") / 100), F.lit(floor))
    return rows.withColumns({"mse": e * e, "mae": F.abs(e), "nmse": (e / dev) * (e / dev), "nmae": F.abs(e) / dev, "relative_mse": (e / mean) * (e / mean)})


def summaries(rows: DataFrame, metric: str, by: list[str] | None = None, user: str = "series_id") -> DataFrame:
    """Element mean and deviation, equal-user mean and deviation, and the mean of the worst tenth of users, by group.

    Users are summed first (pre-aggregated before the shuffle) and kept, one row each; the tail comes from histograms of them.
    """
    by = by or []
    m = F.col(metric)
    users = stash(rows.groupBy(*by, user).agg(F.avg(m).alias("m"), F.sum(m).alias("s"), F.sum(m * m).alias("ss"), F.count(m).alias("k")))
    k, s, ss = F.sum("k"), F.sum("s"), F.sum("ss")
    whole = users.groupBy(*by).agg(
        F.round(s / k, 6).alias(metric), F.round(F.sqrt(F.greatest(ss / k - (s / k) * (s / k), F.lit(0.0))), 4).alias(f"std_{metric}"),
        F.round(F.avg("m"), 6).alias(f"user_{metric}"), F.round(F.stddev_pop("m"), 4).alias(f"std_user_{metric}"), F.count("*").alias("users"),
    )
    tail = tail_means(users, by, "m").withColumnRenamed("tail_mean", "_tail")
    both = whole.join(tail, by, "left") if by else whole.join(F.broadcast(tail), how="left")  # one row
    return both.select(*by, metric, f"std_{metric}", f"user_{metric}", f"std_user_{metric}", F.round("_tail", 6).alias(f"w10_{metric}"), "users")
