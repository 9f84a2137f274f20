"""Forecasters by name: fixed rules, fitted linear models, and plug-ins."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .evaluate import forecast

Forecaster = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def _rule(name: str) -> Forecaster:
    def run(train: DataFrame, test: DataFrame, lookback: int, horizon: int) -> DataFrame:
        steps = F.array(*(forecast(name, F.lit(h), lookback, horizon) for h in range(1, horizon + 1)))
        return test.withColumn("pred", steps)

    return run


def _fitted(fit: Callable) -> Forecaster:
    return lambda train, test, lookback, horizon: linear.predict_linear(test, fit(train))


#: Each takes training windows, test windows (with arrays x and y), lookback and horizon, and gives the test windows with an array `pred`.
MODELS: dict[str, Forecaster] = {
    **{name: _rule(name) for name in ("persistence", "expected", "repeat", "lookback", "periodic")},
    "least_squares": _fitted(linear.fit_linear), "ridge": _fitted(lambda w: linear.fit_linear(w, 1.0)), "linear_adam": _fitted(linear.fit_adam),
}
#: Known names that need packages or weights that aren't here.
UNAVAILABLE = {"patchtst", "chronos2", "chronos_bolt", "chronos_t5", "ts_icl", "tabpfn", "tirex2"}


def model(name: str) -> Forecaster:
    """A registered model, `module:attribute`, or a .py file with `build_model`."""
    if name in MODELS:
        return MODELS[name]
    if name.lower() in UNAVAILABLE:
        raise LookupError(f"{name} needs weights or packages that are not part of this engine; register a plug-in")
    if name.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(name).stem, name)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module.build_model()
    if ":" in name:
        where, _, attribute = name.partition(":")
        return getattr(importlib.import_module(where), attribute)
    raise LookupError(f"no such model: {name}")
