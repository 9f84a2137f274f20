"""Tails by refined histograms and trained gates, against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import blocks, gates
from tidewheel.operators import normalize as nrm
from tidewheel.operators.tails import tail_means


def test_tails_equal_sorted_values(spark):
    r = random.Random(0)
    groups = {"wide": [10 ** r.uniform(-12, 12) for _ in range(500)], "zeros": [0.0] * 70, "ties": [float(r.randint(0, 3)) for _ in range(333)], "near": [1 + k * 2.0**-52 for k in range(200)], "one": [5.0], "mixed": [0.0] * 95 + [1e-300, 3.0, 3.0, 3.0, 7.0], "nine": [float(k) for k in range(9)], "eleven": [float(k) for k in range(11)], "nulls": [None, 2.0, None], "same": [0.1 + 0.2] * 50}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double").repartition(5)
    got = {x.g: x.tail_mean for x in tail_means(rows, ["g"], "v").collect()}
    want = {}
    for g, vs in groups.items():
        known = sorted((v for v in vs if v is not None), reverse=True)
        q = max(1, math.ceil(len(known) * 0.1))
        want[g] = math.fsum(known[:q]) / q
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    plan = tail_means(rows, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert tail_means(rows.filter("g = 'wide'"), [], "v").first().tail_mean == pytest.approx(want["wide"]) and tail_means(rows.limit(0), ["g"], "v").collect() == [] and tail_means(rows.limit(0), [], "v").first().tail_mean is None


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    rows = [(s, 0, t, int(1000 * s + 50 * s * np.sin(t) + rng.normal() * 30 * (s + 1) + 4 * t)) for s in range(3) for t in range(70)]
    panel = spark.createDataFrame(rows, "series_id long, variate int, t long, c long")
    return blocks.windows(panel, [("train", 0, 70)], 6, 2).filter("mx > mn")


def plain(windows):
    rows = windows.orderBy("series_id", "t").collect()
    x, y = np.array([r.x for r in rows], float) / 100, np.array([r.y for r in rows], float) / 100
    return x, y, x.mean(1), 1 / (x.std(1) + 1e-8)


def loss(p, w, x, y, m, inv):
    """By the formulas of the normalization, window by window."""
    total = 0.0
    for i in range(len(x)):
        gate = lambda g: 1 + p[g] * (inv[i] - 1)  # noqa: B023, E731
        z = p["gamma"] * (x[i] - p["a"] * m[i]) * gate("b") + p["nu"]
        pred = (p["alpha"] * (z @ w[:-1] + w[-1]) + p["beta"]) / gate("d") + p["c"] * m[i]
        total += float(np.sum((pred - y[i]) ** 2))
    return total


@pytest.mark.parametrize("name", ["grevin", "revin", "cmin"])
def test_gradients_equal_differences(windows, name):
    data, rng = plain(windows), np.random.default_rng(0)
    params = dict(zip(gates.NAMES, [0.7, 0.4, 0.6, 0.3, 1.2, 0.1, 0.9, 0.2], strict=True))
    w = rng.normal(size=(7, 2)) / 4
    value, g = gates.terms(nrm.effective(name, params), w, *data)
    assert value == pytest.approx(loss(nrm.effective(name, params), w, *data))
    g = gates.through_ties(name, params, g)
    for i, k in enumerate(gates.NAMES):
        ends = [loss(nrm.effective(name, params | {k: params[k] + d}), w, *data) for d in (-1e-5, 1e-5)]
        assert (ends[1] - ends[0]) / 2e-5 == pytest.approx(g[i], rel=1e-4, abs=1e-3)


def test_loss_falls_and_frozen_groups_stay(windows):
    start = {"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5}
    w, p, history = gates.fit_gated(windows, "grevin", start=start, rounds=4)
    assert len(history) > 1 and all(b <= a for a, b in zip(history, history[1:], strict=False)) and history[-1] < history[0] and all(0 <= p[k] <= 1 for k in "abcd")
    x, y, m, inv = plain(windows)
    assert loss(nrm.effective("grevin", p), w, x, y, m, inv) / y.size == pytest.approx(history[-1], rel=1e-6)
    _, q, falls = gates.fit_gated(windows, "grevin", free=("gamma_nu",), start=start, rounds=2)
    assert all(q[k] == start[k] for k in "abcd") and (q["alpha"], q["beta"]) == (1, 0)
    assert gates.fit_gated(windows, "in", rounds=3)[1] == nrm.preset("in")
    rows = gates.predict_gated(windows, w, "grevin", p).orderBy("series_id", "t").collect()
    assert np.mean((np.array([r.pred for r in rows]) / 100 - y) ** 2) == pytest.approx(history[-1], rel=1e-6)
    with pytest.raises(ValueError):
        gates.fit_gated(windows.limit(0))


def test_the_head_is_the_least_squares_one(windows):
    x, y, m, inv = plain(windows)
    p = nrm.preset("in")
    w, _, history = gates.fit_gated(windows, "in")
    a = np.c_[(x - m[:, None]) * inv[:, None], np.ones(len(x))] / inv[:, None]
    best = np.linalg.lstsq(a, y - m[:, None], rcond=None)[0]
    assert loss(p, w, x, y, m, inv) == pytest.approx(loss(p, best, x, y, m, inv), rel=1e-6) and history == [pytest.approx(loss(p, best, x, y, m, inv) / y.size, rel=1e-6)]


def test_clusters_train_their_own_gates_under_one_head(spark, windows):
    own = windows.withColumn("cluster_id", F.expr("case series_id when 0 then null when 1 then 4 else 7 end"))
    w, shared, params, history = gates.fit_gated_clusters(own, "grevin", free=("ab", "cd"), start={"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5}, rounds=4)
    assert set(params) == {4, 7} and len(history) > 1 and all(b <= a for a, b in zip(history, history[1:], strict=False)) and history[-1] < history[0]
    assert len({tuple(p[k] for k in "abcd") for p in (shared, params[4], params[7])}) == 3 and all(p["gamma"] == 1 for p in params.values())

    # the loss is that of each cluster's windows under its own parameters, and no other head is better
    x, y, m, inv = plain(windows)
    at = np.array([r.series_id for r in windows.orderBy("series_id", "t").collect()])
    sets = [nrm.effective("grevin", p) for p in (shared, params[4], params[7])]

    def whole(head):
        return sum(loss(p, head, x[at == i], y[at == i], m[at == i], inv[at == i]) for i, p in enumerate(sets)) / y.size

    assert whole(w) == pytest.approx(history[-1], rel=1e-6)
    pick = lambda k: np.array([sets[i][k] for i in at])
    u, v = 1 + pick("b") * (inv - 1), 1 + pick("d") * (inv - 1)
    s = (pick("alpha") / v)[:, None]
    z = np.c_[(x - (pick("a") * m)[:, None]) * u[:, None] * pick("gamma")[:, None] + pick("nu")[:, None], np.ones(len(x))] * s
    best = np.linalg.lstsq(z, y - (pick("c") * m)[:, None] - (pick("beta") / v)[:, None], rcond=None)[0]
    assert whole(w) == pytest.approx(whole(best), rel=1e-6)

    rows = gates.predict_gated(own, w, "grevin", shared, params).orderBy("series_id", "t").collect()
    assert np.mean((np.array([r.pred for r in rows]) / 100 - y) ** 2) == pytest.approx(history[-1], rel=1e-6)


def test_clusters_fall_back_to_the_shared_parameters(windows):
    every = windows.withColumn("cluster_id", F.lit(-3))
    w, shared, params, history = gates.fit_gated_clusters(every, "previn", rounds=2)
    alone = gates.fit_gated(windows, "previn", rounds=2)
    assert params == {} and np.allclose(w, alone[0]) and shared == pytest.approx(alone[1]) and history == pytest.approx(alone[2])
    _, shared, params, _ = gates.fit_gated_clusters(windows.withColumn("cluster_id", F.lit(2)), "previn", rounds=2)
    assert shared == nrm.preset("previn") and params[2] == pytest.approx(alone[1])
    with pytest.raises(ValueError):
        gates.fit_gated_clusters(every.limit(0))
    with pytest.raises(ValueError):
        gates.fit_gated_clusters(windows.selectExpr("*", "t as cluster_id").withColumn("cluster_id", F.explode(F.sequence(F.col("t") * 100, F.col("t") * 100 + 99))), "previn")
