"""Window blocks, packed Gram sums, matrix products, per-user models and absolute losses, against frames and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import blocks, grams, training
from tidewheel.operators import evaluate as ev
from tidewheel.operators import linear as lin
from tidewheel.operators import windows as win

SPLITS = [("train", 0, 60), ("valid1", 60, 80), ("test1", 80, 101)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), v, t, f"d{t}", int(rng.integers(-500, 900)) + 40 * s + (t % 7) * 100) for s in range(4) for v in range(2) for t in range(101)]
    return spark.createDataFrame(rows, "series_id long, variate int, t long, ts string, c long")


@pytest.mark.parametrize(("lookback", "horizon", "stride", "size"), [(6, 2, 1, None), (6, 2, 5, 7), (20, 9, 3, 16), (13, 1, 2, 1)])
def test_blocks_equal_frames(panel, lookback, horizon, stride, size):
    got = blocks.windows(panel, SPLITS, lookback, horizon, stride, size=size)
    want = win.split_queries(ev.base_windows(panel, lookback, horizon), SPLITS, lookback, horizon, stride)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda df: sorted(map(repr, df.select(*order).collect()))
    assert rows(got) == rows(want) and got.count() > 0


def test_blocks_slice_after_the_stride_only(panel):
    """What is exploded and sliced are kept queries: no array is collected over a frame of rows."""
    plan = blocks.windows(panel, SPLITS, 6, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def plain(w):
    rows = w.orderBy("series_id", "variate", "t").collect()
    return np.array([r.series_id for r in rows]), np.array([r.x for r in rows], float), np.array([r.y for r in rows], float)


def test_tree_sums_equal_numpy(panel, monkeypatch):
    w = blocks.windows(panel, SPLITS[:1], 6, 2)
    ids, x, y = plain(w)
    monkeypatch.setattr(grams, "HELD_BYTES", 100)  # sums are sent on after every key
    got = grams.sums(w.repartition(7).select(F.col("series_id").alias("key"), F.col("x").alias("zx"), F.col("y").alias("zy"), F.lit(2.0).alias("s"))).collect()
    assert len(got) == 4
    for r in got:
        a = 2 * np.c_[x, np.ones(len(x))][ids == r.key]
        xx, xy, (yy, n) = grams.unpacked(np.frombuffer(r.packed), r.lags, 2)
        assert np.allclose(xx, a.T @ a) and np.allclose(xy, a.T @ (2 * y[ids == r.key])) and np.isclose(yy, np.sum(4 * y[ids == r.key] ** 2)) and n == y[ids == r.key].size


def test_products_equal_numpy_and_keep_plans_small(panel):
    w = blocks.windows(panel, SPLITS[:1], 6, 2)
    weights = np.random.default_rng(1).normal(size=(7, 2))
    rows = grams.with_product(w, weights).orderBy("series_id", "variate", "t").collect()
    assert np.allclose([r.pred for r in rows], np.array([r.x for r in rows]) @ weights[:-1] + weights[-1])
    large = grams.with_product(w, np.zeros((505, 168)))
    assert len(large._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert grams.with_product(w.limit(0), weights).count() == 0


def test_users_equal_their_own_least_squares(panel):
    one = panel.filter("variate = 0")
    train, test = blocks.windows(one, SPLITS[:1], 6, 2), blocks.windows(one, SPLITS[2:], 6, 2)
    few = train.filter("series_id < 3")  # one user was never seen
    ids, x, y = plain(few)
    got = lin.predict_users(test, lin.fit_users(few), salts=3)
    assert got.columns == [*test.columns, "pred"]
    rows = got.collect()
    assert len(rows) == test.count()
    own = {i: np.linalg.lstsq(np.c_[x, np.ones(len(x))][ids == i], y[ids == i], rcond=None)[0] for i in range(3)}
    for r in rows:
        if r.series_id == 3:
            assert r.pred is None
        else:
            assert np.allclose(r.pred, np.r_[r.x, 1.0] @ own[r.series_id], atol=1e-6)


def test_a_user_with_fewer_windows_than_lags_has_the_least_norm(spark):
    rows = [(1, [1, 2, 4], [3]), (1, [2, 5, 1], [4])]
    w = lin.fit_users(spark.createDataFrame(rows, "series_id long, x array<long>, y array<long>")).first()
    got = np.frombuffer(w.weights).reshape(4, 1)
    assert np.allclose(np.array([[1, 2, 4, 1], [2, 5, 1, 1]]) @ got, [[3], [4]])


def test_batches_have_their_size(panel):
    w = blocks.windows(panel.filter("variate = 0"), SPLITS[:1], 6, 2)
    got = training.sized_batches(w, 16, 3).groupBy("batch").count().orderBy("batch").collect()
    n = w.count()
    assert [r["count"] for r in got] == [16] * (n // 16) + [n % 16] * (n % 16 > 0) and [r.batch for r in got] == list(range(len(got)))
    g = training.batch_grams(training.sized_batches(w, 16, 3), None)
    assert len(g) == len(got) and [int(x.xx[-1, -1] * 1e4 + 0.5) / 1e4 for x in g] == [r["count"] for r in got]
    again = training.sized_batches(w, 16, 3).select("series_id", "t", "batch").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, training.sized_batches(w.repartition(5), 16, 3).select("series_id", "t", "batch").collect()))


def absolute(x, y, s):
    """Weights of least sum of |s (x w - y)| by many reweighted least squares."""
    a, w = np.c_[x, np.ones(len(x))], None
    for h in range(y.shape[1]):
        b = np.linalg.lstsq(a, y[:, h], rcond=None)[0]
        for k in range(300):
            r = np.sqrt(s / np.maximum(np.abs(a @ b - y[:, h]), 0.5**k * 10 + 1e-7))
            b = np.linalg.lstsq(a * r[:, None], y[:, h] * r, rcond=None)[0]
        w = b[:, None] if w is None else np.c_[w, b]
    return w


@pytest.mark.parametrize("loss", ["mae", "nmae"])
def test_absolute_heads_equal_a_plain_fit(panel, loss):
    w = blocks.windows(panel.filter("variate = 0"), SPLITS[:1], 5, 2)
    _, x, y = plain(w)
    x, y = x / 100, y / 100
    s = 1 / (x.std(1) + 1e-8) if loss == "nmae" else np.ones(len(x))
    value = lambda b: np.mean(np.abs(np.c_[x, np.ones(len(x))] @ b - y) * s[:, None])
    best = value(absolute(x, y, s))
    got, history = training.fit_absolute(w, loss=loss, rounds=25)
    assert value(got) <= 1.01 * best and len(history) > 3
    start = np.linalg.lstsq(np.c_[x, np.ones(len(x))] * s[:, None], y * s[:, None], rcond=None)[0]
    assert value(got) < value(start)


def test_scattered_gradients_equal_differences_and_train(panel):
    w = blocks.windows(panel.filter("variate = 0"), SPLITS[:1], 4, 2, 4)
    batch = training.scattered_batches(w, "instance", "nmae")[0]
    at = np.random.default_rng(0).normal(size=(5, 2))
    for b in (batch, training.Scattered(batch.rows, 0.1)):
        loss, g = b.loss(at), b.gradient(at)
        for i, j in ((0, 0), (3, 1), (4, 0)):
            moved = at.copy()
            moved[i, j] += 1e-6
            assert abs((b.loss(moved) - loss) / 1e-6 - g[i, j]) < 1e-4
    parts = training.scattered_batches(training.sized_batches(w, 20, 1), "instance", "nmae")
    fitted, history = training.fit(parts, 4, training.optimizer("adam", 0.05), {"valid1": [batch]}, valid_every=len(parts))
    assert len(history["train"]) == 4 * len(parts) and batch.loss(fitted) < batch.loss(np.zeros_like(fitted))
    with pytest.raises(ValueError):
        training.error_rows(w, "sigmoid")
