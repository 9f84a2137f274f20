"""Kept windows in small blocks, and heads that are fitted from them, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import blocks, gates, grams, training
from tidewheel.operators import evaluate as ev
from tidewheel.operators import linear as lin
from tidewheel.plans import training_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = [(s, 0, t, int(500 * s + 90 * np.sin(t / 2) + rng.normal() * 40 * (s + 1))) for s in range(4) for t in range(500)]
    panel = spark.createDataFrame(rows, "series_id long, variate int, t long, c long")
    return blocks.windows(panel, [("train", 0, 500)], 6, 2).filter("mx > mn").select("series_id", "t", "n", "s1", "s2", "x", "y").localCheckpoint()


def test_spark_reads_thousands_of_blocks_in_little_memory(windows):
    rows = windows.select((F.col("series_id") % 2).alias("key"), "x", "y", F.col("t").cast("double").alias("t"), F.col("series_id").alias("own")).coalesce(1)
    kept = grams.window_blocks(rows)
    most = kept.agg(F.max(F.length("packed"))).first()[0]
    assert most * 10_000 <= 128 << 20  # rows of a batch for a Python worker; a file's batch has 4096
    got = []
    for b in kept.toArrow().to_batches():
        for key, x, y, (t, own) in grams.windows_of(b):
            got += [(key, int(i), int(at), list(u), list(v)) for i, at, u, v in zip(own, t, x, y, strict=True)]
    assert sorted(got) == sorted((r.key, r.own, int(r.t), [float(v) for v in r.x], [float(v) for v in r.y]) for r in rows.collect())


def test_windows_wider_than_a_block_and_slices_of_few_windows(windows, monkeypatch):
    wide = windows.limit(40).select(F.lit(7).alias("key"), F.flatten(F.array_repeat("x", 400)).alias("x"), "y", F.col("t").cast("double").alias("t"))
    table = grams.window_blocks(wide).toArrow()
    assert table.column("n").to_pylist() == [1] * 40 and grams.window_blocks(wide.limit(0)).count() == 0
    whole = [part for b in table.to_batches() for part in grams.windows_of(b)]
    monkeypatch.setattr(grams, "SLICE_NUMBERS", 5000)
    few = [part for b in table.combine_chunks().to_batches() for part in grams.windows_of(b)]
    assert len(few) == 20 and all(np.array_equal(np.vstack([p[i] for p in whole]), np.vstack([p[i] for p in few])) for i in (1, 2))


def test_heads_of_all_losses_come_from_windows_that_are_cut_once(windows, monkeypatch):
    stashed = []
    monkeypatch.setattr(training, "stash", lambda df, keep=training.stash: stashed.append(1) or keep(df))
    heads = training.fit_heads(windows, ("mse", "nmse", "mae", "nmae", "relative_mse"), "instance", floor=1e-4)
    assert len(stashed) == 1
    for loss in training.LOSSES:
        g = training.batch_grams(windows, 1, 0, "instance", loss, floor=1e-4)[0]
        assert np.allclose(heads[loss][0], lin.solve(g.xx, g.xy), atol=1e-6) and g.loss(heads[loss][0]) == pytest.approx(g.loss(lin.solve(g.xx, g.xy)))
    for loss in training.ABSOLUTE:
        batch = training.scattered_batches(windows, "instance", loss, floor=1e-4)[0]
        assert batch.loss(heads[loss][0]) < batch.loss(heads[training.ABSOLUTE[loss]][0])
    with pytest.raises(ValueError):
        training.fit_heads(windows.limit(0), ("mse", "mae"))


def test_second_derivatives_equal_differences(windows):
    batch = training.scattered_batches(windows, "instance", "nmae")[0]
    smooth, at = training.Scattered(batch.rows, 0.2), np.random.default_rng(1).normal(size=(7, 2))
    loss, g, second = smooth.curved(at)
    assert loss.mean() == pytest.approx(smooth.loss(at)) and np.allclose(g / 2, smooth.gradient(at))
    for i in range(7):
        moved = at.copy()
        moved[i] += 1e-6
        assert np.allclose((smooth.curved(moved)[1] - g) / 1e-6, second[:, i].T, atol=1e-4)


def test_newton_steps_reach_what_gradients_reach(windows):
    batch = training.scattered_batches(windows, "instance", "nmae")[0]
    for share in (0.3, 0.003):
        smooth = training.Scattered(batch.rows, share)
        w, history = training.settled(smooth, np.zeros((7, 2)))
        slow, falls = training.minimized(smooth, np.zeros((7, 2)), None, tolerance=1e-9)
        assert all(b <= a for a, b in zip(history, history[1:], strict=False)) and history[-1] <= falls[-1] * (1 + 1e-5)
        assert smooth.loss(w) == pytest.approx(history[-1]) and np.abs(smooth.gradient(w)).max() < 1e-3


def test_gates_of_all_presets_come_from_windows_that_are_kept_once(windows, monkeypatch):
    own = windows.withColumn("cluster_id", F.expr("case when series_id < 2 then null else series_id end"))
    rows = gates.kept_rows(own, "cluster_id")
    want = gates.fit_gated(windows, "grevin", rounds=2), gates.fit_gated_clusters(own, "previn", rounds=2)
    monkeypatch.setattr(gates, "stash", None)  # nothing is written again, nor thrown away
    w, params, history = gates.fit_gated(rows, "grevin", rounds=2)
    assert np.allclose(w, want[0][0]) and params == pytest.approx(want[0][1]) and history == pytest.approx(want[0][2])
    w, shared, params, history = gates.fit_gated_clusters(rows, "previn", rounds=2)
    assert np.allclose(w, want[1][0]) and shared == pytest.approx(want[1][1]) and params.keys() == want[1][2].keys() == {2, 3} and history == pytest.approx(want[1][3])

    # errors of kept rows are those of the forecasts
    got = gates.mean_errors(rows, w, "previn", shared, params)
    done = gates.predict_gated(own, w, "previn", shared, params).collect()
    for key in (gates.SHARED, 2, 3):
        e = np.array([np.subtract(r.pred, r.y) / 100 for r in done if (r.cluster_id if r.cluster_id is not None else gates.SHARED) == key])
        assert got[key] == (pytest.approx(np.mean(e * e)), e.size)
    assert gates.mean_errors(rows.limit(0), w, "previn", shared) == {}


def test_the_query_trains_its_heads_to_the_end(spark, monkeypatch):
    seen = {}

    def spy(train, losses, normalization, **options):
        rows = training.normalized_windows(train, normalization).select("zx", "zy", "n", "s1", "s2").collect()
        seen["data"], seen["heads"] = rows, whole(train, losses, normalization, **options)
        return seen["heads"]

    whole = training.fit_heads
    monkeypatch.setattr(training, "fit_heads", spy)
    got = {r.trained_on: r for r in training_queries.trained_losses(spark, DATA).collect()}
    x, y = (np.array([r[c] for r in seen["data"]]) for c in ("zx", "zy"))
    n, s1, s2 = (np.array([r[c] for r in seen["data"]], float) for c in ("n", "s1", "s2"))
    x, deviation = np.c_[x, np.ones(len(x))], np.sqrt(n * s2 - s1 * s1) / n / 100
    for loss in training.ABSOLUTE:
        s = deviation + 1e-8 if loss == "mae" else (deviation + 1e-8) / np.maximum(deviation, 1e-4)
        value = lambda w: np.mean(np.abs(x @ w - y) * s[:, None])  # noqa: B023, E731
        least = np.linalg.lstsq(x * s[:, None], y * s[:, None], rcond=None)[0]
        for k in range(150):  # reweighted least squares, each step of the horizon for itself
            r = np.sqrt(s[:, None] / np.maximum(np.abs(x @ least - y), 0.8**k + 1e-6))
            least = np.column_stack([np.linalg.lstsq(x * r[:, [h]], y[:, h] * r[:, h], rcond=None)[0] for h in range(y.shape[1])])
        print(loss, value(seen["heads"][loss][0]), value(least))
        assert value(seen["heads"][loss][0]) <= value(least) * 1.0005
    assert set(got) == set(ev.LOSSES) and got["mse"].mse == min(r.mse for r in got.values())
