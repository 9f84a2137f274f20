"""Training, experiments and their registry, on small panels with results worked out by hand or by plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import evaluate as ev
from tidewheel.operators import training
from tidewheel.operators import windows as win
from tidewheel.plans import experiments as ex
from tidewheel.plans.runs import Registry


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, 0, t, 100 * s + 37 * t % 90 + (11 * s * t) % 50) for s in range(4) for t in range(80)]
    return spark.createDataFrame(rows, "series_id long, variate int, t long, c long")


def plain(windows):
    rows = windows.orderBy("series_id", "t").collect()
    return np.array([r.x for r in rows], float) / 100, np.array([r.y for r in rows], float) / 100


CONFIG = {"dataset": "small", "lookback": 6, "horizon": 2, "model": "linear", "training": {"epochs": 3, "rate": 0.01, "batches": 4}}


@pytest.mark.parametrize("loss", training.LOSSES)
def test_gram_losses_and_gradients_equal_those_of_all_windows(spark, panel, loss):
    w = ex.splits_of(panel, CONFIG)["train"]
    grams = training.batch_grams(w, 4, 1, "identity", loss, floor=1e-4)
    whole = sum(grams[1:], grams[0])
    x, y = plain(w)
    a = np.c_[x, np.ones(len(x))]
    scale = {"mse": np.ones(len(x)), "nmse": np.maximum(x.std(1), 1e-4), "relative_mse": np.maximum(abs(x.mean(1)), 1e-4)}[loss]
    weights = np.linspace(-0.3, 0.4, a.shape[1] * 2).reshape(-1, 2)
    error = (a @ weights - y) / scale[:, None]
    assert len(grams) == 4 and whole.loss(weights) == pytest.approx(np.mean(error**2), rel=1e-6)
    assert np.allclose(whole.gradient(weights), 2 * a.T @ (error / scale[:, None]) / error.size)


def test_losses_of_an_instance_normalization_are_those_in_units(spark, panel):
    w = ex.splits_of(panel, CONFIG)["train"]
    g = training.batch_grams(w, 1, 0, "instance", "mse")[0]
    weights = np.zeros((7, 2))
    x, y = plain(w)
    assert g.loss(weights) == pytest.approx(np.mean((x.mean(1)[:, None] - y) ** 2), rel=1e-5)
    got = training.predict(w, weights, "instance").select("pred", (F.col("s1") / F.col("n")).alias("m")).collect()
    assert all(abs(v - r.m) < 1e-5 for r in got for v in r.pred)
    with pytest.raises(ValueError):
        training.batch_grams(w, 1, 0, "sigmoid", "mse")
    with pytest.raises(ValueError):
        training.batch_grams(w, 1, 0, "identity", "mae")


def test_optimizers_by_hand():
    w, g = np.array([1.0]), np.array([0.5])
    assert training.optimizer("sgd", 0.1)(w, g, 1) == pytest.approx(0.95)
    momentum = training.optimizer("sgd", 0.1, momentum=0.9)
    assert momentum(momentum(w, g, 1), g, 2) == pytest.approx(0.95 - 0.1 * 0.95)
    assert training.optimizer("adam", 0.1)(w, g, 1) == pytest.approx(0.9)
    assert training.optimizer("adamw", 0.1)(w, g, 1) == pytest.approx(0.999 - 0.1)
    assert training.optimizer("rmsprop", 0.1)(w, g, 1) == pytest.approx(1 - 0.1 * 0.5 / (0.05 + 1e-8))
    assert training.optimizer(lambda: lambda w, g, t: w - t)(w, g, 2) == pytest.approx(-1)
    with pytest.raises(ValueError):
        training.optimizer("lion")


def batches(n=3):
    rng = np.random.default_rng(0)
    out = []
    for _ in range(n):
        a, y = np.c_[rng.normal(size=(20, 2)), np.ones(20)], rng.normal(size=(20, 1))
        out.append(training.Grams(a.T @ a, a.T @ y, float(np.sum(y * y)), 20.0))
    return out


def test_history_follows_its_intervals():
    step = lambda: training.optimizer("sgd", 0.05)
    _, h = training.fit(batches(), 3, step(), {"valid1": batches(1)}, valid_every=2, log_every=4)
    assert len(h["train"]) == 9 and [r["step"] for r in h["train_batch"]] == [2, 4, 6, 8, 9] and h["log"] == [4, 8]
    assert [r["step"] for r in h["valid"]["valid1"]] == [2, 4, 6, 8, 9]
    assert h["train_batch"][0]["loss"] == pytest.approx(sum(h["train"][:2]) / 2)
    with pytest.raises(ValueError):
        training.fit(batches(), 1, step(), valid_every=2, log_every=3)
    start = np.ones((3, 1))
    w, h = training.fit(batches(), 0, step(), start=start)
    assert (w == start).all() and h["train"] == [] and h["skipped"] == "epochs <= 0"
    assert (training.fit(batches(), 2, step(), seed=5)[0] == training.fit(batches(), 2, step(), seed=5)[0]).all()
    assert (training.fit(batches(), 2, step(), schedule=lambda t: 0.0)[0] == 0).all()


def test_state_round_trip(spark, tmp_path):
    w = np.arange(14, dtype=float).reshape(7, 2) / 3
    training.save_state(spark, w, str(tmp_path / "state"))
    assert (training.load_state(spark, str(tmp_path / "state")) == w).all()


def test_experiment_from_training_to_results(spark, panel, tmp_path):
    root = tmp_path / "runs"
    out = ex.run_experiment(spark, CONFIG | {"seeds": [1, 2], "loader_artifacts": True}, panel, root)
    assert out["action"] == "new" and set(out["seeds"]) == {1, 2}
    folder = root / "small/6_2/run_0/seed_1"
    history = ex.load_history(folder)
    assert len(history["train"]) == 12 and list(history["valid"]) == ["valid1"] and json.loads((folder / "metadata.json").read_text())["windows"]["train"] > 0
    assert ex.run_experiment(spark, CONFIG | {"seeds": [1, 2]}, panel, root)["action"] == "new"  # other settings, another run
    again = ex.run_experiment(spark, CONFIG | {"seeds": [1, 2], "loader_artifacts": True}, panel, root)
    assert again["action"] == "skip" and again["seeds"] == {}
    runs = ex.manifests(spark, str(root))
    assert runs.count() == 2
    rows = ex.results(spark, str(root), runs.filter("run_index = 0").withColumn("label", F.lit("one"))).collect()
    got = {(r.split, r.seed, r.metric): r.value for r in rows}
    assert {(r.dataset, r.setting, r.label) for r in rows} == {("small", "6_2", "one")}
    losses = spark.read.parquet(f"{folder}/all_losses").filter("split = 'test1'").toPandas()
    users = losses.groupby("series_id")["mse"].mean()
    assert got["test1", 1, "mse"] == pytest.approx(losses["mse"].mean()) and got["test1", 1, "w10_mse"] == pytest.approx(users.max()) and got["test1", 1, "user_mse"] == pytest.approx(users.mean())
    assert ("train", 1, "mse") not in got
    # a saved state is evaluated without training
    state = f"{folder}/model_state"
    later = ex.run_experiment(spark, CONFIG | {"seed": 1, "pretrained": state}, panel, root)["seeds"][1]
    assert "history" not in later and later["state_path"] == state
    assert spark.read.parquet(later["losses_path"]).filter("split = 'test1'").agg(F.avg("mse")).first()[0] == pytest.approx(losses["mse"].mean())
    rule = ex.run_experiment(spark, CONFIG | {"model": "persistence", "evaluate": False}, panel, root)["seeds"][0]
    assert rule["history"]["skipped"] == "no trainable parameters" and "losses_path" not in rule


def test_an_experiment_that_fails_is_interrupted_and_resumed(spark, panel, tmp_path):
    config = CONFIG | {"normalization": "sigmoid"}
    with pytest.raises(ValueError):
        ex.run_experiment(spark, config, panel, tmp_path)
    assert Registry(tmp_path).manifests("small/6_2")[0]["status"] == "interrupted"


def test_misaligned_losses_fail(spark):
    good = [(1, 5, 1, 0.5), (1, 5, 2, 0.5)]
    schema = "series_id long, t long, step int, mse double"
    assert ex.check_alignment(spark.createDataFrame(good, schema), 2).count() == 2
    for bad in (good[:1], [*good, (1, 5, 2, 0.1)], [(None, 5, 1, 0.1), (None, 5, 2, 0.1)]):
        with pytest.raises(ValueError):
            ex.check_alignment(spark.createDataFrame(bad, schema), 2)


def test_missing_loss_table_fails(spark, tmp_path):
    reg = Registry(tmp_path)
    reg.allocate("d/6_2", {"dataset": "d", "lookback": 6, "horizon": 2}, [1])
    reg.complete("d/6_2", 0, 1)
    with pytest.raises(FileNotFoundError):
        ex.results(spark, str(tmp_path), ex.manifests(spark, str(tmp_path)).withColumn("label", F.lit("x")))


def test_selections_are_automatic_until_pinned(tmp_path):
    reg = Registry(tmp_path)
    for _ in range(3):
        run, _ = reg.allocate("a", {"k": 1}, [1], policy="new")
        reg.complete("a", run["run_index"], 1)
    mark = run["signature"]
    assert reg.selected("a", mark)["run_index"] == 2
    reg.select("a", mark, 0)
    run, _ = reg.allocate("a", {"k": 1}, [1], policy="new")
    with pytest.raises(ValueError):
        reg.select("a", mark, run["run_index"])
    reg.complete("a", run["run_index"], 1)
    assert reg.selected("a", mark)["run_index"] == 0 and reg.selected("a", "other") is None
    ex.write_report(tmp_path / "report.json", [reg.selected("a", mark) | {"label": "L"}], "latest", "selected", {"k": 1})
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["obtained"]["count"] == 1 and report["obtained"]["inputs"][0]["label"] == "L" and report["requested"]["filters"] == {"k": 1}


def test_signature_follows_the_upstream_run():
    up = {"identity": "a", "signature": "s1", "config": {}, "status": "completed"}
    assert ex.with_upstream({"k": 1}, {"base": up}) != ex.with_upstream({"k": 1}, {"base": up | {"signature": "s2"}})
    with pytest.raises(ValueError):
        ex.with_upstream({}, {"base": up | {"status": "running"}})


def test_clusters_have_their_own_options(spark, panel):
    two = panel.withColumn("cluster_id", (F.col("series_id") % 2).cast("int"))
    got = ex.splits_of(two, CONFIG | {"clusters": {1: {"stride": 4}}})["test1"].groupBy("cluster_id").count().collect()
    n = {r.cluster_id: r["count"] for r in got}
    assert n[0] == 2 * 15 and n[1] == 2 * 4


def test_result_files_are_collected(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/my_results.json").write_text('{"mse": 1.5}')
    (tmp_path / "b_summary.json").write_text("{broken")
    (tmp_path / "c.json").write_text("{}")
    rows = {r.path.rsplit("/", 1)[1]: r for r in ex.read_json_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"my_results.json", "b_summary.json"} and float(rows["my_results.json"]["values"]["mse"]) == 1.5 and rows["b_summary.json"].error


def test_floored_scales(spark):
    rows = spark.createDataFrame([(500.0, 400.0, 4, 800, 160000)], "y double, pred double, n long, s1 long, s2 long")
    r = ev.floored_losses(rows, 1e-4).first()
    assert r.mse == pytest.approx(1) and r.nmse == pytest.approx(1e8) and r.nmae == pytest.approx(1e4) and r.relative_mse == pytest.approx(0.25)
    assert win.EPS < 1e-4


def test_decomposed_heads_equal_training_on_residual_and_trend(spark, panel):
    w = ex.splits_of(panel, CONFIG)["train"]
    x, y = plain(w)
    padded = np.pad(x, ((0, 0), (1, 1)), mode="edge")
    trend = sum(padded[:, i : i + 6] for i in range(3)) / 3
    one = np.ones((len(x), 1))
    design = np.hstack([x - trend, one, trend, one])
    v = np.repeat(np.r_[np.full(6, 1 / 6), 0, np.full(6, 1 / 6), 0][:, None], 2, 1)
    assert np.allclose(design @ v, x.mean(1, keepdims=True))
    for _ in range(5):
        v = v - 0.01 * 2 * design.T @ (design @ v - y) / y.size
    weights, history = training.fit_two_heads(training.batch_grams(w, 1), 5, training.optimizer("sgd", 0.01), kernel=3)
    assert np.allclose(np.c_[x, one] @ weights, design @ v) and len(history["train"]) == 5


def test_decomposed_model_in_an_experiment_starts_at_the_mean(spark, panel, tmp_path):
    config = CONFIG | {"model": "decomposed", "training": {"epochs": 0}}
    splits = ex.splits_of(panel, config)
    state = ex.train_stage(spark, config, splits, str(tmp_path))
    row = ex.predictions(config, splits["test1"], state["weights"]).first()
    assert row.pred == pytest.approx([np.mean(row.x)] * 2) and "skipped" in state["history"]


def test_loose_discovery_keeps_broken_files_as_rows(spark, tmp_path):
    rows = spark.createDataFrame([("test1", 0, 0, 1, 2.0, 1.0), ("test1", 1, 0, 1, 4.0, 3.0)], "split string, series_id long, t long, step long, mse double, mae double")
    rows.repartition(2).write.parquet(f"{tmp_path}/d/24_6/m/all_losses")
    broken = tmp_path / "d/24_6/bad"
    broken.mkdir()
    (broken / "all_losses.parquet").write_text("no table")
    (tmp_path / "d/other.parquet").write_text("not a loss table")
    found = {(r.dataset, r.setting, r.model, r.split, r.metric): r.value for r in ex.discovered(spark, str(tmp_path)).collect()}
    assert found == {("d", "24_6", "m", "test1", "mse"): 3.0, ("d", "24_6", "m", "test1", "mae"): 2.0, ("d", "24_6", "bad", "<load_error>", "unreadable"): None}
