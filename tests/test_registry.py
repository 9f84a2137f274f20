"""The run registry and its file helpers on one URI, and per-user and absolute-loss experiments under it."""

import threading
import time

import numpy as np
import pytest

from tidewheel.plans import experiments as ex
from tidewheel.plans.runs import Registry, write_matrix
from tidewheel.sources import files


@pytest.fixture
def uri(spark, tmp_path):
    return f"file://{tmp_path}/runs"


def test_two_writers_never_share_a_run(spark, uri):
    taken, errors = [], []

    def write(k):
        try:
            reg = Registry(uri, spark=spark)
            for _ in range(4):
                taken.append(reg.allocate("a/6_2", {"writer": k}, [1], policy="new")[0]["run_index"])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(taken) == list(range(8)) and len(Registry(uri).manifests("a/6_2")) == 8


def test_leases(spark, uri):
    path = f"{uri}/.lock"
    with files.lease(spark, path), pytest.raises(TimeoutError), files.lease(spark, path, wait=0.2):
        pass
    assert not files.exists(spark, path)
    files.create(spark, path, "dead")
    time.sleep(1.1)
    with files.lease(spark, path, wait=0.2, stale=1.0):
        assert files.read_text(spark, path) != "dead"
    assert not files.exists(spark, path)
    assert files.create(spark, path, "a") and not files.create(spark, path, "b") and files.read_text(spark, path) == "a"
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, f"{uri}/none")


def test_archive_validate_and_resolve(spark, uri):
    reg = Registry(uri, spark=spark)
    for k in range(3):
        run, _ = reg.allocate("a/6_2", {"k": min(k, 1)}, [1, 2], "one" if k < 2 else "two", policy="new")
        for seed in (1, 2):
            files.write_json(spark, f"{reg.folder('a/6_2', k)}/seed_{seed}/metrics.json", {"v": k})
            reg.complete("a/6_2", k, seed)
    assert reg.validate("a/6_2", 0, ("metrics.json",))["run_index"] == 0
    with pytest.raises(FileNotFoundError):
        reg.validate("a/6_2", 0, ("all_losses",))
    indices = lambda **k: [r["run_index"] for r in reg.resolve("a/6_2", **k)]
    assert indices() == [0, 2] and indices(repeats="distinct") == [0, 1, 2] and indices(config={"k": 1}) == [2] and indices(purposes=("one",)) == [0, 1] and indices(seeds=(3,)) == []
    reg.select("a/6_2", reg.manifest("a/6_2", 1)["signature"], 1)
    assert indices() == [0, 1] and indices(repeats="latest") == [0, 2]
    target = reg.archive("a/6_2", 1)
    assert files.exists(spark, f"{target}/seed_1/metrics.json") and indices() == [0, 2] and reg.selections("a/6_2").keys() == {reg.manifest("a/6_2", 0)["signature"]}
    assert ex.manifests(spark, uri).count() == 2


def test_launches(spark, uri):
    reg = Registry(uri, spark=spark)
    for k in range(2):
        reg.allocate(f"d{k}/6_2", {"k": k}, [1, 2], "night")
        reg.start(f"d{k}/6_2", 0, 1)
    reg.ready("d0/6_2", 0, 1)
    with pytest.raises(ValueError):
        reg.validate("d0/6_2", 0, launch="night")
    reg.ready("d0/6_2", 0, 2)
    assert reg.validate("d0/6_2", 0, launch="night")["run_index"] == 0
    assert reg.complete_launch("night") == [f"{uri}/d0/6_2/run_0"] and reg.interrupt_launch("night") == [f"{uri}/d1/6_2/run_0"]
    files.write_json(spark, f"{uri}/d1/6_2/run_0/seed_1/part.json", 1)
    assert reg.clean("d1/6_2", 0) == ["1"] and not files.exists(spark, f"{uri}/d1/6_2/run_0/seed_1")


def test_a_matrix_is_written_and_read_as_runs(spark, uri):
    rows = [{"family": f, "method": m, "seed": s, "mse": s * 1.5} for f, m in (("constants", "keep"), ("losses", "mse")) for s in (1, 2)]
    runs = write_matrix(Registry(uri, spark=spark), rows, {"epochs": 6})
    assert [r["status"] for r in runs] == ["completed"] * 2 and [r["status"] for r in write_matrix(Registry(uri, spark=spark), rows, {"epochs": 6})] == ["completed"] * 2
    got = ex.read_json_results(spark, uri, "metrics.json").collect()
    assert len(got) == 4 and {r["values"]["method"] for r in got} == {"keep", "mse"} and ex.manifests(spark, uri).filter("status = 'completed'").count() == 2


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(s, 0, t, int(rng.integers(0, 400)) + 300 * s + 50 * (t % 5)) for s in range(3) for t in range(90)]
    return spark.createDataFrame(rows, "series_id long, variate int, t long, c long")


@pytest.mark.parametrize("config", [{"model": "per_user"}, {"model": "linear", "training": {"epochs": 2, "rate": 0.05, "loss": "mae", "batch_size": 40}}, {"model": "linear", "training": {"epochs": 2, "rate": 0.05, "batch_size": 50}}])
def test_experiments_share_one_uri(spark, panel, uri, config):
    base = {"dataset": "small", "lookback": 4, "horizon": 2, "seeds": [1], "loader_artifacts": True}
    out = ex.run_experiment(spark, base | config, panel, uri)
    folder = f"{uri}/small/4_2/run_0/seed_1"
    history, stats = ex.load_history(folder), files.read_json(spark, f"{folder}/stats.json")
    assert out["seeds"][1]["losses_path"] == f"{folder}/all_losses" and spark.read.parquet(f"{folder}/all_losses").filter("mae is null").count() == 0
    assert not files.exists(spark, f"{folder}/all_losses.unchecked") and Registry(uri).validate("small/4_2", 0, ("all_losses", "model_state", "stats.json"))
    windows = {r.split: r.n for r in spark.read.parquet(f"{folder}/all_losses").groupBy("split").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert all(windows[s] == 2 * stats[s]["accessible_windows"] for s in windows) and len(stats["train"]) == 19 and 0 < stats["train"]["alpha"] < 10
    if config["model"] == "linear":
        size = config["training"]["batch_size"]
        assert len(history["train"]) == 2 * -(-stats["train"]["accessible_windows"] // size)
    again = ex.run_experiment(spark, base | config | {"skip_training": True, "loader_artifacts": False, "pretrained": f"{folder}/model_state"}, panel, uri)
    assert again["seeds"][1]["state_path"] == f"{folder}/model_state"
