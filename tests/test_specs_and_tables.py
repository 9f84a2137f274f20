"""Subset and cluster specifications, rendered tables and table data."""

import json

import pytest

from tidewheel.operators import blocks, report
from tidewheel.operators import sampling as smp
from tidewheel.operators import windows as win
from tidewheel.sources import config


def test_subsets(tmp_path):
    path = tmp_path / "subsets.json"
    config.save_subset(path, "train", "dates", [4, 2], 3, 5, 10)
    config.save_subset(path, "test1", "all", [49], 1, 5, 10, metadata={"seed": 1})
    got = config.load_subset(path, "train", 5, 10)
    assert (got["mode"], got["indices"], got["stride"], got["metadata"]["creation_mode"]) == ("dates", [4, 2], 3, "precomputed")
    assert config.load_subset(path, "test1", 5, 10)["metadata"] == {"seed": 1}
    for series, dates in ((4, 10), (5, 11)):
        with pytest.raises(ValueError):
            config.load_subset(path, "train", series, dates)
    with pytest.raises(KeyError):
        config.load_subset(path, "valid1", 5, 10)
    content = json.loads(path.read_text())
    del content["groups"]["default"]["train"]["date_anchor"]
    content["groups"]["default"]["test1"]["indices"] = [50]
    path.write_text(json.dumps(content))
    for split in ("train", "test1"):
        with pytest.raises(ValueError):
            config.load_subset(path, split, 5, 10)
    with pytest.raises(ValueError):
        config.save_subset(path, "train", "weeks", [], 1, 5, 10)


def test_clusters_are_drawn_saved_and_read(spark, tmp_path):
    series, path = spark.range(7).withColumnRenamed("id", "series_id"), str(tmp_path / "c.json")
    made = smp.create_iid_clusters(series, path, "g", 3, ratios=[0.5, 0.3, 0.2])
    assert [len(made[k]) for k in range(3)] == [4, 2, 1] and sorted(sum(made.values(), [])) == list(range(7))
    assert config.load_clusters(path, "g", 7) == {s: k for k, v in made.items() for s in v}
    assert json.loads((tmp_path / "c.json").read_text())["metadata"]["g"] == {"creation_mode": "generated", "access_mode": "created", "randomized": True, "method": "ratios", "seed": 3, "ratios": [0.5, 0.3, 0.2]}
    assert [len(v) for _, v in sorted(smp.create_iid_clusters(series, path, "n", 3, clusters=3).items())] == [3, 2, 2]
    for how in ({}, {"clusters": 2, "sizes": [3, 4]}, {"sizes": [3, 3]}, {"ratios": [0.5, 0.4]}):
        with pytest.raises(ValueError):
            smp.create_iid_clusters(series, path, **how)


def test_html():
    cells = [{"dataset": "a<b", "method": "m1", "mean": 1.25, "dev": 0.5, "best": True}, {"dataset": "a<b", "method": "m2", "mean": 2.0, "dev": None, "best": False}, {"dataset": "c", "method": "m1", "mean": None, "dev": None}]
    got = report.render_html(cells, ["dataset"], ["m1", "m2"], 2, "x & y")
    assert got == "<table><caption>x &amp; y</caption><thead><tr><th>dataset</th><th>m1</th><th>m2</th></tr></thead><tbody><tr><td>a&lt;b</td><td><b>1.25 ± 0.50</b></td><td>2.00</td></tr><tr><td>c</td><td>--</td><td>--</td></tr></tbody></table>"


def test_family_tables(spark):
    rows = spark.createDataFrame([("f", "a", 1, 2.0, 1.0), ("f", "a", 2, 4.0, float("nan")), ("f", "b", 1, 1.0, 5.0), ("g", "a", 1, float("inf"), 1.0)], "family string, method string, seed int, mse double, mae double")
    got = {(r.family, r.method, r.metric): (r.seeds, r["mean"], r.dev, r.best) for r in report.family_tables(rows, ["mse", "mae"]).collect()}
    assert got["f", "a", "mse"] == (2, 3.0, pytest.approx(2**0.5), False) and got["f", "b", "mse"] == (1, 1.0, None, True)
    assert got["f", "a", "mae"] == (2, 1.0, None, True) and got["g", "a", "mse"] == (1, None, None, False)


@pytest.mark.parametrize("size", [None, 9])
def test_windows_of_which_any_variate_varies(spark, size):
    rows = [(s, v, t, (t // 10 * 7 if s == 0 and v == 1 else t % 3 if s == 1 else 5)) for s in range(3) for v in range(2) for t in range(60)]
    panel = spark.createDataFrame(rows, "series_id long, variate int, t long, c long")
    splits = [("train", 0, 40), ("test1", 40, 60)]
    every = blocks.windows(panel, splits, 5, 2, 2)
    want = win.not_constant(every, ["split", "series_id", "t"])
    got = blocks.varying_windows(panel, splits, 5, 2, 2, size)
    order = sorted(want.columns)
    assert sorted(map(repr, got.select(*order).collect())) == sorted(map(repr, want.select(*order).collect())) and 0 < got.count() < every.count()
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # and AQE's header
