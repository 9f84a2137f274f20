"""Small panels with results worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import arrays as arr
from tidewheel.operators import evaluate as ev
from tidewheel.operators import linear as lin
from tidewheel.operators import models, sampling
from tidewheel.operators import normalize as nrm
from tidewheel.operators import windows as win
from tidewheel.plans.runs import Registry, seeded
from tidewheel.sources import config, store, wide_csv
from tidewheel.sources import panels as src


def panel(spark, series, length, value):
    return spark.createDataFrame([(s, 0, t, value(s, t)) for s in range(series) for t in range(length)], "series_id long, variate int, t long, c long")


def test_query_dates_and_windows(spark):
    p = panel(spark, 3, 60, lambda s, t: 60 * s + t)
    spans = win.split_ranges(60, [0.6, 0.2, 0.2])
    for lookback in (4, 2):
        w = win.with_future(win.with_past(p, lookback), 2)
        q = win.split_queries(w, [s for s in spans if s[0] == "valid1"], lookback, 2, 2).filter("series_id = 0").orderBy("t").collect()
        assert [r.t for r in q] == [35, 37, 39, 41, 43, 45]
        assert q[0].x == list(range(36 - lookback, 36)) and q[0].y == [36, 37]


def test_date_blocks():
    assert win.date_blocks(60, [0.6, 0.2, 0.2]) == [(0, 36), (36, 48), (48, 60)]
    assert [n for n, *_ in win.split_ranges(10, [1.0])] == ["test1"]
    for bad in ([0.5, 0.4], [0.2] * 5, [1.5, -0.5]):
        with pytest.raises(ValueError):
            win.date_blocks(60, bad)
    with pytest.raises(ValueError):
        win.date_blocks(2, [0.4, 0.3, 0.3])


def test_one_constant_variate_keeps_the_window_and_drops_the_series(spark):
    rows = [(0, v, t, 5 if v else t) for v in (0, 1) for t in range(10)]
    p = win.with_moments(spark.createDataFrame(rows, "series_id long, variate int, t long, c long"), 4).filter("t >= 3")
    assert win.not_constant(p, ["series_id", "t"]).count() == 14
    assert win.drop_constant_series(p, p).count() == 0


def test_stride_counts_admissible_dates(spark):
    p = panel(spark, 1, 40, lambda s, t: t)
    owned = spark.createDataFrame([(t,) for t in range(40) if not 20 <= t < 25], "t long")
    got = [r.t for r in win.owned_queries(p, owned, 4, 2, 3).orderBy("t").collect()]
    every = [t for t in range(3, 38) if all(not 20 <= x < 25 for x in (t + 1, t + 2))]
    assert got == every[::3]


def test_summary_of_merged_losses(spark):
    rows = spark.createDataFrame([(11, 1.0)] * 3 + [(29, 9.0)], "series_id long, mse double")
    r = ev.summaries(rows, "mse").first()
    assert (r.mse, r.std_mse, r.user_mse, r.std_user_mse, r.w10_mse) == (3.0, round(math.sqrt(12), 4), 5.0, 4.0, 9.0)


@pytest.mark.parametrize(("users", "tail"), [(1, 1), (9, 1), (10, 1), (11, 2)])
def test_worst_tenth(spark, users, tail):
    rows = spark.createDataFrame([(u, float(u)) for u in range(users)], "series_id long, mse double")
    assert ev.summaries(rows, "mse").first().w10_mse == np.mean(range(users - tail, users))


def test_resampling_of_an_empty_bin(spark):
    rows = spark.sql("select 1L series_id, 0 variate, timestamp'2020-01-01 01:00' ts, 3L c union all select 1, 0, timestamp'2020-01-01 02:00', 5 union all select 1, 0, timestamp'2020-01-03 00:00', 7")
    grid = src.date_grid(rows, "day")
    expected = {"sum": [8, 0, 7], "mean": [4.0, 0.0, 7.0], "first": [3, 0, 7], "last": [5, 0, 7]}
    for how, values in expected.items():
        assert [r.c for r in src.densify(src.resample(rows, "day", how), grid).orderBy("t").collect()] == values
    assert [r.c for r in src.asfreq(rows, grid).orderBy("t").collect()] == [0, 0, 7]
    with pytest.raises(Exception, match="missing value"):
        src.densify(src.resample(rows, "day"), grid, "error").collect()


def test_largest_remainder():
    assert sampling.largest_remainder(7, [0.5, 0.3, 0.2]) == [4, 2, 1]


def test_arrays(spark):
    one = spark.createDataFrame([([1.0, 2.0, 6.0],)], "x array<double>")
    assert one.select(arr.moving_average(F.col("x"), 3).alias("y")).first().y == pytest.approx([4 / 3, 3.0, 14 / 3])
    long = spark.createDataFrame([([float(i) for i in range(24)],)], "x array<double>")
    p = long.select(arr.patches(F.col("x")).alias("p")).first().p
    assert len(p) == 3 and p[2] == [float(min(i, 23)) for i in range(16, 32)]
    with pytest.raises(Exception, match="no such covariate"):
        one.select(arr.kind(F.col("x"), 24, 6)).collect()


def test_identity_gates_round_trip(spark):
    p = win.with_moments(panel(spark, 1, 30, lambda s, t: 100 * (t * t % 17)), 6).filter("t >= 5 and mx > mn")
    forward, inverse = nrm.gated(**nrm.PRESETS["in"])
    x = F.col("c") / 100
    r = p.select(x.alias("x"), forward(x).alias("z"), inverse(forward(x)).alias("back"), nrm.INSTANCE[0](x).alias("i")).collect()
    assert all(abs(v.x - v.back) < 1e-9 and abs(v.z - v.i) < 1e-6 for v in r)


def test_a_ramp_is_predicted_exactly(spark):
    p = panel(spark, 2, 50, lambda s, t: 50 * s + t)
    w = win.split_queries(ev.base_windows(p, 6, 2), win.split_ranges(50, [0.6, 0.2, 0.2]), 6, 2)
    got = lin.predict_linear(w.filter("split = 'test1'"), lin.fit_linear(w.filter("split = 'train'"))).collect()
    assert got and all(np.allclose(r.pred, r.y, atol=1e-6) for r in got)
    same = models.model("persistence")(w, w.filter("split = 'test1'"), 6, 2).first()
    assert same.pred == [float(same.c)] * 2
    with pytest.raises(LookupError):
        models.model("patchtst")


def test_wide_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,a,b,c,weather\n2020-01-01,1,2,x,7\n2020-01-02,,4,5,8\n")
    got, extra = wide_csv.read_wide(spark, str(tmp_path / "a.csv"), drop="b", context=["weather"])
    assert {(r.series_id, r.t, r.value) for r in got.collect()} == {(0, 0, 1.0), (0, 1, 0.0), (2, 0, 0.0), (2, 1, 5.0)}
    assert {(r.name, r.t, r.value) for r in extra.collect()} == {("weather", 0, 7.0), ("weather", 1, 8.0)}
    with pytest.raises(Exception, match="missing value"):
        wide_csv.read_wide(spark, str(tmp_path / "a.csv"), missing="error")[0].collect()
    (tmp_path / "b.csv").write_text("date,a\n2020-01-01,inf\n")
    with pytest.raises(Exception, match="infinite"):
        wide_csv.read_wide(spark, str(tmp_path / "b.csv"))[0].collect()
    with pytest.raises(ValueError, match="no such series"):
        wide_csv.resolve_drops(["a"], [3])
    assert wide_csv.timestamp_column(["x", " Date "]) == " Date "


def test_configuration(tmp_path):
    values, origin = config.merge({"drop": [1], "date_col": "d"}, {"drop": [2]}, {"drop": [3], "date_col": "run_date"})
    assert values == {"drop": [3], "date_col": "run_date"} and origin["drop"] == "run"
    assert config.merge({"drop": [1]}, {"drop": None}, {})[0] == {"drop": [1]} and config.merge({"drop": [1]}, {}, {"drop": []})[0] == {"drop": []}
    assert config.signature({"a": 1, "b": 2}) == config.signature({"b": 2, "a": 1}) != config.signature({"a": 1, "b": 3})
    assert config.flatten({"a": {"b": 1, "c": {"d": 2}}}) == {"a.b": 1, "a.c.d": 2}
    assert config.simple_yaml("a: 1\nb:\n  c: [1, x]\n  d: true\n") == {"a": 1, "b": {"c": [1, "x"], "d": True}}
    config.save_specs(tmp_path / "s.json", "g", {"a": {"series": [0], "lo": 0, "hi": 5}, "b": {"series": [0], "lo": 4, "hi": 6}})
    with pytest.raises(ValueError, match="overlap"):
        config.load_specs(tmp_path / "s.json", "g", 2, 10)
    assert config.sampling_for("test1", {"train_mode": 1, "eval_mode": 2}) == {"mode": 2}


def test_prepared_panels_are_reused_and_mended(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.prepared(spark, str(tmp_path), {"a": 1}, build).count() == 3
    assert len(built) == 1
    manifest = next(tmp_path.glob("*/manifest.json"))
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"rows": 9}))
    assert store.prepared(spark, str(tmp_path), {"a": 1}, build).count() == 3 and len(built) == 2
    store.prepared(spark, str(tmp_path), {"a": 2}, build)
    assert len(built) == 3


def test_registry(tmp_path):
    r = Registry(tmp_path)
    run, action = r.allocate("d/m", {"steps": 10}, [1, 2])
    assert action == "new" and r.pending("d/m", 0) == [1, 2]
    r.start("d/m", 0, 1)
    assert r.complete("d/m", 0, 1)["status"] == "running" and r.interrupt("d/m", 0)["status"] == "running"
    assert r.allocate("d/m", {"steps": 10}, [1])[1] == "skip" and r.allocate("d/m", {"steps": 10}, [1, 2])[1] == "resume"
    assert r.complete("d/m", 0, 2)["status"] == "completed" and r.single("d/m")["run_index"] == 0
    assert r.allocate("d/m", {"steps": 20}, [1])[0]["run_index"] == 1 and r.allocate("d/m", {"steps": 20}, [1], policy="new")[0]["run_index"] == 2
    with pytest.raises(ValueError):
        r.allocate("d/m", {}, [1], policy="none")
    assert [c["rebuild"] for c in seeded({"rebuild": True}, [1, 2])] == [True, False]


def test_stream_equals_batch(spark, tmp_path):
    from tidewheel.streaming.resample import event_stream, write_hourly

    rows = spark.sql("select id event_id, timestamp'2020-01-01 00:10' + make_interval(0,0,0,0,cast(id div 2 as int)) ts, id % 2 user_id, 'a' event_type, cast(id as double) value, '' props from range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    q = write_hourly(event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    # hours that the watermark has passed are there, once each
    assert 0 < got.count() <= 20 and got.count() == got.select("series_id", "ts").distinct().count()


def test_lags_of_a_phase():
    assert lin.phase_lags(24, 3, 12) == [[0, 12], [1, 13], [2, 14]]
    assert lin.phase_lags(7, 2, 3, offset=1, cycles=1) == [[5], [6]]
    for bad in (dict(period=0), dict(period=30), dict(period=3, cycles=0)):
        with pytest.raises(ValueError):
            lin.phase_lags(24, 7, **bad)


def test_phase_heads_equal_least_squares_on_their_lags(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 10000, (60, 6)), rng.integers(0, 10000, (60, 2))
    w = lin.fit_periodic(spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<long>, y array<long>"), lin.phase_lags(6, 2, 3))
    for h, at in enumerate([[0, 3], [1, 4]]):
        want = np.linalg.lstsq(np.c_[x[:, at], np.ones(60)].astype(float), y[:, h].astype(float), rcond=None)[0]
        assert np.allclose(w[[*at, 6], h], want)
        assert not w[[i for i in range(6) if i not in at], h].any()


def test_presets_move_their_free_parameters_only(spark):
    step = dict(a=0.5, gamma=1.2, nu=0.1, alpha=0.7, beta=0.3)
    assert nrm.updated("in", nrm.preset("in"), step) == nrm.IN
    assert nrm.updated("grevin", nrm.preset("grevin"), step) == nrm.IN | step
    assert nrm.updated("grevin", nrm.preset("grevin"), step, free=("alpha_beta",)) == nrm.IN | {"alpha": 0.7, "beta": 0.3}
    assert nrm.preset("cmin", {"alpha": 1.5, "beta": float("nan")}) == nrm.IN | {"alpha": 1.5}
    tied = nrm.effective("previn", nrm.updated("previn", nrm.preset("previn"), step))
    assert (tied["gamma"], tied["alpha"], tied["beta"]) == (1.2, 1 / 1.2, -0.1 / 1.2) and (tied["c"], tied["d"]) == (1, 1)
    for call in (lambda: nrm.preset("other"), lambda: nrm.updated("in", nrm.IN, step, free=("other",))):
        with pytest.raises(ValueError):
            call()
    rows = spark.createDataFrame([(0, 700, 2, 1000, 580000), (1, 700, 2, 1000, 580000)], "cluster_id int, c long, n long, s1 long, s2 long")
    forward, inverse = nrm.of_clusters("previn", nrm.preset("previn"), {1: {"gamma": 2.0}})
    a, b = rows.orderBy("cluster_id").select(forward(F.col("c") / 100).alias("z"), inverse(forward(F.col("c") / 100)).alias("x")).collect()
    assert b.z == pytest.approx(2 * a.z) and a.x == pytest.approx(7) and b.x == pytest.approx(7)


def test_channel_specifications(spark):
    assert [m["mode"] for m in arr.covariate_modes(["square-root", "", {"name": "noise", "count": 2, "scale": 3}])] == ["square", "root", "noise"]
    assert arr.covariate_modes({"name": "constant", "constant_value": 2, "target": "past_only"}) == [{"mode": "constant", "count": 1, "value": 2.0, "target": "past_only"}]
    for bad in ("other", {"count": 1}, {"name": "noise", "count": 0}):
        with pytest.raises(ValueError):
            arr.covariate_modes(bad)
    (past, future), (other, none) = (arr.generated(s, 4, 2, F.col("id"))[0] for s in arr.covariate_modes([{"name": "constant", "value": 2, "target": "future_included"}, {"name": "noise"}]))
    row = spark.range(1).select(past.alias("past"), future.alias("future"), other.alias("other")).first()
    assert none is None and row.past == [2.0] * 4 and row.future == [2.0] * 2 and len(row.other) == 4
    with pytest.raises(ValueError):
        arr.generated({"mode": "noise", "count": 1, "value": None, "target": "other"}, 4, 2)


def test_noise_is_standard_normal_and_repeatable(spark):
    draw = lambda: [r.z for r in spark.range(200).select("id", F.explode(arr.noise(F.lit(50), 7, F.col("id"))).alias("z")).orderBy("id").collect()]
    z = draw()
    assert z == draw() and len(set(z)) == len(z) == 10000
    assert abs(np.mean(z)) < 0.05 and abs(np.std(z) - 1) < 0.05


def test_rows_of_one_timestamp_keep_their_own_dates(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,a\n2020-01-02,3\n2020-01-01,1\n2020-01-02,4\n2020-01-01,2\n")
    rows = wide_csv.read_wide(spark, str(tmp_path / "w.csv"))[0].orderBy("t").collect()
    assert [(r.t, r.value, r.ts.day) for r in rows] == [(0, 1.0, 1), (1, 2.0, 1), (2, 3.0, 2), (3, 4.0, 2)]


def test_sources_by_dataset_and_frequency(spark, tmp_path):
    for name in ("a/D/x.csv", "a/h/sub/y.csv", "b/H/z.csv", "b/H/z.txt", "top.csv", "a/one.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t,v\n")
    names = lambda **k: sorted(r.relative for r in wide_csv.local_sources(spark, str(tmp_path), **k).collect())
    assert names() == ["a/D/x.csv", "a/h/sub/y.csv", "b/H/z.csv"]
    assert names(frequencies={"H"}) == ["a/h/sub/y.csv", "b/H/z.csv"] and names(datasets={"a"}, frequencies={"d"}) == ["a/D/x.csv"]
    first = wide_csv.local_sources(spark, str(tmp_path)).filter("dataset = 'b'").first()
    assert (first.dataset, first.frequency, first.bytes) == ("b", "H", 4)


@pytest.mark.parametrize("many", [0, 2])
def test_catalog(spark, tmp_path, many):
    entries = spark.createDataFrame([(f"d{i}", "x.csv", "x.json", 2, 10, 20) for i in range(many)], "name string, csv string, config string, num_series long, num_timestamps long, num_values long")
    skipped = spark.createDataFrame([("e/D/z.csv", "too short")], "relative string, reason string")
    store.write_catalog(entries, skipped, str(tmp_path / "c"), {"stride": 1, "settings": ["24:6"]})
    head = spark.read.json(f"{tmp_path}/c/catalog").first()
    assert (head.num_datasets, head.num_series, head.num_values, head.stride, head.settings) == (many, 2 * many, 20 * many, 1, '["24:6"]')
    assert spark.read.json(f"{tmp_path}/c/skipped").count() == 1


def test_shapes(spark):
    p = panel(spark, 2, 3, lambda s, t: t)
    ctx = lambda rows: spark.createDataFrame(rows, "series_id long, name string, t long, value double")
    shared = lambda rows: spark.createDataFrame(rows, "name string, t long, value double")
    good = ctx([(s, "k", None, 1.0) for s in range(2)] + [(s, "d", t, 1.0) for s in range(2) for t in range(3)])
    assert src.check_shapes(p, good, shared([("w", t, 0.0) for t in range(3)] + [("one", None, 0.0)])) == (2, 1, 3)
    for bad in (dict(context=ctx([(0, "k", None, 1.0)])), dict(context=ctx([(0, "d", 0, 1.0), (1, "d", 0, 1.0)])), dict(context=ctx([(0, "k", None, 1.0), (5, "k", None, 1.0)])), dict(shared=shared([("w", 0, 0.0), ("w", 1, 0.0)]))):
        with pytest.raises(ValueError):
            src.check_shapes(p, **bad)
    for broken in (p.limit(0), p.filter("series_id = 0 or t < 2"), p.union(p.limit(1)), p.filter("t > 0")):
        with pytest.raises(ValueError):
            src.check_shapes(broken)
    assert src.checked_indices(None, 3) == [0, 1, 2] and src.checked_indices([2, 0], 3) == [2, 0]
    for bad, error in (([], ValueError), ([3], IndexError), ([-1], IndexError)):
        with pytest.raises(error):
            src.checked_indices(bad, 3)
