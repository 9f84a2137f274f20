"""Queries on sparse events: equal last values, absent hours, users without an id, windows from known cells against windows from dense rows."""

import datetime

import duckdb
import numpy as np
import pytest

from tidewheel.operators import blocks
from tidewheel.operators import windows as win
from tidewheel.plans import model_queries, panel_queries, registry, report_queries, training_queries  # noqa: F401
from tidewheel.sources import panels as src


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of 200 hours: user 1 has none at the hours of queries, user 2 only then, 3 one event, 4 many, and some have no user."""
    rng, start = np.random.default_rng(3), datetime.datetime(2024, 1, 1)
    at = lambda h, m=5: start + datetime.timedelta(hours=int(h), minutes=m)
    rows = [(1, h) for h in range(200) if (h - 23) % 6] + [(2, h) for h in range(23, 200, 6)] + [(3, 77), (None, 12), (None, 80), (4, 0), (4, 199)] + [(4, h) for h in rng.integers(0, 200, 150)]
    path = str(tmp_path_factory.mktemp("events"))
    frame = spark.createDataFrame([(i, at(h), u, "click", float(rng.integers(-500, 900)) / 100, "{}") for i, (u, h) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def equal(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    frame, rel = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    rows = lambda columns, values: sorted(repr([round(r[columns.index(c)], 9) if isinstance(r[columns.index(c)], float) else r[columns.index(c)] for c in sorted(columns)]) for r in values)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got and got == rows(rel.columns, rel.fetchall())
    return got


def test_equal_last_values_have_no_slope(spark, folder):
    assert any("nan" in r and "None" in r for r in equal(spark, folder, "mdl15_per_user_regression"))


@pytest.mark.parametrize("name", ["jon3_individual_context", "nrm_standard", "nrm11_presets", "mdl17_constant_rule", "mdl10_decomposed_at_start", "mdl15_two_lags_per_user"])
def test_queries_on_sparse_events_equal_sql(spark, folder, name):
    equal(spark, folder, name)


def shuffled(frame):
    """Columns of the rows that a plan exchanges by a hash."""
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_only_known_cells_are_shuffled(spark, folder):
    panel = src.events_hourly(spark, folder)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and len(shuffled(panel)) <= 3
    assert len(shuffled(registry.QUERIES["jon3_individual_context"](spark, folder))) <= 3
    w = blocks.windows(panel, win.split_ranges(200, [0.6, 0.2, 0.2]), 24, 6, 6)
    assert "Window" not in w._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("lookback", "horizon", "stride", "size"), [(24, 6, 6, None), (7, 3, 1, 16), (50, 20, 4, 9)])
def test_windows_of_known_cells_equal_those_of_dense_rows(spark, folder, lookback, horizon, stride, size, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_CELLS", 3000)
    panel = src.events_hourly(spark, folder)
    splits = win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2])
    dense = panel.select("*")
    assert getattr(dense, "known", None) is None
    got, want = (blocks.windows(p, splits, lookback, horizon, stride, size=size) for p in (panel, dense))
    rows = lambda df: sorted(map(repr, df.select(*sorted(got.columns)).collect()))
    assert rows(got) == rows(want) and got.count() > 0
    assert blocks.windows(panel, [], lookback, horizon).collect() == []
    assert rows(blocks.windows(blocks.kept(panel), splits, lookback, horizon, stride, size=size)) == rows(want)


def test_sums_of_squares_are_exact_or_fail():
    x = np.array([[3_000_000_000, 0], [1, 2]])
    assert blocks._squares(x).tolist() == [9 * 10**18, 5]
    with pytest.raises(OverflowError):
        blocks._squares(np.array([[3_000_000_000, 3_000_000_000]]))
