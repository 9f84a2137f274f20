"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidewheel.plans import family_queries, model_queries, panel_queries, registry, report_queries, training_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: One of each kind: all are compared by the driver.
NAMES = ["mdl1_report_persistence", "flt10_owned_dates_with_gaps", "flt12_window_filter_any_variate", "jon1_lookback_future_gather", "jon2_date_major_pairs", "agg8_loader_statistics", "nrm_grevin", "nrm_revin", "smp5_iid_clusters", "smp12_subset_of_dates", "win7_patches", "agg20_improvements", "run4_latest_config", "rpt1_comparison_table", "fam1_constant_windows", "src1_wide_csv_to_long", "los5_floored_losses", "mdl6_periodic_linear", "fam1_fitted_policies", "fam3_normalizations", "fam4_reference", "mdl6_phase_heads", "nrm11_presets", "cov5_noise_channels", "smp3_individual_split", "smp16_sample_groups", "rpt4_density", "rpt4_heatmap", "trn10_loader_order", "mdl7_two_lags", "mdl15_two_lags_per_user", "src15_written_results"]


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    frame = registry.QUERIES[name](spark, DATA)
    rel = sql.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    assert values(frame.columns, [tuple(r) for r in frame.collect()]) == values(rel.columns, rel.fetchall())


def test_every_query_has_a_name_and_most_have_sql():
    assert len(registry.QUERIES) > 150
    assert len(registry.QUERIES) - len(registry.ORACLES) <= 10


def test_entry_imports_without_the_corpus_subpackage():
    import subprocess
    import sys

    code = "import sys\nclass No:\n  def find_spec(self, name, *a):\n    if name == 'corpus_pipeline' or name.startswith('tidewheel.llm'): raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 150 and not [q for q in e.queries() if q.startswith('op')]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
