"""The pipeline's stages, each against a plain version on its own input."""

import os

import cases
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import queries
from tidewheel.llm.common import stash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in queries.table(spark, DATA, "benchmark").collect()]
    toxic = {r.doc_id for r in queries.table(spark, DATA, "labels").filter("toxic = 1").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        got = {r.doc_id: r.text for r in rows} if "text" in docs.columns else None
        assert len({r.doc_id for r in rows}) == len(rows)
        if i < 4:
            assert docs.columns == columns and all(before[k] == v for k, v in got.items())
        if i == 0:
            assert len(got) > 0.5 * len(before) and len(toxic & set(got)) <= 0.3 * len(toxic & set(before))
        elif i == 1:
            groups = {}
            for k, t in before.items():
                groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), k))
            assert set(got) == {min(v)[1] for v in groups.values()}
        elif i == 2:
            assert set(got) == {c for _, c in cases.near(list(before.items())).values()}
        elif i == 3:
            assert set(got) == {k for k, t in before.items() if not cases.hits(t, bench)[1]}
        else:
            assert {r.doc_id for r in rows} == set(before) and all(r.round_trip for r in rows)
        before = got or before


def test_registered_queries_run(spark):
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 13
    assert corpus_pipeline.run(spark, DATA).columns[0] == "doc_id"


@pytest.mark.parametrize("none", [False, True])
def test_stages_on_awkward_documents(spark, none):
    """Nulls in any column, empty and long texts, repeated rows, names that stages use themselves, and an empty table."""
    docs = (cases.empty(spark) if none else cases.documents(spark)).withColumn("_name", F.lit("own")).withColumn("_score", F.lit(None).cast("string"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.dtypes == docs.dtypes
        docs = stash(kept)
        rows = docs.collect()
        assert {(r.doc_id, r.text) for r in rows} <= texts and all(r._name == "own" for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(last) == docs.count() and all(r.round_trip for r in last) and (none or len(last) > 5)
    if not none:
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows)  # rows of one id and text count once
