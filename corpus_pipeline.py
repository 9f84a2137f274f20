"""A corpus from raw documents: graded, deduplicated, decontaminated and encoded. Counted as part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import on_workers, stash
from tidewheel.llm.decontaminate import decontaminate
from tidewheel.llm.exact_dedup import drop_exact_copies
from tidewheel.llm.jaccard_join import drop_near_copies
from tidewheel.llm.quality import keep_good
from tidewheel.llm.sentencepieces import encode_and_decode


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is the highest with a probability of one half at least."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    on_workers(spark)
    return drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each document, decoded again to check them."""
    on_workers(spark)
    return encode_and_decode(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("benchmark decontamination", clean), ("sentencepiece encoding and decoding", pieces)]

#: SQL can't express the fitted classifier; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
