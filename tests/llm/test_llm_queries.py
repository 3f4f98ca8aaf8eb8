"""The registered queries of this subpackage, and the pipeline."""

from __future__ import annotations

import os
import sys

import pytest
from compare import connect, differences
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from riskloom.llm import oracles
from riskloom.llm.queries import QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(oracles.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, small_dir, name):
    found = differences(QUERIES[name](spark, small_dir), connect(small_dir), oracles.oracle_sql()[name])
    assert not found, "\n".join(found)


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(oracles.oracle_sql()) <= set(e.oracle_sql())


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").withColumn("text", F.when(
        F.col("doc_id") == 3, F.concat("text", F.lit(' token = "0123456789abcdef0123456789"'))).otherwise(F.col("text"))).cache()
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], small_dir).cache())
        assert seen[-1].columns == docs.columns
    sizes = [d.count() for d in seen]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    # Rejected documents go, and only those.
    from riskloom.llm import minhash, rules

    good = {r["doc_id"] for r in rules.judge(seen[1]).where("kept").collect()}
    assert {r["doc_id"] for r in seen[2].collect()} == good
    assert {r["doc_id"] for r in seen[3].collect()} == {r["doc_id"] for r in minhash.near_duplicates(seen[2]).where("kept").collect()}
    masked = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert masked[3].endswith(' [secret]"') and sum("[secret]" in t for t in masked.values()) < 20
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], small_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(masked)


def test_pipeline_on_odd_rows(spark, small_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small_dir)
        docs.collect()


def test_run(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir).collect()
    assert len({r["doc_id"] for r in rows}) > 100
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
