"""Every registered query that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import pytest

from compare import connect, differences
from riskloom.plans import oracles, queries

SF_DIR = os.environ.get("RISKLOOM_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_only_model_queries_lack_sql():
    assert set(queries.queries()) - set(oracles.oracle_sql()) == queries.MODEL_QUERIES
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = differences(queries.queries()[name](spark, SF_DIR), duck, oracles.oracle_sql()[name])
    assert not found, "\n".join(found)
