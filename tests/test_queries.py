"""Every registered query against its SQL in DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare
from quire.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
#: Queries that SQL does not express; unit tests compare them with plain versions.
WITHOUT_SQL = {"parent_child_chunks", "fidelity_report"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, tiny, name):
    ok, note, _ = compare(spark, tiny, name, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"query_id", "rank", "chunk_id", "rrf_score", "n_chars"} and df.count() == 200
