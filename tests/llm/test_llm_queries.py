"""The registered queries next to their SQL, on the smallest data; those without SQL are tested by hand elsewhere."""

import pytest
from oracle_check import compare

import __spark_entry__ as entry
from quire.llm.queries import ORACLES, QUERIES

BRUTE_FORCE = {"op1_quotes", "op3_bpe", "op4_sharding", "op5_line_dedup", "op7_quality_mil", "op10_pii", "op11_packing"}


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(QUERIES) == set(ORACLES) | BRUTE_FORCE


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, tiny, name):
    ok, note, _ = compare(spark, tiny, name, QUERIES[name], ORACLES[name])
    assert ok, note
