"""Figures over a whole run: every vector asks, not some of them."""

import duckdb
import numpy as np
import pytest

from oracle_check import norm
from quire.plans.registry import all_oracles, all_queries


def write(spark, path, extra=()):
    """Sixty vectors, none with an id that is divisible by 100."""
    v = np.random.default_rng(9).normal(size=(60, 6)).round(2)
    rows = [(i + 1, r.tolist(), i % 4) for i, r in enumerate(v)] + list(extra)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("vectors"))


def both(spark, sf_dir, name):
    """The rows of a query, and whether its SQL gives the same."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet/*.parquet'")
    cur = con.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    got = all_queries()[name](spark, sf_dir).select(*names).collect()
    plain = [sorted(tuple(norm(v) for v in r) for r in rows) for rows in (got, cur.fetchall())]
    return got, plain[0] == plain[1]


def test_significance_is_over_every_vector(spark, vectors):
    rows, same = both(spark, vectors, "run_significance")
    assert same and [r.pairs for r in rows] == [60] * 3 and all(r.p_value is not None for r in rows)


def test_a_vector_without_numbers_finds_nothing(spark, vectors, tmp_path):
    one_more = write(spark, tmp_path, [(61, None, 0)])
    mrr = {d: {r.metric: r for r in all_queries()["run_significance"](spark, d).collect()}["mrr"] for d in (vectors, one_more)}
    assert mrr[one_more].pairs == 61 and mrr[one_more].a == pytest.approx(mrr[vectors].a * 60 / 61, abs=2e-6)


def test_gate_is_over_every_vector(spark, vectors):
    rows, same = both(spark, vectors, "metric_gate")
    assert same and sorted(r.metric for r in rows) == ["c0", "c1", "c2", "c3"]


def test_boost_is_chosen_over_every_vector(spark, vectors, tmp_path):
    rows, same = both(spark, vectors, "best_boost")
    one_more = write(spark, tmp_path, [(61, None, 0)])
    found = round(rows[0].recall_at_k * 60)
    assert same and found > 0 and rows[0].recall_at_k == pytest.approx(found / 60, abs=1e-6)
    assert all_queries()["best_boost"](spark, one_more).first().recall_at_k == pytest.approx(found / 61, abs=1e-6)


def test_boost_with_ids_that_come_twice(spark, vectors, tmp_path):
    twice = write(spark, tmp_path, [(i, [0.1 * i, 1.0, -1.0, 0.5, 0.0, 2.0], 1) for i in (3, 7, 8, 40)])
    assert both(spark, twice, "best_boost")[1]
