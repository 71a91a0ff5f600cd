"""Approximate vectors, keyed tables, snapshots, batches that come again, breakers, unmatched documents."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import ann
from quire.operators.search import _unmatched, dense_topk
from quire.sources.lookup import KeyedTable
from quire.sources.snapshots import SnapshotStore
from quire.sources.store import ChunkStore
from quire.streaming.breaker import CHANGES, ROCKS, follow, follow_bucket, start_breaker


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(f"v{i}", (centres[min(i % 20, 11)] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    return spark.createDataFrame([*rows, ("none", None), ("empty", [])], "chunk_id string, vector array<double>")


def test_all_lists_give_the_exact_answer(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 40)  # long lists in parts, queries in blocks
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    made = ann.InvertedLists.build(vectors, str(tmp_path / "index"), lists=10)
    index = ann.InvertedLists(spark, made.path)  # reloaded
    assert index.rows().count() == 900 and len(index.centroids) == 10
    asks = vectors.where("chunk_id IN ('v1', 'v19', 'v500') OR chunk_id LIKE 'v8%' OR chunk_id = 'none'").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    exact = dense_topk(vectors, asks.where("query_vector IS NOT NULL"), 5).select("query_id", F.col("chunk_id").alias("row_id"), "score", "rank")
    assert sorted(map(tuple, index.search(asks, 5, 10).collect())) == sorted(map(tuple, exact.collect()))
    asks = asks.where("query_vector IS NOT NULL")
    probes = index.tuned(asks, 5, 0.95)
    assert 1 <= probes < 10
    figure = ann.recall(index.search(asks, 5, probes), exact).first()
    assert figure["hits"] >= 0.9 * figure["pairs"]


def test_search_reads_probed_lists_only(spark, tmp_path, vectors):
    index = ann.InvertedLists.build(vectors, str(tmp_path / "index"), lists=10)
    one = vectors.where("chunk_id = 'v1'").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    found = index.search(one, 3, 1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert found.first()["row_id"] == "v1" or found.count() == 3


def test_a_table_without_vectors(spark, tmp_path, vectors):
    index = ann.InvertedLists.build(vectors.where("chunk_id = 'none'"), str(tmp_path / "index"))
    assert len(index.centroids) == 0


@pytest.mark.parametrize("literal", [1000, 2])
def test_fetch_by_key(spark, tmp_path, monkeypatch, literal):
    from quire.sources import lookup

    monkeypatch.setattr(lookup, "LITERAL_KEYS", literal)
    rows = spark.createDataFrame([(i % 50 if i % 9 else None, f"t{i}") for i in range(400)], "id long, text string")
    keyed = KeyedTable.write(rows, str(tmp_path / "keyed"), "id", folders=16)
    keys = spark.createDataFrame([(3,), (3,), (7,), (999,), (None,), (11,)], "k long")
    got = keyed.fetch(keys)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in rows.where("id IN (3, 7, 11)").collect())
    assert keyed.rows().count() == 400
    if literal == 1000:
        plan = got._jdf.queryExecution().toString()
        assert "PartitionFilters: [key_folder" in plan and "PushedFilters: [In(id" in plan


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "snaps"))
    a = spark.createDataFrame([("x", "one"), ("y", "one"), ("z", None), ("w", "two")], "path string, content string")
    store.take("a", a)
    b = spark.createDataFrame([("x", "one"), ("y", "three"), ("new", "four")], "path string, content string")
    now = store.take("b", b)
    assert store.names() == ["a", "b"] and store._bodies().count() == 5  # one, empty, two, three, four
    assert {(r["path"], r["action"]) for r in store.difference("a", now).collect()} == {("x", "keep"), ("y", "replace"), ("z", "copy"), ("w", "copy"), ("new", "delete")}
    assert sorted(map(tuple, store.restore("a", b).collect())) == [("w", "two"), ("x", "one"), ("y", "one"), ("z", "")]
    assert sorted(map(tuple, store.read("b").collect())) == [("new", "four"), ("x", "one"), ("y", "three")]
    assert store.damaged("a").count() == 0
    with pytest.raises(ValueError):
        store.take("a", a)
    with pytest.raises(ValueError):
        store.take("c", a.union(a))
    spark.createDataFrame([("ab", "forged")], "digest string, content string").write.mode("overwrite").parquet(str(tmp_path / "snaps/bodies"))
    assert store.damaged("b").count() == 3


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))

    def batch(text):
        parents = spark.createDataFrame([("d1", "d1", text)], "chunk_id string, doc_id string, content string")
        return parents, spark.createDataFrame([("d1:c", "d1", "d1", text)], "chunk_id string, doc_id string, parent_id string, content string")

    assert not store.committed("s-0") and store.ingest_once(*batch("old"), "s-0")
    assert store.committed("s-0") and not store.ingest_once(*batch("new"), "s-0")
    assert store.parents().first()["content"] == "old" and store.children().count() == 1
    store.ingest(*batch("half"), "s-1")  # broke off before its commit
    assert store.ingest_once(*batch("whole"), "s-1")
    assert [r["content"] for r in store.parents().collect()] == ["whole"]


def test_breaker_follows_runs():
    bad, good = (False, False), (True, False)

    def rows(*kinds, start=1):
        return [(start + i, *k) for i, k in enumerate(kinds)]

    assert follow(0, False, rows(bad, bad, good, bad, bad), 3) == (2, False, [])
    assert follow(2, False, rows(bad, bad), 3) == (4, True, [1])
    assert follow(0, False, rows((False, True), bad), 3) == (2, True, [1])
    assert follow(9, True, rows(bad, good), 3) == (0, True, [])


def test_breakers_of_a_bucket_follow_runs_like_single_ones():
    rnd = random.Random(1)
    for _ in range(40):
        plain, sent, state = {}, {}, ([], [], [], [], [])
        for _ in range(4):
            rows, opened = [], []
            for key in rnd.sample(["a", "b", None, "c", "d"], rnd.randint(1, 5)):
                failures, last, is_open = plain.get(key, (0, 0, False))
                new = [(last + 1 + i, rnd.random() < 0.4, rnd.random() < 0.05, 1000 * (last + 1 + i)) for i in range(rnd.randint(0, 7))]
                sent.setdefault(key, []).extend(new)
                rows += [(key, *r) for r in new + rnd.sample(sent[key], min(len(sent[key]), 2))]
                if new:
                    failures, is_open, at = follow(failures, is_open, [r[:3] for r in new], 3)
                    plain[key] = (failures, new[-1][0], is_open)
                    opened += [(key, seq) for seq in at]
            rnd.shuffle(rows)
            after, got = follow_bucket(state, pd.DataFrame(rows, columns=["backend", "seq", "ok", "fatal", "at"]), 3, 600, 5)
            state = after or state
            states = dict(zip(state[0], zip(*state[1:], strict=True), strict=True))
            assert {key: s[:3] for key, s in states.items()} == plain
            assert sorted(map(tuple, got.itertuples(index=False)), key=str) == sorted(opened, key=str)
            assert all(states[key][3] == max(1000 * seq + 600, 6) for key, seq in opened)


def test_breakers_share_a_state_and_close_one_by_one(spark, tmp_path):
    """600 keys cost at most 8 values of state; a stopped stream goes on, with timers of several keys in a bucket."""
    early, late_on, big = 1_700_000_000, 1_700_010_000, 2**60 + 1

    def run(rows):
        schema = "backend long, seq long, ok boolean, category string, ts timestamp"
        frame = spark.createDataFrame([(k, s, ok, "", dt.datetime.fromtimestamp(at, dt.timezone.utc)) for k, s, ok, at in rows], schema)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        job = start_breaker(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"), late="0 seconds", buckets=8)
        job.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= 16  # states and timers

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        keys = [None, big, *range(598)]
        hours = {k: late_on if k is not None and k % 2 == 0 else early for k in keys}  # even ones open late and stay open
        run([(k, s, False, hours[k] + s) for k in keys for s in (2, 1, 3)])
        run([(k, s, False, late_on + 10 + s) for k in keys for s in (3, 4, 5, 6)])
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.schema(CHANGES.format("bigint")).parquet(str(tmp_path / "out")).collect()), key=str)
    odd = [k for k in keys if hours[k] == early]
    want = [(k, 3, "open") for k in keys] + [(k, 3, "trial") for k in odd] + [(k, 6, "open") for k in odd]
    assert got == sorted(want, key=str)


def test_unmatched_documents_equal_a_plain_list(spark):
    rnd = random.Random(4)
    ids = sorted(rnd.sample(range(100_000), 5200))
    hits = {1: set(ids[:1000]) | set(ids[1003:2000]), 2: set(ids), 3: set(), 4: set(ids[1:5200:2]), 5: set(ids[:3000]), 6: set(ids[:-4])}
    index = spark.createDataFrame([("", i) for i in ids], "term string, doc_id long")
    scores = spark.createDataFrame([(q, d, 1.0) for q, s in hits.items() for d in s], "query_id int, doc_id long, score double")
    wanted = spark.createDataFrame([(q,) for q in hits], "query_id int")
    got = {}
    for r in _unmatched(index, scores, wanted, 5).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    for q, matched in hits.items():
        assert sorted(got.get(q, []))[:5] == [i for i in ids if i not in matched][:5], q
