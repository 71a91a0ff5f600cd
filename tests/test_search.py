import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.operators import fusion, search
from quire.operators.search import bm25_topk, dense_topk, postings, query_terms
from quire.operators.signatures import corpus_signature, manifest_diff


def test_dense_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(230, 8)).round(1)
    v[50] = v[51] = v[52]
    rows = spark.createDataFrame([(f"c{i:03d}", r.tolist()) for i, r in enumerate(v)], "chunk_id string, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 230, 23)], "query_id long, query_vector array<double>")
    got = {}
    for r in dense_topk(rows, q, 7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    for i in range(0, 230, 23):
        s = np.round(v @ v[i], 6)
        want = sorted(range(230), key=lambda j: (-s[j], f"c{j:03d}"))[:7]
        assert [got[i][k + 1][0] for k in range(7)] == [f"c{j:03d}" for j in want]


def test_dense_topk_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "chunk_id long, vector array<double>")
    q = rows.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = {tuple(r) for r in dense_topk(rows, q, 3).collect()}
    monkeypatch.setattr(search, "SLICE_ROWS", 7)
    assert {tuple(r) for r in dense_topk(rows, q, 3).collect()} == whole and len(whole) == 180


def test_dense_topk_of_others(spark, monkeypatch):
    # Ids that come twice, in slices of queries: no row of the query's own id is found, all others are.
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 4)).round(1)
    ids = [i % 70 for i in range(90)]
    rows = spark.createDataFrame([(n, r.tolist()) for n, r in zip(ids, v)], "chunk_id long, vector array<double>").repartition(3)
    q = rows.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(search, "SLICE_ROWS", 11)
    monkeypatch.setattr(search, "PIECE_SCORES", 100)
    got = {}
    for r in dense_topk(rows, q, 5, write_blocks=True, others=True).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    s = np.round(v @ v.T, 6)
    for i in range(70):
        want = sorted((-s[a, b], ids[b]) for a in range(90) if ids[a] == i for b in range(90) if ids[b] != i)[:5]
        assert [got[i][k + 1] for k in range(5)] == [(n, -x) for x, n in want]


def brute_bm25(docs, query, idf="lucene"):
    toks = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for i, t in toks.items():
        tf, s, hit = Counter(t), 0.0, False
        for w in re.findall(r"\w+", query.lower()):
            if w in df:
                hit = hit or tf[w] > 0
                g = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) if idf == "lucene" else raw[w] if raw[w] >= 0 else 0.25 * mean
                s += g * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if hit:
            out[i] = round(s, 6)
    return out


def test_bm25(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eta", "the"]
    docs = [(i, " ".join(rng.choices(words, weights=[5, 3, 2, 1, 1, 9], k=rng.randint(0, 30)))) for i in range(40)]
    queries = [(1, "alpha beta beta"), (2, "delta"), (3, "the unknown"), (4, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = query_terms(spark.createDataFrame(queries, "query_id long, query string"))
    index = postings(d)
    for idf in ("lucene", "okapi"):
        got = {}
        for r in bm25_topk(index, t, 10, idf=idf).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
        for q, text in queries:
            want = sorted(brute_bm25(docs, text, idf).items(), key=lambda x: (-x[1], x[0]))[:10]
            have = sorted(got.get(q, []))
            assert [h[1] for h in have] == [w[0] for w in want]
            assert all(abs(h[2] - w[1]) < 2e-6 for h, w in zip(have, want))
    filled = bm25_topk(index, t, 10, match_only=False)
    counts = {r.query_id: r["count"] for r in filled.groupBy("query_id").count().collect()}
    assert counts == {1: 10, 2: 10, 3: 10, 4: 10}


def test_bm25_sum_needs_no_exchange_of_its_own(spark):
    d = spark.createDataFrame([(i, "a b c") for i in range(10)], "doc_id long, text string")
    t = query_terms(spark.createDataFrame([(1, "a b")], "query_id long, query string"))
    plan = search.bm25_scores(postings(d), t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, query_id", plan)


def test_rrf_adds_up_children_and_keeps_first_seen_order(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (1, "b", 2)], "query_id int, key string, rank int")
    sparse = spark.createDataFrame([(1, "c", 2), (1, "d", 1)], "query_id int, key string, rank int")
    rows = fusion.ranked(fusion.rrf(dense, sparse), 10).orderBy("rank").collect()
    assert [r.key for r in rows] == ["a", "d", "b", "c"]
    assert abs(rows[0].rrf_score - (1 / 61 + 1 / 63)) < 1e-12


def test_auto_merge(spark):
    fused = spark.createDataFrame([(1, "p", 0.1, 0, 1), (1, "q", 0.2, 0, 2)], "query_id int, key string, rrf_score double, first_list int, first_rank int")
    dense = spark.createDataFrame(
        [(1, "p", 0.9, 0, 1), (1, "p", 0.8, 1, 2), (1, "p", 0.7, 2, 3), (1, "q", 0.9, 4, 4), (1, "q", 0.8, 5, 5), (1, "x", 0.5, 0, 6), (1, "x", 0.5, 9, 7)],
        "query_id int, key string, score double, seq long, rank int",
    )
    got = {r.key: r.rrf_score for r in fusion.auto_merge(fused, dense, 2.0).collect()}
    assert got == {"p": 0.2, "q": 0.2}
    assert {r.key: r.kept for r in fusion.parent_hits(dense).collect()} == {"p": 2, "q": 1, "x": 2}


def test_rerank_order_fallback_and_cache(spark):
    c = spark.createDataFrame(
        [(1, "a", 1, "q", "5"), (1, "b", 2, "q", "9"), (2, "a", 1, "q", "bad"), (2, "b", 2, "q", "9"), (3, "z", 1, "q", "bad")],
        "query_id int, key string, rrf_rank int, query string, content string",
    )
    score = lambda q, t: t.try_cast("double")
    order = lambda df: [(r.query_id, r.key) for r in df.orderBy("query_id", "rank").collect()]
    assert order(fusion.rerank(c, score, 5)) == [(1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "z")]
    cache = spark.createDataFrame([(1, "a", 3.0)], "query_id int, key string, rerank_score double")
    assert order(fusion.rerank(c, score, 5, cache=cache))[:2] == [(1, "a"), (1, "b")]


def test_signatures(spark):
    rows = [("a", "x"), ("b", "y")]
    sig = lambda r: corpus_signature(spark.createDataFrame(r, "chunk_id string, content string")).head().signature
    assert sig(rows) == sig(rows[::-1]) != sig([("a", "x"), ("b", "z")])
    m = lambda r: spark.createDataFrame(r, "path string, sha256 string")
    got = {(r.path, r.change) for r in manifest_diff(m([("a", "1"), ("b", "1"), ("c", "1")]), m([("a", "1"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {("b", "changed"), ("c", "missing"), ("d", "new")}
