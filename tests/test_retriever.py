"""The retrieval plan against a plain version, child metrics and the summary of a run."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.observe import RUN_STAGES, run_summary
from quire.operators.retriever import child_metrics, retrieve
from quire.settings import DEFAULTS


def _hits(rng):
    dense, sparse = [], []
    for q in range(6):
        for rank in range(1, 13):
            dense.append((q, f"p{rng.randrange(6)}", rng.randrange(5), round(rng.random(), 2), rank))
        for rank, p in enumerate(rng.sample(range(9), 5), 1):
            sparse.append((q, f"p{p}", rank))
    return dense, sparse


def _plain(dense, sparse, texts, queries, k, boost, pool):
    out, recalled = {}, {}
    for q in queries:
        score, seen = {}, []
        for key, rank in [(d[1], d[4]) for d in dense if d[0] == q] + [(s[1], s[2]) for s in sparse if s[0] == q]:
            score[key] = score.get(key, 0.0) + 1 / (60 + rank)
            seen.append(key) if key not in seen else None
        recalled[q] = set(seen)
        for key in seen if boost else ():
            kept = []
            for _, _, seq, _, _ in sorted((d for d in dense if d[0] == q and d[1] == key), key=lambda d: (-d[3], d[4])):
                if all(abs(seq - s) != 1 for s in kept):
                    kept.append(seq)
            if len(kept) >= 2:
                score[key] *= boost
        order = sorted(seen, key=lambda key: (-round(score[key], 9), seen.index(key)))
        if boost is None:
            out[q] = [key for key in order[:k] if key in texts]
            continue
        pairs = [(key, len(texts[key])) for key in order[:pool] if key in texts]
        out[q] = [key for key, _ in sorted(pairs, key=lambda x: -x[1])][:k] if len(pairs) > 1 else [key for key, _ in pairs]
    return out, recalled


@pytest.mark.parametrize("boost", [None, 0.0, 1.5])
def test_retrieve_equals_the_plain_version(spark, boost):
    dense, sparse = _hits(random.Random(5))
    texts = {f"p{i}": "x" * (7 * i % 5 + 1) for i in range(8)}  # p8 is not in the store; some lengths tie
    queries = list(range(6))
    frames = (
        spark.createDataFrame([(q, "q") for q in queries], "query_id int, query string"),
        spark.createDataFrame(dense, "query_id int, key string, seq int, score double, rank int"),
        spark.createDataFrame(sparse, "query_id int, key string, rank int"),
        spark.createDataFrame(list(texts.items()), "chunk_id string, content string"),
    )
    scorer = None if boost is None else lambda q, t: F.length(t)
    got = retrieve(*frames, 3, scorer, cfg=replace(DEFAULTS, merge_boost=boost or 0.0, rerank_top_k=4))
    rows = {}
    for r in got.top.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r.key)
    want, recalled = _plain(dense, sparse, texts, queries, 3, boost, 4)
    assert rows == {q: keys for q, keys in want.items() if keys}
    seen = {}
    for r in got.recalled.collect():
        seen.setdefault(r.query_id, set()).add(r.key)
    assert seen == recalled
    assert retrieve(frames[0], frames[1].limit(0), frames[2].limit(0), frames[3], 3, scorer).top.collect() == []


def test_child_metrics_count_the_first_twenty_hits(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 20), (1, 12, 21), (2, 10, 40)], "query_id int, child_id int, rank int")
    expected = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 12), (1, 13), (2, 10), (3, 5)], "query_id int, child_id int")
    rows = {r.query_id: (r.n_expected, r.child_hit_at_k, r.child_recall_at_k) for r in child_metrics(hits, expected).collect()}
    assert rows == {1: (4, 1, 0.5), 2: (1, 0, 0.0), 3: (1, 0, 0.0)}


CALLS = "kind string, input_tokens long, output_tokens long, cache_hit boolean, is_error boolean, error_type string, is_retry boolean, parse_error boolean"


def test_run_summary(spark):
    calls = [
        ("generator", 100, 10, True, False, None, False, False),
        ("generator", 300, 30, False, True, "Timeout", True, False),
        ("judge_quality", 50, 5, None, True, None, False, True),
        ("rerank", 0, 0, True, False, None, False, False),
        ("rerank", 0, 0, False, True, "Timeout", False, False),
    ]
    times = [("retrieve", 1.0), ("retrieve", 2.0), ("retrieve", 10.0), ("generate", 4.0), ("other", 99.0)]
    row = run_summary(spark.createDataFrame(calls, CALLS), spark.createDataFrame(times, "stage string, ms double")).first()
    assert row.total_input_tokens == 450 and row.parse_error_count == 1 and row.retry_count == 1
    assert row.rerank_cache_hit_rate == 0.5 and row.errors_by_type == {"Timeout": 2, "unknown": 1}
    assert row.input_tokens_p95 == pytest.approx(np.percentile([100, 300, 50, 0, 0], 95))
    for p in (50, 75, 95):
        assert row[f"stage_retrieve_p{p}"] == pytest.approx(np.percentile([1, 2, 10], p)) and row[f"stage_generate_p{p}"] == 4.0
    assert all(row[f"stage_{s}_p95"] == 0.0 for s in RUN_STAGES[2:])
    none = run_summary(spark.createDataFrame([], CALLS), spark.createDataFrame([], "stage string, ms double")).first()
    assert none.rerank_cache_hit_rate is None and none.errors_by_type == {} and none.output_tokens_p95 == 0.0
