"""Null groups, lists for queries without words, ids of any type, numbering over ranges, report operators."""

import math

from pyspark.sql import functions as F

from quire.operators import ordered
from quire.operators import reports as R
from quire.operators.corpus import stratified
from quire.operators.search import bm25_topk, dense_topk, postings, query_terms


def test_null_group_has_percentiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    got = {r.g: (r.n, r.p50) for r in ordered.percentiles(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert got == {"a": (2, 2.0), None: (2, 6.0)}


def test_null_stratum_is_kept_whole(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "s string, o int")
    assert sorted(r.o for r in stratified(df, "s", "o", {"a": 1}).collect()) == [1, 3, 4, 5]


def test_row_numbers(spark):
    rows = ordered.row_numbers(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"], "n").collect()
    assert all(r.v == r.n for r in rows) and len(rows) == 1000


def test_int_ids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, vector array<double>")
    asks = spark.createDataFrame([(7, [1.0, 0.1])], "query_id int, query_vector array<double>")
    assert [(r.query_id, r.chunk_id) for r in dense_topk(rows, asks, 2).orderBy("rank").collect()] == [(7, 1), (7, 2)]


def test_query_without_words_gets_a_list(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(6)], "doc_id int, text string")
    asks = spark.createDataFrame([(1, "!!!"), (2, "word4")], "query_id int, query string")
    got = bm25_topk(postings(docs), query_terms(asks), 3, match_only=False, queries=asks).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 4), (2, 0), (2, 1)]


def test_negative_scores_are_not_filled_with_zero(spark):
    # "common" is in nine of ten documents; its Okapi weight is lifted, so the ids that hold it must not come back as 0
    docs = spark.createDataFrame([(i, "common x" + str(i % 3)) for i in range(9)] + [(20, "other")], "doc_id int, text string")
    asks = spark.createDataFrame([(1, "common")], "query_id int, query string")
    got = bm25_topk(postings(docs), query_terms(asks), 12, match_only=False, idf="okapi").collect()
    assert sorted(r.doc_id for r in got) == [*range(9), 20] and [r.score for r in got if r.doc_id == 20] == [0.0]


def test_questions(spark):
    text = '{"questions": [{"question": " a? ", "expected_answer": "b", "question_type": "COMPARISON"}, {"query": " "}, {"query": "c", "question_type": "odd"}]}'
    rows = spark.createDataFrame([(text,), ("no json",), (None,)], "t string").select(F.inline(R.questions(F.col("t")))).collect()
    assert [tuple(r) for r in rows] == [("a?", "b", "comparison"), ("c", "", "factual")]


def test_choices_and_samples(spark):
    grid = spark.createDataFrame([(1.0, 0.5), (1.2, 0.7), (1.5, 0.7)], "boost double, recall_at_k double")
    assert R.best_setting(grid, "boost").head().boost == 1.2
    ids = spark.range(50).withColumnRenamed("id", "k")
    small, large = ({r.k for r in R.seeded_slice(ids, "k", 3, n).collect()} for n in (5, 9))
    assert small < large
    none = spark.createDataFrame([([],)], "c array<struct<chunk_id:string,title:string,source:string,content:string>>")
    assert none.select(R.judge_context(F.col("c")).alias("x")).head().x == "（无检索结果）"
    sample = spark.createDataFrame([(1, 0.5, "long text", "PASS")], "query_id int, mrr double, query string, verdict string")
    assert R.per_query(sample).columns == ["query_id", "mrr", "verdict"] and math.isclose(R.scalars(sample.drop("query_id"), "x.").head().value, 0.5)
