import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.annotation import consistent, fold, operating_point, quote_present, reference_facts, scan


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).head()[0]


def test_clean(spark):
    raw = "A​B <b>bold</b> https://x.org/p?a=1#f (Mail@Example.COM)\nCopyright 2020\nRead   more\n版权所有 某\nend"
    want = "AB bold https://x.org/p (mail@example.com)\n\n\n\nend"
    assert one(spark, raw, X.clean) == want
    assert one(spark, want, X.clean) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB@.<>/ \n?#:htps©", max_size=40), min_size=20, max_size=20))
def test_clean_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.clean(F.col("t")).alias("a"))
    # A tag or URL may only appear once the first pass has removed what stood inside it.
    rows = df.select("a", X.clean(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in rows if "<" not in r.a and "http" not in r.a)


def test_normalize(spark):
    raw = "\n\n#T\r\n| - | ---- |\r\ntext  \n\n\n\n\nmore\n\n"
    assert one(spark, raw, X.normalize_markdown) == "# T\n| --- | --- |\ntext\n\nmore".replace("| --- | --- |", "|---|---|")


def test_pipe_table_and_heading(spark):
    df = spark.sql("SELECT array(array('a','b'), array('1','x\ny')) AS r, array(array('h')) AS one, cast(array() as array<array<string>>) AS none")
    row = df.select(X.pipe_table(F.col("r")), X.pipe_table(F.col("one")), X.pipe_table(F.col("none"))).head()
    assert row[0] == "| a | b |\n| --- | --- |\n| 1 | x y |"
    assert row[1] == "| h |\n| --- |" and row[2] == ""
    assert spark.range(1).select(X.heading_line(F.lit(9), F.lit(" t "))).head()[0] == "###### t"


def test_small_helpers(spark):
    assert one(spark, "/a/b/Doc.Final.MD", X.stem) == "doc.final"
    assert one(spark, "file:/d/data/sub/x.md", lambda c: X.doc_id_from_path(c, "/d/data")) == "sub/x"
    assert one(spark, "/other/x.md", lambda c: X.doc_id_from_path(c, "/d/data")) == "x"
    assert one(spark, "日本語", lambda c: X.fit_bytes(c, 7)) == "日本"
    assert one(spark, "a😀b", lambda c: X.fit_bytes(c, 4)) == "a"
    assert one(spark, "b a b", lambda c: X.term_counts(X.tokens(c))) == [("a", 1), ("b", 2)]
    assert spark.range(1).select(X.format_hms(F.lit(3725))).head()[0] == "01:02:05"
    assert spark.range(1).select(X.auto_query_id(F.lit(7))).head()[0] == "Q0007"
    assert one(spark, "https://a.b/x/y z?q=1", lambda c: X.slug(c, F.lit(3))) == "0003-y-z"
    sig = [one(spark, q, lambda c, a=a: X.query_signature(c, F.array(*map(F.lit, a)))) for q, a in (("q", ["x", "y"]), ("q", ["y", "x"]))]
    assert sig[0] == sig[1] and len(sig[0]) == 16


@pytest.mark.parametrize(
    "raw,want",
    [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 2}\n```\ny', '{"a": 2}'), ('say {"a": {"b": 3}} and {c}', '{"a": {"b": 3}}'), ("none", None), ("{open", None)],
)
def test_json_block(spark, raw, want):
    assert one(spark, raw, X.json_block) == want


def test_question_type(spark):
    rows = [("A和B的区别", "single_chunk", "comparison"), ("如果失败", "single_chunk", "conditional"), ("如果", "multi_chunk", "multi_hop"), ("什么", "x", "factual")]
    df = spark.createDataFrame(rows, "q string, d string, w string")
    assert all(r[0] == r[1] for r in df.select(X.question_type(F.col("q"), F.col("d")), "w").collect())


def test_context(spark):
    df = spark.sql("SELECT array(struct('T' AS title, 's' AS source, 'c1' AS content), struct('' AS title, '' AS source, 'c2' AS content)) AS c")
    assert df.select(X.context_text(F.col("c"))).head()[0] == "[来源1] 文档: T\nc1\n\n---\n\n[来源2] 文档: [未知来源]\nc2"


def test_annotation_rules(spark):
    assert one(spark, "Hello，World！  RAG系统", fold) == one(spark, "hello, world! rag系统", fold)
    df = spark.createDataFrame([("Design Patterns：GoF", "Design Patterns: GoF 是经典", True), ("无关", "内容", False), ("", "内容", False)], "q string, c string, w boolean")
    assert all(r[0] == r[1] for r in df.select(quote_present(F.col("q"), F.col("c")), "w").collect())
    rows = spark.createDataFrame(
        [("a", ["x"], "multi_hop", "s"), ("b", list("abcdef"), "factual", "s"), ("c", ["x", "y"], "multi_hop", "s")],
        "query_id string, expected_parent_ids array<string>, question_type string, difficulty string",
    )
    got = {r.query_id: (len(r.expected_parent_ids), r.difficulty, r.review_needed) for r in consistent(rows).collect()}
    assert got == {"a": (1, "single_chunk", True), "b": (4, "multi_chunk", True), "c": (2, "multi_chunk", False)}
    facts = spark.sql("SELECT reference FROM VALUES (array('p0','p2','p3')) t(reference)").select(
        reference_facts(F.col("reference"), F.create_map(F.lit("p2"), F.lit("two"), F.lit("p0"), F.lit("one"), F.lit("p3"), F.lit(" ")))
    )
    assert facts.head()[0] == "one; two"


def test_threshold_scan(spark):
    pos, neg = [0.9, 0.85, 0.8, 0.75, 0.7], [0.4, 0.5, 0.6, 0.65, 0.68]
    df = spark.createDataFrame([(c, True) for c in pos] + [(c, False) for c in neg], "cosine double, positive boolean")
    s = scan(df)
    rows = {round(r.threshold, 2): r for r in s.collect()}
    assert len(rows) == 9 and rows[0.5].keep_rate == 1.0 and rows[0.5].reject_rate == 0.4
    point = operating_point(s).head()
    assert point.found and point.threshold == 0.65
    assert operating_point(s, 1.0, 1.0).head().found is False
