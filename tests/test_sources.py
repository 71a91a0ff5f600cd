import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions.html import html_decision, low_text_ratio, read_page
from quire.operators.chunking import ingest
from quire.operators.corpus import guard_hits, needle_verdict, resolve_names
from quire.operators.observe import redact
from quire.sources import files
from quire.sources.store import ChunkStore, record_run, write_report, write_traces
from quire.streaming import jobs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    def p(text, style=""):
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def row(*cells):
        return "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"

    body = p("Title", "H1") + p("long text " * 20) + f"<w:tbl>{row('a', 'b')}{row('1', '2')}</w:tbl>" + p("end")
    return packed(
        {
            "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
            "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        }
    )


def pptx():
    def slide(*texts):
        shapes = "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for t in texts)
        return f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'

    return packed(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}"><p:sldSz cx="100" cy="100"/></p:presentation>',
            "ppt/slides/slide1.xml": slide("First slide", "body text " * 8),
            "ppt/slides/slide2.xml": slide("tiny"),
        }
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "sub").mkdir()
    (base / ".hidden").mkdir()
    (base / "synthetic").mkdir()
    (base / "sub" / "a.md").write_text("# A\n\nKeep <b>tags</b>", encoding="utf-8")
    (base / "b.html").write_text("<html><head><title>T</title></head><body><nav>x</nav><h1>Head</h1><p>" + "word " * 40 + "</p></body></html>")
    (base / "small.html").write_text("<html><body><p>no</p></body></html>")
    (base / "c.docx").write_bytes(docx())
    (base / "d.pptx").write_bytes(pptx())
    (base / "broken.docx").write_bytes(b"not a zip")
    (base / "e.pdf").write_bytes(b"%PDF")
    (base / ".hidden" / "x.md").write_text("hidden")
    (base / "synthetic" / "y.md").write_text("made up")
    (base / "z.bin").write_bytes(b"0")
    return str(base)


def test_load_documents(spark, folder):
    docs = {r.doc_id: r for r in files.load_documents(spark, folder).collect()}
    assert set(docs) == {"sub/a", "b", "small", "c", "d", "broken", "e"}
    assert docs["sub/a"].text == "# A\n\nKeep <b>tags</b>" and not docs["sub/a"].protect_tables
    assert docs["b"].text.startswith("# Head\n\nword") and docs["small"].decision == "skip" and docs["small"].text == ""
    assert docs["c"].text.startswith("# Title\n\nlong text") and "| a | b |\n| --- | --- |\n| 1 | 2 |" in docs["c"].text
    assert docs["d"].text.startswith("## First slide\n\nbody text") and "tiny" not in docs["d"].text
    loaded = files.load_documents(spark, folder)
    assert {r.source_url.rsplit("/", 1)[1] for r in files.failures(loaded).collect()} == {"broken.docx", "e.pdf"}
    assert {r.doc_id for r in files.usable(loaded).collect()} == {"sub/a", "b", "c", "d"}
    parsed = F.struct(F.lit("pdf text").alias("markdown"), F.lit("whole_text").alias("decision"), F.lit(False).alias("colpali"), F.lit(0).alias("vlm_candidates"), F.lit(None).cast("string").alias("error"))
    with_pdf = files.load_documents(spark, folder, parsers={"pdf": lambda c: parsed})
    assert with_pdf.where("doc_id = 'e'").head().text == "pdf text"
    assert files.file_manifest(spark, folder).where("path = 'sub/a.md'").count() == 1


def test_html_details(spark):
    html = (
        "<!DOCTYPE html><html><head><title> My &amp; T </title><style>p{}</style></head><body>bare<div>one <b>two</b><!-- note -->"
        "<h2>Head <i>in</i></h2><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x<br>y</td></tr></table><pre>\ncode\n  two\n</pre><img src=x></div><footer>f</footer></body></html>"
    )
    p = spark.createDataFrame([(html,)], "h string").select(read_page("h").alias("p")).select("p", html_decision(F.col("p")).alias("d"), low_text_ratio(F.col("p")).alias("low")).head()
    assert p.p.title == "My & T" and p.p.image_count == 1 and p.d == "vlm" and p.low
    assert p.p.markdown.split("\n\n") == ["one", "two", "note", "## Head in", "| a | b |\n| --- | --- |\n| 1 | x y |", "```\ncode\n  two\n```"]


def test_benchmark(spark, tmp_path):
    items = [
        {"query_id": "x", "query": "q", "expected_parent_ids": ["a"], "relevance": {"a": 2}, "category": "c", "difficulty": "d"},
        {"query": "old", "expected_chunk_ids": ["a", "zz"], "ground_truth": "facts"},
    ]
    path = tmp_path / "b.json"
    path.write_text(json.dumps(items))
    rows = {r["index"]: r for r in files.load_benchmark(spark, str(path)).collect()}
    assert rows[0].query_id == "x" and rows[0].relevance == {"a": 2} and not rows[0].missing_query_id
    assert rows[1].query_id == "Q0002" and rows[1].relevance == {"a": 3, "zz": 3} and rows[1].reference_facts == "facts"
    assert rows[1].category == "unknown" and rows[1].missing_category
    stale = files.stale_labels(files.load_benchmark(spark, str(path)), spark.createDataFrame([("a",)], "chunk_id string"))
    assert [tuple(r) for r in stale.collect()] == [(1, "zz")]


def test_jsonl_drops_bad_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"run_id": "a", "n": 1}\nnot json\n{"run_id": "b", "n": 2}\n')
    assert {r.run_id for r in files.read_jsonl(spark, str(path), "run_id string, n int").collect()} == {"a", "b"}


def test_pdf_precheck(spark):
    words = [1.0, 2.0, 3.0, 4.0, 90.0]
    rows = [("t", i, 9, 400, 0.0, [1.0, 2.0]) for i in range(9)] + [("m", 0, 1, 400, 0.4, words), ("v", 0, 2, 0, 0.9, []), ("v", 1, 2, 3, 0.9, []), ("s", 0, 1, 0, 0.0, [])]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, total_pages int, text_chars int, image_ratio double, word_x array<double>")
    got = {r.doc_id: r for r in files.pdf_precheck(df).collect()}
    assert got["t"].sampled == 5 and got["t"].decision == "whole_text" and got["t"].degraded_flags == []
    assert got["m"].degraded_flags == ["multi_column"] and got["m"].colpali and got["m"].vlm_candidates == 1
    assert got["v"].decision == "vlm" and got["v"].empty_page_ratio == 0.5 and got["s"].decision == "skip"


def docs_of(spark, rows):
    return ingest(spark.createDataFrame(rows, "doc_id string, text string"))


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.restore() is None
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert store.ingest(*docs_of(spark, [("a", "x " * 700), ("b", "small")]), "1", t0)
    parents, children = docs_of(spark, [])
    assert not store.ingest(parents, children, "empty", t0)
    assert {r.doc_id for r in store.parents().collect()} == {"a", "b"}
    assert store.ingest(*docs_of(spark, [("a", "new text")]), "2", t0 + dt.timedelta(minutes=1))
    assert [r.content for r in store.parents().where("doc_id = 'a'").collect()] == ["new text"]
    store.rollback(spark.createDataFrame([("b",)], "doc_id string"), t0 + dt.timedelta(minutes=2))
    assert {r.doc_id for r in store.children().collect()} == {"a"}
    store._mark(spark.createDataFrame([("stuck",)], "doc_id string"), "suspending", 1, t0, "3")
    store.expire(t0 + dt.timedelta(minutes=20))
    assert store.state().where("doc_id = 'stuck'").head().status == "suspending"
    store.expire(t0 + dt.timedelta(minutes=31))
    assert store.state().where("doc_id = 'stuck'").head().status == "deleted"
    assert store.restore()[0].count() == 1
    spark.createDataFrame([(99,)], "version int").coalesce(1).write.mode("overwrite").json(store._path("meta"))
    assert store.restore() is None


def test_sinks(spark, tmp_path):
    run = lambda i: spark.createDataFrame([("r", dt.datetime(2024, 1, i))], "run_id string, ts timestamp")
    path = str(tmp_path / "runs")
    for i in (1, 2, 3):
        kept = record_run(spark, path, run(i), keep=2)
    assert {r.run_id for r in kept.collect()} == {"r-1", "r-2"}
    per = spark.createDataFrame([("a", "accept"), ("b", "recall_miss")], "query_id string, diagnosis string")
    judged = spark.createDataFrame([("a", 0.5)], "query_id string, faithfulness double")
    write_report(str(tmp_path / "report"), per, judged, per.groupBy().count())
    assert spark.read.json(str(tmp_path / "report/failures")).count() == 1
    t = spark.sql("SELECT 'q' AS query_id, timestamp'2024-01-02 03:00:00' AS ts, named_struct('api_key', 'k', 'ok', 1) AS cfg, 's' AS secret_x")
    assert redact(t).columns == ["query_id", "ts", "cfg"] and redact(t).schema["cfg"].dataType.names == ["ok"]
    write_traces(str(tmp_path / "traces"), t, sanitize=True)
    assert spark.read.json(str(tmp_path / "traces")).head().cfg.ok == 1


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = [(f"d{i}", f"text {i} " * 50) for i in range(6)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(src)
    store = ChunkStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("doc_id string, text string").parquet(src)
    jobs.start_ingest(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    want = {(r.chunk_id, r.content) for r in docs_of(spark, rows)[1].collect()}
    assert {(r.chunk_id, r.content) for r in store.children().collect()} == want


def test_guard_and_names(spark):
    docs = spark.createDataFrame([(1, "xx the secret answer is forty two yy"), (2, "nothing here"), (3, "ok abc ok"), (4, "z" * 5000 + "the secret answer is forty")], "doc_id long, text string")
    facts = spark.createDataFrame([("the secret answer is forty two",), ("abc",), ("",)], "fact string")
    assert {r.doc_id for r in guard_hits(docs, facts).collect()} == {1, 3, 4}
    known = spark.createDataFrame([("a/b", 0), ("a/b/c", 1), ("k", 2)], "doc_id string, position int")
    wanted = spark.createDataFrame([(1, "a/b/c"), (2, "b/c"), (3, "see a/b"), (4, "nope")], "item int, name string")
    got = {r.item: r.doc_id for r in resolve_names(wanted, known).collect()}
    assert got[1] == "a/b/c" and got[2] == "a/b/c" and got[3] == "a/b" and got[4] is None


@pytest.mark.parametrize("control,noisy,pen,want", [(0.9, 0.88, 0.2, "PASS"), (0.9, 0.8, 0.2, "FAIL"), (0.9, 0.8, 0.05, "INCONCLUSIVE")])
def test_needle(spark, control, noisy, pen, want):
    rows = [("clean", 0.9, 0.5, False)] * 20 + [("control", control, 0.5, False)] * 20 + [("noisy", noisy, 0.4, i < pen * 20) for i in range(20)]
    df = spark.createDataFrame(rows, "stage string, recall double, mrr double, penetrated boolean")
    row = needle_verdict(df).head()
    assert row.verdict == want and abs(row.mrr_noisy - 0.4) < 1e-9
