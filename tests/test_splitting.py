import random

import pytest
from pyspark.sql import functions as F

from brute import fences, split
from quire.functions.markdown import diagnose, fence_ranges, headings, strategy, table_ranges
from quire.functions.splitting import heading_sections, recursive_split
from quire.operators.chunking import child_chunks, chunk_seq, ingest, parent_chunks, with_quality


def random_text(rng):
    out = []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        words = " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 40)))
        if kind < 0.2:
            out.append("#" * rng.randint(1, 6) + " " + words[:20] + "\n")
        elif kind < 0.4:
            out.append("```py\n" + words.replace(" ", "\n") + "\n```\n\n")
        elif kind < 0.5:
            out.append("```\n" + "x" * rng.randint(1, 500) + "\n```\n")
        elif kind < 0.6:
            out.append("y" * rng.randint(50, 700))
        elif kind < 0.65:
            out.append("```\nnever closed\n")
        elif kind < 0.8:
            out.append(words + "。" + words + "，" + words + "\n")
        else:
            out.append(words + "\n\n")
    return "".join(out)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = [(i, random_text(rng)) for i in range(150)]
    rows += [(900, ""), (901, "short"), (902, "a\nb"), (903, "# only"), (904, "```\n" + "z" * 900 + "\n```\n\n" + "t " * 200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_fences(texts):
    rows, df = texts
    got = {r[0]: [tuple(x) for x in r[1]] for r in df.select("doc_id", fence_ranges(F.col("text"))).collect()}
    assert got == {i: fences(t) for i, t in rows}


@pytest.mark.parametrize("size,overlap", [(300, 50), (1200, 0), (80, 20)])
def test_recursive_split(texts, size, overlap):
    rows, df = texts
    got = {
        r["doc_id"]: [(p["content"], p["start"]) for p in r["pieces"]]
        for r in recursive_split(df, "text", size, overlap).select("doc_id", "pieces").collect()
    }
    for i, t in rows:
        assert got[i] == split(t, size, overlap), i


def test_split_of_documents_matches_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for r in recursive_split(docs, "text", 300, 50).select("text", "pieces").collect():
        assert [(p["content"], p["start"]) for p in r["pieces"]] == split(r["text"], 300, 50)


def test_heading_sections(spark):
    md = "intro\n\n# A\nbody\n## B\ntext\n```\n# not a heading\n```\n### Lone\n# C\nend"
    df = spark.createDataFrame([(md,)], "text string")
    rows = df.select(F.explode(heading_sections(F.col("text")))).select("col.*").collect()
    assert [(r.section_path, r.start) for r in rows] == [
        ([], 0),
        (["A"], md.index("# A")),
        (["A", "B"], md.index("## B")),
        (["C"], md.index("# C")),
    ]
    assert rows[2].content.endswith("\n\n### Lone\n")


def test_headings_and_quality(spark):
    rows = [
        (1, "# T\n\n## S\n\ntext\n\n### U\nmore", "structured_clear"),
        (2, "# T\n\n### jump\n\ntext", "flat_parent_child"),
        (3, "plain short", "flat_simple"),
        (4, "x" * 900, "flat_parent_child"),
        (5, "```\n# no\n```\n" + "y" * 900, "flat_parent_child"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, want string")
    out = df.select("id", "want", diagnose(F.col("text")).alias("q"), headings(F.col("text")).alias("h")).select(
        "*", strategy(F.col("q")).alias("got")
    )
    for r in out.collect():
        assert r.got == r.want, r
    first = out.where("id = 1").head()
    assert [(h.level, h.text, h.line_number) for h in first.h] == [(1, "T", 1), (2, "S", 3), (3, "U", 7)]
    assert first.q.heading_continuous and first.q.n_headings == 3


def test_table_ranges(spark):
    md = "a\n| x | y |\n|---|---|\n| 1 | 2 |\nb\n| z |"
    df = spark.createDataFrame([(md,)], "text string")
    got = df.select(table_ranges(F.col("text"))).head()[0]
    assert [(md[r.start : r.stop]) for r in got] == ["| x | y |\n|---|---|\n| 1 | 2 |\n", "| z |"]


def test_ingest_ids(spark):
    docs = spark.createDataFrame(
        [("a", "# H\n\n" + "word " * 300 + "\n\n## I\n\nbody"), ("b", "tiny text"), ("c", "w " * 1500)],
        "doc_id string, text string",
    )
    parents, children = ingest(docs)
    ids = {r.chunk_id for r in parents.collect()}
    assert {"a:p0", "a:p1", "b:0", "c:p0"} <= ids
    kids = children.collect()
    assert all(k.parent_id is None or k.chunk_id.startswith(k.parent_id + ":c") for k in kids)
    assert {k.parent_id for k in kids if k.parent_id} <= ids
    assert [k.section_path for k in kids if k.parent_id == "a:p1"] == [["H", "I"]]


def test_large_section_is_cut_with_section_relative_starts(spark):
    docs = spark.createDataFrame([("a", "# H\n\ntext\n\n## I\n\n" + "word " * 2500)], "doc_id string, text string")
    q = with_quality(docs)
    rows = parent_chunks(q.withColumn("strategy", F.lit("structured_clear"))).orderBy("parent_no").collect()
    assert [r.chunk_id for r in rows] == ["a:p0", "a:p1", "a:p2", "a:p3"]
    assert all(len(r.content) <= 8000 for r in rows)
    assert rows[1].start_char_index == 0 and rows[2].start_char_index == len(rows[1].content)
    assert child_chunks(parent_chunks(q)).count() > 0


def test_chunk_seq(spark):
    df = spark.createDataFrame([("d:p3",), ("d:p3:c12",), ("d:7",), ("plain",)], "c string")
    assert [r[0] for r in df.select(chunk_seq(F.col("c"))).collect()] == [3, 12, 7, 0]
