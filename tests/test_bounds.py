"""Plans and steps whose memory and time must not grow faster than their input."""

import glob
import random

import numpy as np
from pyspark.sql import functions as F

from quire.functions.splitting import recursive_split
from quire.operators import ordered, search
from quire.operators import quality as Q
from quire.operators.corpus import containing, resolve_names
from quire.plans import streams
from quire.plans.common import table
from quire.session import shared_dir


def final_plan(df) -> str:
    """The plan as it was run, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_pieces_are_not_broadcast(spark):
    known = spark.range(50).select(F.concat(F.lit("https://host/"), "id").alias("doc_id"), F.col("id").alias("position"))
    wanted = known.select(F.col("position").alias("item"), F.concat(F.lit("see "), "doc_id").alias("name"))
    found = resolve_names(wanted, known)
    assert "Broadcast" not in final_plan(found)
    got = {r.item: r.doc_id for r in found.collect()}
    assert got[7] == "https://host/7" and got[42] == "https://host/4"  # the first known id that the name holds


def test_ranges_are_not_searched_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 1)
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 400).alias("v"), F.lit(1).alias("c"))
    run = ordered.cumulative(rows, ["g"], "v", "c")
    assert "_bounds" not in final_plan(run)  # a list of all ranges, looked through for every row
    for g in (0, 1):
        got = [(r.cum, r.total) for r in run.where(F.col("g") == g).orderBy("v").collect()]
        assert got == [(i + 1, 200) for i in range(200)]


def test_pair_sums_are_spread_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_PAIRS", 10)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word"), "id").alias("text"))
    asks = spark.createDataFrame([(1, "common word7"), (2, "common")], "query_id int, query string")
    scores = search.bm25_scores(search.postings(docs), search.query_terms(asks))
    assert "hashpartitioning(doc_id" in final_plan(scores) and scores.rdd.getNumPartitions() == 12  # 120 pairs, ten a task
    assert scores.count() == 120


def test_filled_lists_join_no_scores_by_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "common").otherwise("rare").alias("text"))
    asks = spark.createDataFrame([(1, "common"), (2, "rare"), (3, "common rare"), (4, "none")], "query_id int, query string")
    seen = []
    plain = search._unmatched
    search._unmatched = lambda index, scores, *rest: seen.append(scores.columns) or plain(index, scores, *rest)
    try:
        top = search.bm25_topk(search.postings(docs), search.query_terms(asks), 5, match_only=False, queries=asks).collect()
    finally:
        search._unmatched = plain
    assert "range" in seen[0]
    got = {q: [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3, 4)}
    assert got == {1: [1, 2, 3, 5, 6], 2: [0, 4, 8, 12, 16], 3: [0, 4, 8, 12, 16], 4: [0, 1, 2, 3, 4]}


def test_scores_are_held_in_pieces(spark, monkeypatch):
    widest = []

    class Watched(search._Best):
        def add(self, scores, ids):
            widest.append(scores.size)
            super().add(scores, ids)

    rnd = np.random.default_rng(3)
    rows, asks = rnd.integers(-3, 4, (500, 4)).astype(float), rnd.integers(-3, 4, (20, 4)).astype(float)  # many equal scores
    monkeypatch.setattr(search, "PIECE_SCORES", 640)
    best = Watched(20, 6)
    search.scan_pieces(best, asks, rows, np.arange(500))
    best.settle()
    assert max(widest) <= 640
    for q in range(20):
        want = sorted(zip(-(rows @ asks[q]), range(500)))[:6]
        assert [(-s, i) for s, i in zip(best.score[best.query == q], best.ids[best.query == q])] == want


def test_ingest_files_follow_the_input(spark, tiny):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/ingest-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
    try:
        splits = table(spark, tiny, "documents").select("doc_id", "text").rdd.getNumPartitions()
        assert streams.stream_ingest(spark, tiny).count() == table(spark, tiny, "documents").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/ingest-*")) - before
    assert splits > 3 and len(glob.glob(f"{folder}/in/part-*")) >= splits


def test_containing_equals_a_plain_search(spark):
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("abé") for _ in range(rnd.choice([0, 3, 40, 300, 700])))) for i in range(120)] + [(900, None)]
    for width in (1, 2, 5, 9, 20):
        long = [t for _, t in texts if t and len(t) >= width]
        cut = [t[i : i + width] for t in rnd.sample(long, 8) for i in (0, len(t) - width, rnd.randrange(len(t) - width + 1))]
        needles = spark.createDataFrame([(n,) for n in [*cut, "b" * width, "short" * 9]], "needle string")
        got = {r[0] for r in containing(spark.createDataFrame(texts, "doc_id int, text string"), needles, "doc_id", "text", "needle", width).collect()}
        assert got == {i for i, t in texts if t and any(n in t for n in [*cut, "b" * width])}, width


def test_only_pieces_of_needles_are_cut_into_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "x" * 70 + "needle of twenty one" + "y" * 9)], "doc_id int, text string")
    found = containing(docs, spark.createDataFrame([("needle of twenty one",)], "needle string"), "doc_id", "text", "needle", 20)
    assert [r.doc_id for r in found.collect()] == [2]
    assert "array_distinct" not in final_plan(found)  # all windows of a text, as before


def test_pair_counts_equal_plain_sets(spark):
    def plain(text):
        squashed = " ".join((text or "").split())
        return {squashed[i : i + 2] for i in range(len(squashed) - 1)}

    texts = [("abab  c", "ab c"), ("", "xy"), ("a", ""), ("é\U0001f600é\U0001f600x", "\U0001f600é y"), ("same text", "same text")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)] + [(9, None, "xy")], "id int, parsed string, gold string")
    found = Q.text_fidelity(rows)
    assert found.columns == ["id", "parsed", "gold", "text_recall", "text_precision"]
    got = {r.id: (r.text_recall, r.text_precision) for r in found.collect()}
    for i, (p, g) in enumerate(texts):
        a, b = plain(p), plain(g)
        want = (len(a & b) / len(b) if b else float(not a), len(a & b) / len(a) if a else 1.0)
        assert got[i] == want, i
    assert got[9] == (0.0, 0.0)


def test_all_separators_are_one_step_of_the_plan(spark):
    texts = [(1, "ab " * 400), (2, "x" * 50 + " " + "yz " * 30 + "\n\n\nend"), (3, "é\U0001f600 " * 200), (4, "")]
    rows = recursive_split(spark.createDataFrame(texts, "i int, t string"), "t", 20)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 8  # a step for every separator writes each row as often
    got = {r.i: r.pieces for r in rows.collect()}
    for i, t in texts:
        assert "".join(p.content for p in got[i]) == t and all(t[p.start : p.start + len(p.content)] == p.content for p in got[i])
    assert {len(p.content) for p in got[1]} == {18, 12} and [len(p.content) for p in got[2]][:4] == [20, 20, 11, 18]
    assert {len(p.content) for p in got[3]} == {18, 6}
