"""Quotas and rounds of asks against a plain loop over documents."""

from pyspark.sql import functions as F

from quire.operators.generation import generate, numbered_items, quotas

SIZES = {"a": 6, "b": 1, "c": 9, "d": 0, "e": 3}
FAILS = {("a", "single", 1), ("c", "single", 0), ("c", "single", 1), ("c", "multi", 0), ("e", "single", 0), ("e", "single", 1), ("e", "single", 2)}


def plain(target, per_chunk, pairs):
    out, order = [], sorted(SIZES)
    for i, d in enumerate(order):
        budget = target // len(order) + (i < target % len(order))
        limit, got = budget - min(pairs, max(1, budget // 4)), 0
        for no in range(SIZES[d]):
            if got >= limit:
                break
            if (d, "single", no) not in FAILS:
                out += [(d, "single", no, k) for k in range(per_chunk)]
                got += per_chunk
        more = 0
        for no in range(SIZES[d] // 2):
            if more >= min(pairs, budget - got):
                break
            if (d, "multi", no) not in FAILS:
                out.append((d, "multi", no, 0))
                more += 1
    return [(f"x-{n:04d}", *row) for n, row in enumerate(out)]


def run(spark, target, per_chunk, pairs, **options):
    docs = spark.createDataFrame([(d,) for d in SIZES] + [(None,), ("a",)], "doc_id string")
    parents = spark.createDataFrame([(d, n, f"{d}{n}", "t") for d, k in SIZES.items() for n in range(k)], "doc_id string, parent_no int, chunk_id string, content string")
    bad = F.concat_ws(" ", "doc_id", "kind", "ask_no").isin([f"{a} {b} {c}" for a, b, c in FAILS])
    asked = generate(
        parents, quotas(docs, target, pairs), lambda asks: asks.withColumn("items", F.when(~bad, F.when(F.col("kind") == "single", per_chunk).otherwise(1)).cast("long")),
        per_chunk=per_chunk, pairs=pairs, **options,
    )
    return asked, [(r.query_id, r.doc_id, r.kind, r.ask_no, r.item_no) for r in numbered_items(asked, "x").orderBy("query_id").collect()]


def test_same_as_loop(spark):
    asked, got = run(spark, 23, 2, 2, max_failures=9)
    assert got == plain(23, 2, 2)
    pair = asked.where("kind = 'multi' AND doc_id = 'a' AND ask_no = 0").first()
    assert pair.chunk_ids == ["a0", "a1"] and pair.content == "t\n\n---\n\nt"
    assert run(spark, 2, 1, 2, max_failures=9)[1] == plain(2, 1, 2)


def test_failures_in_a_row_end_a_kind(spark):
    asked, got = run(spark, 15, 1, 1, max_failures=2)
    kinds = {(r.doc_id, r.kind, r.ask_no) for r in asked.collect()}
    assert ("c", "single", 1) in kinds and ("c", "single", 2) not in kinds and ("c", "multi", 1) in kinds
    assert not [g for g in got if g[1] == "e" and g[2] == "single"]


def test_nothing_to_ask(spark):
    assert run(spark, 0, 1, 2)[1] == []
