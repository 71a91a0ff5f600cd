"""Run reports: flat metrics, comparison flags, live deltas, choices and samples for calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Per-query columns a run keeps; texts stay with the trace.
PER_QUERY = (
    "recall_at_k", "precision_at_k", "hit_at_k", "mrr", "map_at_k", "ndcg_at_k", "child_hit_at_k", "child_recall_at_k",
    "faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness",
    "verdict", "retrieve_ms", "generate_ms", "diagnosis",
)
QUESTION_TYPES = ("factual", "comparison", "conditional", "multi_hop")
LAYER2 = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")


def per_query(rows: DataFrame, key: str = "query_id") -> DataFrame:
    return rows.select(key, *[c for c in PER_QUERY if c in rows.columns])


def scalars(summary: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row summary as (metric, value); text columns are left out."""
    names = [c for c, t in summary.dtypes if t not in ("string", "boolean") and not t.startswith(("array", "map", "struct"))]
    wide = summary.select(*[F.col(c).cast("double").alias(prefix + c) for c in names])
    return wide.unpivot([], [F.col(f"`{prefix}{c}`") for c in names], "metric", "value").where("value IS NOT NULL")


def counted(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Counts by value as (metric, value), with the value in the metric's name; empty values are not counted."""
    named = rows.where(F.coalesce(F.col(column), F.lit("")) != "")
    return named.groupBy(F.concat(F.lit(prefix), column).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def section(metric: Column) -> Column:
    """The part of a comparison a metric is shown in."""
    return (
        F.when(metric.startswith("attribution."), "attribution")
        .when(metric.startswith("cost."), "cost")
        .when(metric.startswith("verdict.") | metric.isin(*LAYER2), "layer2")
        .when(metric.isin("retrieve_ms", "generate_ms") | metric.startswith("stage_"), "latency")
        .otherwise("layer1")
    )


def compare_flags(run_a: DataFrame, run_b: DataFrame, corpus_a: str, corpus_b: str, least: int = 6) -> DataFrame:
    """matched, total_a, total_b, alignable, comparable and degenerated of two runs (query_id, signature)."""
    a = run_a.select("query_id", F.nullif("signature", F.lit("")).alias("s"), F.lit(1).alias("in_a"))
    b = run_b.select("query_id", F.nullif("signature", F.lit("")).alias("t"), F.lit(1).alias("in_b"))
    row = a.join(b, "query_id", "full").agg(
        F.count_if(F.col("s") == F.col("t")).alias("matched"), F.count("in_a").alias("total_a"), F.count("in_b").alias("total_b")
    )
    return row.select(
        "*", (F.col("matched") > 0).alias("alignable"), F.lit(corpus_a == corpus_b).alias("comparable"), (F.col("matched") < least).alias("degenerated")
    )


def live_delta(current: DataFrame, previous: DataFrame, fields: list[str]) -> DataFrame:
    """Mean change per field over the queries of both runs, where both values are known: (metric, delta, matching)."""
    old = previous.select("query_id", *[F.col(c).alias(f"_{c}") for c in fields])
    both = current.select("query_id", *fields).join(old, "query_id")
    row = both.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.col(c) - F.col(f"_{c}")).alias(c) for c in fields])
    return row.unpivot("_n", fields, "metric", "delta").select("metric", "delta", F.col("_n").alias("matching")).where("delta IS NOT NULL")


def best_setting(grid: DataFrame, setting: str, value: str = "recall_at_k") -> DataFrame:
    """The row with the highest value, the smallest setting among equals."""
    first = F.max_by(F.struct(*[F.col(c) for c in grid.columns]), F.struct(F.col(value), -F.col(setting)))
    return grid.agg(first.alias("_b")).select("_b.*")


def top_reasons(rows: DataFrame, group: list[str], reason: str, k: int = 5) -> DataFrame:
    """The most frequent reasons per group: count first, then name."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*group, reason).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), reason)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def backend_stats(rows: DataFrame, group: str, ok: Column, reasons: dict[str, Column]) -> DataFrame:
    """Runs, successes and failure counts per backend."""
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("success_rate"),
        *[F.count_if(c).alias(name) for name, c in reasons.items()],
    )


def subset_union(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several subsets in one frame with the subset's name."""
    out = None
    for name, rows in results.items():
        named = rows.withColumn("subset", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def of_subset(records: DataFrame, items: DataFrame, key: str = "query_id") -> DataFrame:
    return records.join(items.select(key).distinct(), key, "left_semi")


def seeded_slice(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows of an order that depends on the seed only; a larger slice keeps the rows of a smaller one."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def questions(payload: Column) -> Column:
    """Questions of a model's JSON reply: query, reference_facts, question_type; blanks dropped, unknown types factual."""
    fields = ("query", "question", "reference_facts", "expected_answer", "question_type")
    schema = "struct<questions:array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>>"

    def first(*values: Column) -> Column:
        return F.trim(F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("")))

    def item(q: Column) -> Column:
        kind = F.lower(first(q["question_type"]))
        return F.struct(
            first(q["query"], q["question"]).alias("query"),
            first(q["reference_facts"], q["expected_answer"]).alias("reference_facts"),
            F.when(kind.isin(*QUESTION_TYPES), kind).otherwise("factual").alias("question_type"),
        )

    found = F.coalesce(F.from_json(payload, schema)["questions"], F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"))
    return F.filter(F.transform(found, item), lambda q: q["query"] != "")


def swapped(answer: Column, swaps: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Terms replaced in the given order, and whether any occurred when its turn came."""
    text, hit = answer, F.lit(False)
    for old, new in swaps:
        hit = hit | F.contains(text, F.lit(old))
        text = F.replace(text, F.lit(old), F.lit(new))
    return text, hit


def wrong_chunks(store: DataFrame, correct: DataFrame, n: int = 5) -> DataFrame:
    """Per query the first ``n`` chunks of the store that are not among its correct ones: (query_id, chunk_id, place).

    A query can only pass over its own chunks, so a prefix of the store as long as the longest list and ``n`` is enough.
    """
    longest = correct.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    head = store.select("chunk_id").orderBy("chunk_id").limit(n + longest)
    ids = [r[0] for r in head.collect()]
    pool = correct.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("chunk_id"))
    rest = pool.join(correct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return rest.withColumn("place", place).where(F.col("place") <= n)


def gold_pairs(parsed: DataFrame, gold: DataFrame) -> DataFrame:
    """Parsed files (path, text) with the gold text of the same stem; files without gold are skipped."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    return parsed.withColumn("stem", stem).join(gold.select(stem.alias("stem"), F.col("text").alias("gold")), "stem")


def judge_context(chunks: Column) -> Column:
    """Numbered chunks (chunk_id, title, source, content) with their ids, for a judge to cite."""
    parts = F.transform(
        chunks,
        lambda c, i: F.concat(
            F.lit("[来源"), (i + 1).cast("string"), F.lit(" | chunk_id: "), c["chunk_id"], F.lit(" | 文档: "),
            F.coalesce(F.nullif(c["title"], F.lit("")), F.nullif(c["source"], F.lit("")), F.lit("未知来源")), F.lit("]\n"), c["content"],
        ),
    )
    return F.when(F.size(chunks) > 0, F.array_join(parts, "\n\n---\n\n")).otherwise("（无检索结果）")
