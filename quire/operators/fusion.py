"""Rank fusion at parent level, auto-merge of adjacent hits, reranking and context building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import context_text
from quire.session import materialize
from quire.settings import DEFAULTS, Settings

#: Ranked rows (a few numbers and an id each) that may be sent to the store they are fetched from.
FETCH_ROWS = 200_000


def rrf(dense: DataFrame, sparse: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion: query_id, key, rrf_score, first_list, first_rank.

    Inputs are (query_id, key, rank). Every hit adds 1 / (k + rank), so several children of one parent add up.
    """
    hits = dense.select("query_id", "key", "rank", F.lit(0).alias("list_no")).unionByName(
        sparse.select("query_id", "key", "rank", F.lit(1).alias("list_no"))
    )
    first = F.min(F.struct("list_no", "rank"))
    return (
        hits.groupBy("query_id", "key")
        .agg(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))).alias("rrf_score"), first.alias("_first"))
        .select(
            "query_id",
            "key",
            "rrf_score",
            F.col("_first.list_no").alias("first_list"),
            F.col("_first.rank").alias("first_rank"),
        )
    )


def ranked(fused: DataFrame, k: int, score: str = "rrf_score") -> DataFrame:
    """Top-k per query with ``rank``; ties keep the order in which a key was first seen."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round(score, 9)), "first_list", "first_rank", "key"
    )
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def kept_hits(hits: Column) -> Column:
    """Number of hits kept greedily by score: a hit next to a kept one (sequence difference 1) is dropped.

    ``hits`` is an array of structs (score, seq, ord); ``ord`` decides between equal scores.
    """
    best_first = F.array_sort(
        hits,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .when(a["ord"] < b["ord"], -1)
        .when(a["ord"] > b["ord"], 1)
        .otherwise(0),
    )
    return F.size(
        F.aggregate(
            best_first,
            F.array().cast("array<bigint>"),
            lambda kept, h: F.when(
                F.exists(kept, lambda s: F.abs(s - h["seq"].cast("bigint")) == 1), kept
            ).otherwise(F.concat(kept, F.array(h["seq"].cast("bigint")))),
        )
    )


def parent_hits(dense: DataFrame) -> DataFrame:
    """Kept hits per (query, parent): query_id, key, kept. A group holds at most the candidates of one query."""
    return dense.groupBy("query_id", "key").agg(
        kept_hits(F.collect_list(F.struct("score", "seq", F.col("rank").alias("ord")))).alias("kept")
    )


def auto_merge(
    fused: DataFrame, dense: DataFrame, boost: Column | float, min_hits: int = DEFAULTS.merge_min_child_hits
) -> DataFrame:
    """Multiply the score of parents hit by enough non-adjacent children. ``dense`` is (query_id, key, score, seq, rank)."""
    factor = F.lit(boost) if isinstance(boost, (int, float)) else boost
    hits = parent_hits(dense)
    return (
        fused.join(hits, ["query_id", "key"], "left")
        .withColumn(
            "rrf_score",
            F.when((F.coalesce("kept", F.lit(0)) >= min_hits) & (factor > 0), F.col("rrf_score") * factor).otherwise(
                F.col("rrf_score")
            ),
        )
        .drop("kept")
    )


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column],
    k: int,
    query: str = "query",
    text: str = "content",
    cache: DataFrame | None = None,
) -> DataFrame:
    """Order candidates by a pair score: adds ``rerank_score``, ``rank``, ``fallback``.

    ``scorer`` maps (query text, candidate text) to a score column, for instance a pandas UDF around a model; a null
    marks a failure, and then the whole query keeps its fused order. A query with one candidate is passed through.
    ``cache`` (query_id, key, rerank_score) replaces scoring for the queries it knows; a candidate it lacks scores 0.
    """
    per_query = Window.partitionBy("query_id")
    fresh = scorer(F.col(query), F.col(text))
    base = candidates
    if cache is None:
        scored = base.withColumn("rerank_score", fresh.cast("double"))
    else:
        known = cache.select("query_id").distinct().withColumn("_known", F.lit(True))
        base = base.join(known, "query_id", "left").join(
            cache.select("query_id", "key", F.col("rerank_score").alias("_cached")), ["query_id", "key"], "left"
        )
        scored = base.withColumn(
            "rerank_score",
            F.when(F.col("_known"), F.coalesce("_cached", F.lit(0.0))).otherwise(fresh.cast("double")),
        ).drop("_known", "_cached")
    flagged = scored.withColumn("_n", F.count(F.lit(1)).over(per_query)).withColumn(
        "fallback",
        (F.col("_n") > 1) & (F.max(F.col("rerank_score").isNull().cast("int")).over(per_query) == 1),
    )
    effective = F.when(F.col("fallback") | (F.col("_n") <= 1), F.lit(0.0)).otherwise(F.col("rerank_score"))
    order = per_query.orderBy(F.desc(F.round(effective, 9)), "rrf_rank")
    return flagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_n")


def attach(rows: DataFrame, parents: DataFrame, key: str = "key") -> DataFrame:
    """Fetch parents for ranked ids; an id without a parent is dropped.

    The ranked rows are few beside the store: up to ``FETCH_ROWS`` of them go to the store, so its texts stay in place.
    """
    rows = materialize(rows, "ranked")
    few = F.broadcast(rows) if rows.count() <= FETCH_ROWS else rows
    return parents.withColumnRenamed("chunk_id", key).join(few, key)


def contexts(rows: DataFrame) -> DataFrame:
    """Answer context per query from ranked rows with title, source and content; at most k rows per query."""
    chunks = F.array_sort(F.collect_list(F.struct("rank", "title", "source", "content")))
    return rows.groupBy("query_id").agg(context_text(chunks).alias("context"))
