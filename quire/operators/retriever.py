"""One retrieval plan: fusion at parent level, auto-merge, reranking, fetch; and the metrics of its child hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import fusion
from quire.session import materialize
from quire.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Retrieval:
    """``top``: the answer, ranked parents with content. ``recalled``: every fused (query_id, key), before any cut."""

    top: DataFrame
    recalled: DataFrame


def retrieve(
    queries: DataFrame,
    dense: DataFrame,
    sparse: DataFrame,
    parents: DataFrame,
    k: int = DEFAULTS.top_k,
    scorer: Callable[[Column, Column], Column] | None = None,
    cache: DataFrame | None = None,
    cfg: Settings = DEFAULTS,
) -> Retrieval:
    """Fuse child hits (query_id, key, seq, score, rank) with parent hits (query_id, key, rank) and rank the parents.

    ``queries`` is (query_id, query), ``parents`` (chunk_id, content, ...). Without a ``scorer`` the fused order is the
    answer. With one, ``cfg.merge_boost`` above 0 first raises parents hit by enough children, then the best
    ``cfg.rerank_top_k`` are scored with their query. Queries without a hit and parents that are not in the store give no
    row. Every group below is the candidates of one query; texts are fetched for ranked rows only.
    """
    fused = materialize(fusion.rrf(dense, sparse, cfg), "fused")  # feeds the answer and the recalled keys
    recalled = fused.select("query_id", "key")
    if scorer is None:
        return Retrieval(fusion.attach(fusion.ranked(fused, k), parents), recalled)
    merged = fused
    if cfg.merge_boost > 0:
        merged = fusion.auto_merge(fused, dense, cfg.merge_boost, cfg.merge_min_child_hits)
    pool = fusion.ranked(merged, cfg.rerank_top_k).withColumnRenamed("rank", "rrf_rank")
    candidates = fusion.attach(pool, parents).join(queries.select("query_id", "query"), "query_id")
    return Retrieval(fusion.rerank(candidates, scorer, k, cache=cache).drop("query"), recalled)


def child_metrics(children: DataFrame, expected: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """``child_hit_at_k`` and ``child_recall_at_k`` per query with labelled children.

    ``children`` is (query_id, child_id, rank), ``expected`` (query_id, child_id); doubled labels count once. Only the first
    2 * ``candidate_k`` hits count, so runs with a larger pool stay comparable. Without a hit both are 0.
    """
    first = children.where(F.col("rank") <= 2 * cfg.candidate_k).select("query_id", "child_id").distinct()
    labels = expected.select("query_id", "child_id").distinct()
    marked = labels.join(first.withColumn("_found", F.lit(1)), ["query_id", "child_id"], "left")
    per = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("_found").alias("found"))
    return per.select(
        "query_id",
        "n_expected",
        (F.col("found") > 0).cast("int").alias("child_hit_at_k"),
        (F.col("found") / F.col("n_expected")).alias("child_recall_at_k"),
    )
