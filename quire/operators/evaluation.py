"""Evaluation of ranked results: per-query metrics, diagnosis, grouped means, judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.settings import DEFAULTS, Settings

METRICS = ("recall_at_k", "precision_at_k", "hit_at_k", "mrr", "map_at_k", "ndcg_at_k")
DIAGNOSES = ("recall_miss", "file_miss", "ranking_miss", "low_precision", "accept")
SCORES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
VERDICTS = ("pass", "partial", "fail", "error")


def label_totals(relevance: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
    """Label counts and best grades per query from (query_id, key, grade) rows."""
    grades = F.slice(F.sort_array(F.collect_list("grade"), asc=False), 1, k)
    return relevance.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), grades.alias("ideal"))


def per_query(hits: DataFrame, totals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Metrics per query.

    ``hits`` is (query_id, rank, grade, file_hit), at most ``candidate_k`` rows per query; ``totals`` has one row per
    query with n_relevant and ideal. The first ``top_k`` ranks are the answer, the others are candidates only.
    """
    k = cfg.top_k
    lists = hits.where(F.col("rank") <= cfg.candidate_k).groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", F.coalesce("grade", F.lit(0)).alias("grade")))).alias("by_rank"),
        F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("file_hit").cast("int"))), F.lit(0)).alias("any_file"),
    )
    g, n = F.col("grades"), F.col("n_relevant")
    places = F.array(*[F.lit(r) for r in range(1, cfg.candidate_k + 1)])
    return totals.join(lists, "query_id", "left").withColumn(
        "grades", F.transform(places, lambda r: F.coalesce(F.try_element_at("by_rank", r), F.lit(0)))
    ).select(
        *totals.columns,
        M.recall_at_k(g, n, k).alias("recall_at_k"),
        M.precision_at_k(g, k).alias("precision_at_k"),
        M.hit_at_k(g, k).alias("hit_at_k"),
        M.mrr(g, k).alias("mrr"),
        M.average_precision(g, n, k).alias("map_at_k"),
        M.ndcg_at_k(g, F.col("ideal"), k).alias("ndcg_at_k"),
        M.hit_at_k(g, cfg.candidate_k).alias("candidate_hit"),
        (F.coalesce("any_file", F.lit(0)) == 0).alias("no_file"),
    )


def diagnose(rows: DataFrame, has_files: Column, factor: float = 1.5) -> DataFrame:
    """Add ``diagnosis``. A hit whose noise is far above the median noise of its category has low precision."""
    noise = 1.0 - F.col("precision_at_k")
    # Noise takes at most top_k + 1 values, so an exact median keeps a tiny state whatever the category size.
    base = rows.groupBy("category").agg(F.median(noise).alias("_base"))
    first = (
        F.when(F.col("hit_at_k") == 0, F.when(F.col("candidate_hit") == 1, "ranking_miss")
               .when(has_files & F.col("no_file"), "file_miss").otherwise("recall_miss"))
        .when((F.col("_base") > 0) & (noise > F.col("_base") * factor), "low_precision")
        .otherwise("accept")
    )
    return rows.join(base, "category", "left").withColumn("diagnosis", first).drop("_base")


def aggregates() -> list[Column]:
    child = F.col("child_annotated")
    return [
        F.count(F.lit(1)).alias("num_queries"),
        *[F.avg(m).alias(m) for m in METRICS],
        F.sum(child.cast("int")).alias("num_child_annotated"),
        *[
            F.coalesce(F.avg(F.when(child, F.col(c))), F.lit(0.0)).alias(c)
            for c in ("child_hit_at_k", "child_recall_at_k")
        ],
        *[F.count_if(F.col("diagnosis") == d).alias(d) for d in DIAGNOSES],
    ]


def grouped(rows: DataFrame) -> DataFrame:
    """Overall, per category and per difficulty means in one pass; ``level`` tells which."""
    sets = rows.groupingSets([["category"], ["difficulty"], []], "category", "difficulty")
    level = F.grouping_id("category", "difficulty")
    return sets.agg(level.alias("_g"), *aggregates()).withColumn(
        "level",
        F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "difficulty").otherwise("all"),
    ).drop("_g")


def verdict(scores: Column) -> Column:
    """pass, partial or fail by the share of present scores that reach 0.75; fail without any score."""
    present = F.filter(scores, lambda s: s.isNotNull())
    ratio = F.try_divide(F.size(F.filter(present, lambda s: s >= 0.75)), F.size(present))
    return F.when(ratio >= 0.75, "pass").when(ratio >= 0.5, "partial").otherwise("fail")


def judge_means(judged: DataFrame, nulls_as_zero: bool = True) -> DataFrame:
    """Means over rows with a faithfulness score. A missing other score counts as 0, or is skipped."""
    valid = judged.where(F.col("faithfulness").isNotNull())
    cols = [
        F.avg(F.coalesce(c, F.lit(0.0)) if nulls_as_zero else F.col(c)).alias(f"{c}_avg") for c in SCORES
    ]
    return valid.agg(F.count(F.lit(1)).alias("num_valid"), *cols)


def verdict_counts(judged: DataFrame) -> DataFrame:
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("error")
    return judged.agg(
        F.count(F.lit(1)).alias("num_total"),
        *[F.count_if(known == v).alias(f"verdict_{v}") for v in VERDICTS],
        F.count_if(F.col("judge_error").isNotNull()).alias("judge_errors"),
        F.count_if(F.col("generator_error").isNotNull()).alias("generator_errors"),
    )


def calibration(judged: DataFrame) -> DataFrame:
    """Mean judge score of good and spoiled answers and whether the judge tells them apart."""
    row = judged.agg(
        F.avg(F.when(F.col("is_good"), F.col("score"))).alias("mean_good"),
        F.avg(F.when(~F.col("is_good"), F.col("score"))).alias("mean_bad"),
        F.avg(F.col("parse_error").cast("double")).alias("parse_error_ratio"),
    ).withColumn("diff", F.col("mean_good") - F.col("mean_bad"))
    return row.withColumn(
        "passed",
        (F.col("mean_good") >= 0.75) & (F.col("mean_bad") <= 0.5) & (F.col("diff") >= 0.5) & (F.col("parse_error_ratio") <= 0.05),
    )
