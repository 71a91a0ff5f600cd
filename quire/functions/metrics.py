"""Retrieval metrics of one ranked list, given as the array of its relevance grades (0 = not relevant)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import safe_ratio


def _top(grades: Column, k: int) -> Column:
    return F.slice(grades, 1, k)


def hits(grades: Column, k: int) -> Column:
    return F.size(F.filter(_top(grades, k), lambda g: g > 0))


def recall_at_k(grades: Column, n_relevant: Column, k: int) -> Column:
    return safe_ratio(hits(grades, k), n_relevant)


def precision_at_k(grades: Column, k: int) -> Column:
    """Divided by k, also when fewer rows came back."""
    return hits(grades, k) / F.lit(float(k))


def hit_at_k(grades: Column, k: int) -> Column:
    return (hits(grades, k) > 0).cast("int")


def mrr(grades: Column, k: int) -> Column:
    return F.aggregate(
        F.transform(_top(grades, k), lambda g, i: F.when(g > 0, 1.0 / (i + 1)).otherwise(0.0)),
        F.lit(0.0),
        lambda a, x: F.greatest(a, x),
    )


def average_precision(grades: Column, n_relevant: Column, k: int) -> Column:
    zero = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("found"), F.lit(0.0).alias("total"))

    def step(acc: Column, g: Column) -> Column:
        rank = acc["rank"] + 1
        found = acc["found"] + (g > 0).cast("int")
        gain = F.when(g > 0, found.cast("double") / rank).otherwise(0.0)
        return F.struct(rank.alias("rank"), found.alias("found"), (acc["total"] + gain).alias("total"))

    return safe_ratio(F.aggregate(_top(grades, k), zero, step, lambda acc: acc["total"]), n_relevant)


def dcg_at_k(grades: Column, k: int) -> Column:
    gains = F.transform(
        _top(grades, k),
        lambda g, i: F.when(g > 0, (F.pow(F.lit(2.0), g) - 1) / F.log2((i + 2).cast("double"))).otherwise(0.0),
    )
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def ndcg_at_k(grades: Column, ideal: Column, k: int) -> Column:
    """``ideal`` holds the best grades of the query, descending."""
    return safe_ratio(dcg_at_k(grades, k), F.nullif(dcg_at_k(ideal, k), F.lit(0.0)))
