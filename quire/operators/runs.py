"""Run history: paired comparison of two runs with a signed-rank test, and gates on metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.ordered import cumulative
from quire.session import ship_by_value
from quire.settings import DEFAULTS, Settings

ship_by_value(__name__)


def paired(run_a: DataFrame, run_b: DataFrame, metrics: list[str]) -> DataFrame:
    """Pairs of values per metric: (metric, query_id, a, b), where both runs know the query under the same signature.

    Runs are (query_id, signature, metric columns). A pair with a missing side is left out.
    """
    def long(run: DataFrame, name: str) -> DataFrame:
        rows = run.where(F.coalesce("signature", F.lit("")) != "").select(
            "query_id", "signature", *[F.col(m).cast("double").alias(m) for m in metrics]
        )
        return rows.unpivot(["query_id", "signature"], metrics, "metric", name).where(F.col(name).isNotNull())

    return long(run_a, "a").join(long(run_b, "b"), ["query_id", "signature", "metric"]).drop("signature")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Sums for the signed-rank test per metric: n (non-zero), w_plus, w_minus, tie_term, zeros.

    Differences are rounded to 12 decimals so that equal steps tie. Equal sizes are merged before ranking.
    """
    d = pairs.withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    zeros = d.groupBy("metric").agg(F.count_if(F.col("d") == 0).alias("zeros"))
    counts = (
        d.where("d <> 0")
        .groupBy("metric", F.abs("d").alias("size"))
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("pos"))
    )
    run = cumulative(counts, ["metric"], "size", "c")
    rank = F.col("cum") - F.col("c") + (F.col("c") + 1) / 2.0
    sums = run.groupBy("metric").agg(
        F.max("total").alias("n"),
        F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum((F.col("c") - F.col("pos")) * rank).alias("w_minus"),
        F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("tie_term"),
    )
    return zeros.join(sums, "metric", "left").fillna(0)


def _p_value(n: float, w_plus: float, w_minus: float, tie_term: float, zeros: float) -> float:
    n = int(n)
    if n == 0:
        return 1.0
    low = min(w_plus, w_minus)
    if n <= 50 and tie_term == 0 and zeros == 0:
        # Exact null distribution: number of subsets of 1..n for every rank sum.
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + ways[:-i].copy()
        return float(min(1.0, 2.0 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt((n * (n + 1.0) * (2.0 * n + 1.0) - 0.5 * tie_term) / 24.0)
    if spread == 0:
        return 1.0
    return math.erfc(abs(low - n * (n + 1.0) / 4.0) / spread / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(
    n: pd.Series, w_plus: pd.Series, w_minus: pd.Series, tie_term: pd.Series, zeros: pd.Series
) -> pd.Series:
    """Two-sided p from the sums of one metric: exact for up to 50 untied pairs, else the normal form."""
    return pd.Series([_p_value(*row) for row in zip(n, w_plus, w_minus, tie_term, zeros)])


def holm(rows: DataFrame, p: str = "p_raw") -> DataFrame:
    """Step-down correction p * (N - rank + 1), at most 1, without a running maximum. One row per metric."""
    everything = Window.partitionBy(F.lit(0))  # one row per metric, a bounded set
    value = F.coalesce(F.col(p), F.lit(1.0))
    rank = F.row_number().over(everything.orderBy(value, "metric"))
    return rows.withColumn("p_value", F.least(F.lit(1.0), value * (F.count(F.lit(1)).over(everything) - rank + 1)))


def compare(run_a: DataFrame, run_b: DataFrame, metrics: list[str], comparable: bool = True, cfg: Settings = DEFAULTS) -> DataFrame:
    """Paired comparison: metric, n, a, b, delta, and p_value and significant where the sample allows a test."""
    pairs = paired(run_a, run_b, metrics)
    means = pairs.groupBy("metric").agg(F.count(F.lit(1)).alias("pairs"), F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn(
        "delta", F.col("b") - F.col("a")
    )
    if not comparable:
        return means.withColumn("p_value", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean"))
    tested = means.where(F.col("pairs") >= cfg.min_paired_samples).join(signed_ranks(pairs), "metric").withColumn(
        "p_raw", wilcoxon_p("n", "w_plus", "w_minus", "tie_term", "zeros")
    )
    corrected = holm(tested).select("metric", "p_value", (F.col("p_value") < cfg.alpha).alias("significant"))
    return means.join(corrected, "metric", "left")


def delta_only(summary_a: DataFrame, summary_b: DataFrame) -> DataFrame:
    """Deltas of summary scalars both runs have: (metric, a, b, delta)."""
    return summary_a.select("metric", F.col("value").alias("a")).join(
        summary_b.select("metric", F.col("value").alias("b")), "metric"
    ).withColumn("delta", F.col("b") - F.col("a"))


def metric_gate(current: DataFrame, rules: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Checks per rule. Rules are (metric, min, max, drop); values are (metric, value). A missing value fails."""
    rows = rules.join(current.select("metric", "value"), "metric", "left")
    limit = (
        F.col("value").isNotNull()
        & (F.col("min").isNull() | (F.col("value") >= F.col("min")))
        & (F.col("max").isNull() | (F.col("value") <= F.col("max")))
    )
    if baseline is None:
        return rows.withColumn("delta", F.lit(None).cast("double")).withColumn("passed", F.coalesce(limit, F.lit(False)))
    rows = rows.join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    delta = F.round(F.col("base") - F.col("value"), 6)
    ok = F.col("drop").isNull() | F.coalesce(delta <= F.col("drop"), F.lit(False))
    return rows.withColumn("delta", delta).withColumn("passed", F.coalesce(limit & ok, F.lit(False))).drop("base")


def unique_run_id(wanted: Column, taken: int) -> Column:
    """Run id with a counting suffix when it is already in use."""
    return F.when(F.lit(taken) == 0, wanted).otherwise(F.concat(wanted, F.lit(f"-{taken}")))
