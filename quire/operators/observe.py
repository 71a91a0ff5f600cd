"""Trace analytics: stage timing, errors, cost, attribution of failures, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.ordered import percentiles
from quire.settings import DEFAULTS, Settings


def stage_report(durations: DataFrame) -> DataFrame:
    """Count, mean, p50 and p95 per stage over (stage, ms); a zero duration means the stage did not run."""
    ran = durations.where(F.col("ms") > 0)
    means = ran.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("ms"), 1).alias("avg_ms"))
    cuts = percentiles(ran, ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    return means.join(cuts, "stage").select(
        "stage", "runs", "avg_ms", F.round("p50", 1).alias("p50_ms"), F.round("p95", 1).alias("p95_ms")
    )


def retry_waste(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count_if("fallback").alias("rerank_fallback_count"),
        F.round(F.coalesce(F.sum(F.when(F.col("fallback"), F.col("rerank_ms"))), F.lit(0.0)), 1).alias("retry_wasted_ms"),
    )


def error_rollup(errors: DataFrame) -> DataFrame:
    """Occurrences and distinct queries per error code; an empty code is ``unknown``."""
    code = F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown"))
    return errors.groupBy(code.alias("error_code")).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("query_id").alias("queries")
    )


def error_queries(errors: DataFrame) -> DataFrame:
    """The queries behind each code as rows, each with its first time, so no code needs one long list."""
    code = F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown"))
    return errors.groupBy(code.alias("error_code"), "query_id").agg(F.min("ts").alias("first_seen"))


def cost_summary(calls: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Token, cost, cache and error totals over (kind, input_tokens, output_tokens, cache_hit, is_error, is_retry)."""
    def share(hit: Column, all_: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(hit.cast("double"), all_.cast("double")), F.lit(0.0)), 4)

    tin, tout = F.sum("input_tokens"), F.sum("output_tokens")
    llm = F.count_if(F.col("kind").isin("generator", "judge_faithfulness", "judge_quality"))
    return calls.agg(
        tin.alias("total_input_tokens"),
        tout.alias("total_output_tokens"),
        F.round(tin / 1000 * cfg.price_in_per_1k + tout / 1000 * cfg.price_out_per_1k, 6).alias("estimated_cost"),
        *[
            share(F.count_if((F.col("kind") == kind) & F.col("cache_hit")), F.count_if((F.col("kind") == kind) & F.col("cache_hit").isNotNull())).alias(name)
            for kind, name in (("generator", "generator_cache_hit_rate"), ("judge_quality", "judge_cache_hit_rate"))
        ],
        share(F.count_if("is_error"), llm).alias("error_rate"),
        F.count_if("is_retry").alias("retry_count"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_calls") for k in ("generator", "judge_faithfulness", "judge_quality")],
    )


#: Stages whose times stand in the summary of a run.
RUN_STAGES = ("retrieve", "generate", "judge_faithfulness", "judge_quality", "end_to_end")


def run_summary(calls: DataFrame, durations: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The whole cost and time summary of a run as one row.

    ``calls`` is as for ``cost_summary`` with ``error_type`` (of calls that failed) and ``parse_error``; ``durations`` is
    (stage, ms). Adds the 95th percentile of tokens per call, the rerank cache (null when it was never asked), parse
    errors, errors by type, and p50, p75, p95 of every stage; a stage without times has zeros. Percentiles of all
    series come from one pass over merged values.
    """
    asked = (F.col("kind") == "rerank") & F.col("cache_hit").isNotNull()
    more = calls.agg(
        F.round(F.try_divide(F.count_if(asked & F.col("cache_hit")).cast("double"), F.count_if(asked).cast("double")), 4).alias("rerank_cache_hit_rate"),
        F.count_if("parse_error").alias("parse_error_count"),
    )
    kinds = calls.where(F.col("is_error")).groupBy(F.coalesce("error_type", F.lit("unknown")).alias("_type")).agg(F.count(F.lit(1)).alias("_times"))
    tokens = calls.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("v")) for c in ("input_tokens", "output_tokens")]))
    )
    series = durations.where(F.col("stage").isin(*RUN_STAGES)).select(
        F.concat(F.lit("stage_"), F.col("stage")).alias("series"), F.col("ms").cast("double").alias("v")
    )
    cuts = percentiles(tokens.unionByName(series), ["series"], "v", {"p50": 0.5, "p75": 0.75, "p95": 0.95})
    base = cost_summary(calls, cfg).withColumnRenamed("generator_calls", "generator_llm_calls")
    # A handful of rows: one of each part, one per error type and one per series.
    rows = base.unionByName(more, allowMissingColumns=True).unionByName(kinds, allowMissingColumns=True)
    rows = rows.unionByName(cuts.select("series", "p50", "p75", "p95"), allowMissingColumns=True)

    def cut(name: str, p: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("series") == name, F.col(p))), F.lit(0.0)).alias(f"{name}_{p}")

    by_type = F.map_from_entries(F.collect_list(F.when(F.col("_type").isNotNull(), F.struct("_type", "_times"))))
    return rows.agg(
        *[F.max(c).alias(c) for c in (*base.columns, *more.columns)],
        by_type.alias("errors_by_type"),
        *[cut(c, "p95") for c in ("input_tokens", "output_tokens")],
        *[cut(f"stage_{s}", p) for s in RUN_STAGES for p in ("p50", "p75", "p95")],
    )


def missing(expected: Column, found: Column) -> Column:
    """Expected ids that were not found; order and duplicates stay."""
    return F.filter(expected, lambda x: ~F.array_contains(found, x))


def attribute(traces: DataFrame) -> DataFrame:
    """Failure type per query by the first rule that holds; queries without a failure have a null type.

    Columns used: fallback, retrieved, recalled, before_rerank, after_rerank, expected, verdict, judge_error,
    generator_error. All lists are bounded by the candidate pool of a query.
    """
    after = F.when(F.size("after_rerank") > 0, F.col("after_rerank")).otherwise(F.col("retrieved"))
    rows = traces.withColumn("_absent", missing(F.col("expected"), F.col("recalled"))).withColumn(
        "_dropped", missing(F.col("expected"), after)
    )
    judged_bad = (
        (F.coalesce("verdict", F.lit("")) == "error") | F.col("judge_error").isNotNull() | F.col("generator_error").isNotNull()
    )
    kind = (
        F.when(F.col("fallback"), "rerank_fallback")
        .when(F.size("retrieved") == 0, "empty_recall")
        .when(F.size("_absent") > 0, "recall_absent")
        .when(F.size("_dropped") > 0, "rerank_drop")
        .when(judged_bad, "generation_error")
    )
    n = F.size("expected")
    ratio = F.when(kind == "recall_absent", (n - F.size("_absent")) / n).when(
        kind == "rerank_drop", (n - F.size("_dropped")) / n
    )
    none = F.array().cast(traces.schema["expected"].dataType)
    return rows.select(
        "query_id",
        kind.alias("failure_type"),
        F.when(kind == "recall_absent", F.col("_absent")).when(kind == "rerank_drop", F.col("_dropped")).otherwise(none).alias("missing_ids"),
        F.when(kind == "rerank_drop", missing(F.col("_dropped"), F.col("before_rerank"))).otherwise(none).alias("pool_truncation"),
        ratio.alias("expected_hit_ratio"),
    )


def evidence_coverage(traces: DataFrame) -> DataFrame:
    """Expected ids found after recall and after rerank, and the stage that lost some."""
    after = F.when(F.size("after_rerank") > 0, F.col("after_rerank")).otherwise(F.col("retrieved"))
    recalled = F.size(F.array_intersect("expected", "recalled"))
    kept = F.size(F.array_intersect(F.col("expected"), after))
    return traces.where(F.size("expected") > 0).select(
        "query_id",
        F.size("expected").alias("expected"),
        recalled.alias("recalled"),
        kept.alias("after_rerank"),
        # The comparison uses the list as labelled, so a doubled label counts twice.
        F.when(recalled < F.size("expected"), "recall").when(kept < recalled, "rerank").alias("lost_stage"),
    )


def newest(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows (a retention limit), kept by per-task selection before one merge."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


# Fixed name parts of sensitive fields.
SENSITIVE = ("authorization", "api_key", "apikey", "token", "password", "secret", "credential")


def redact(df: DataFrame) -> DataFrame:
    """Drop columns and nested struct fields whose name looks sensitive."""
    def keep(name: str) -> bool:
        return not any(part in name.lower() for part in SENSITIVE)

    def trimmed(column: Column, kind) -> Column:
        if isinstance(kind, T.StructType):
            fields = [trimmed(column[f.name], f.dataType).alias(f.name) for f in kind.fields if keep(f.name)]
            return F.struct(*fields) if fields else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(column, lambda x: trimmed(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_filter(column, lambda k, v: ~F.lower(k.cast("string")).rlike("|".join(SENSITIVE)))
        return column

    return df.select(*[trimmed(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if keep(f.name)])


def circuit_open(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """Backends whose longest run of failures reaches ``limit`` or that failed in a way no retry can mend.

    ``outcomes`` is (backend, seq, ok, category) with consecutive seq per backend. A run of ``limit`` failures shows as
    ``limit`` failing rows at seq, seq - 1, ..., so it is found by shifting rows onto later seqs and counting: the
    shuffle is by (backend, seq) and a backend with most of the rows still spreads over all tasks.
    """
    fatal = F.col("category").isin("import_error", "model_load_error")
    soft = outcomes.where(~F.col("ok") & ~fatal)
    shifted = soft.select("backend", F.explode(F.sequence(F.col("seq"), F.col("seq") + limit - 1)).alias("seq"))
    runs = shifted.groupBy("backend", "seq").count().where(F.col("count") >= limit).select("backend")
    return runs.unionByName(outcomes.where(~F.col("ok") & fatal).select("backend")).distinct()


def health(items: DataFrame, min_tests: int = 5, min_coverage: float = 65.0) -> DataFrame:
    """State counts and rates over (state, mode, tests, coverage); a pass with thin evidence is suspicious."""
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    thin = F.col("mode").isNull() | (
        (F.col("mode") != "e2e")
        & ((F.coalesce("tests", F.lit(0)) < min_tests) | F.col("coverage").isNull() | (F.col("coverage") < min_coverage))
    )

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return items.agg(
        n("passed").alias("passed"),
        n("regressed").alias("regressed"),
        n("active").alias("active"),
        rate(n("regressed"), n("passed") + n("regressed")).alias("regression_rate"),
        rate(n("passed"), n("passed") + n("regressed") + n("active")).alias("pass_rate"),
        F.count_if((F.col("state") == "passed") & thin).alias("suspicious"),
    )
