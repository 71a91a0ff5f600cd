"""Queries over evaluation, traces and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import query_signature
from quire.operators import evaluation as E
from quire.operators import observe as O
from quire.operators import runs as R
from quire.operators.ordered import cumulative, percentiles
from quire.operators.reports import backend_stats
from quire.plans.common import registry, table
from quire.plans.retrieval import ASKS, EVERY, asked, embeddings, neighbours, neighbours_sql
from quire.session import materialize

QUERIES, ORACLES, query = registry()


# Vectors as benchmark: a vector's ten nearest are its result, those of its own label are relevant with a grade from
# the id, and fifty ids in a row form a file.
GRADE = "CAST(1 + vec_id % 3 AS INT)"


def base(spark: SparkSession, sf_dir: str, asks: str = ASKS) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("file"), F.expr(GRADE).alias("grade"))
    mine = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), F.col("file").alias("q_file"))
    same = F.col("label") == F.col("q_label")
    hits = neighbours(spark, sf_dir, 10, asks=asks).join(e, "vec_id").join(mine, "query_id").select(
        "query_id", "rank", F.when(same, F.col("grade")).otherwise(0).alias("grade"), (F.col("file") == F.col("q_file")).alias("file_hit")
    )
    # Totals come from counts per label, grade and file, so no list of all relevant ids is built.
    per_label = e.groupBy("label").agg(
        F.count(F.lit(1)).alias("members"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in (1, 2, 3)]
    )
    per_file = e.groupBy("file").agg(F.count(F.lit(1)).alias("file_members"))

    def best(g: int):
        left = F.col(f"g{g}") - (F.col("grade") == g).cast("int")
        return F.array_repeat(F.lit(g), F.least(F.lit(5), left).cast("int"))

    totals = asked(e, asks).join(per_label, "label").join(per_file, "file").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("c"), F.col("label")).alias("category"),
        F.when(F.col("label") < 5, "single_chunk").otherwise("multi_chunk").alias("difficulty"),
        (F.col("label") < 5).alias("child_annotated"),
        (F.col("members") - 1).alias("n_relevant"),
        (F.col("file_members") - 1).alias("n_file"),
        F.slice(F.concat(best(3), best(2), best(1)), 1, 5).alias("ideal"),
    )
    file_hits = hits.groupBy("query_id").agg(F.sum(F.col("file_hit").cast("int")).alias("file_hits"))
    rows = E.per_query(hits, totals).join(file_hits, "query_id", "left")
    n = F.coalesce("file_hits", F.lit(0))
    rows = rows.withColumn("child_hit_at_k", (n > 0).cast("int")).withColumn(
        "child_recall_at_k", F.coalesce(F.try_divide(n, F.col("n_file")), F.lit(0.0))
    )
    return E.diagnose(rows, F.col("child_annotated"))


def base_sql(asks: str = ASKS) -> str:
    return f"""{neighbours_sql(10, asks=asks)},
 hs AS (SELECT nb.query_id, nb.rank, CASE WHEN e.label = q.label THEN 1 + e.vec_id % 3 ELSE 0 END AS grade, e.vec_id // 50 = q.vec_id // 50 AS ff
   FROM nb JOIN embeddings e ON e.vec_id = nb.vec_id JOIN embeddings q ON q.vec_id = nb.query_id),
 hc AS (SELECT *, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM hs),
 id AS (SELECT query_id, n_rel, sum(CASE WHEN rn <= 5 THEN (pow(2, g) - 1) / log2(rn + 1) ELSE 0 END) AS idcg FROM
   (SELECT q.vec_id AS query_id, 1 + e.vec_id % 3 AS g, count(*) OVER (PARTITION BY q.vec_id) AS n_rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 + e.vec_id % 3 DESC) AS rn
    FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id) GROUP BY ALL),
 fi AS (SELECT vec_id // 50 AS file, count(*) - 1 AS n_file FROM embeddings GROUP BY 1),
 m AS (SELECT query_id, sum(CASE WHEN rank <= 5 AND grade > 0 THEN 1 ELSE 0 END) AS found, max(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS cand,
   coalesce(max(CASE WHEN rank <= 5 AND grade > 0 THEN CAST(1 AS DOUBLE) / rank END), 0) AS mrr,
   sum(CASE WHEN rank <= 5 AND grade > 0 THEN CAST(cum AS DOUBLE) / rank ELSE 0 END) AS ap,
   sum(CASE WHEN rank <= 5 AND grade > 0 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
   max(CASE WHEN rank <= 5 AND ff THEN 1 ELSE 0 END) AS anyfile, sum(CASE WHEN ff THEN 1 ELSE 0 END) AS fhits FROM hc GROUP BY query_id),
 pq AS (SELECT e.vec_id AS query_id, 'c' || label AS category, CASE WHEN label < 5 THEN 'single_chunk' ELSE 'multi_chunk' END AS difficulty, label < 5 AS child_annotated,
   coalesce(found / n_rel, 0) AS recall_at_k, found / CAST(5 AS DOUBLE) AS precision_at_k, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit_at_k, mrr,
   coalesce(ap / n_rel, 0) AS map_at_k, coalesce(dcg / idcg, 0) AS ndcg_at_k, cand, anyfile,
   CASE WHEN fhits > 0 THEN 1 ELSE 0 END AS child_hit_at_k, coalesce(fhits / nullif(n_file, 0), 0) AS child_recall_at_k
   FROM embeddings e JOIN m ON m.query_id = e.vec_id LEFT JOIN id ON id.query_id = e.vec_id JOIN fi ON fi.file = e.vec_id // 50),
 mn AS (SELECT category, median(1 - precision_at_k) AS bs FROM pq GROUP BY category),
 pd AS (SELECT pq.*, CASE WHEN hit_at_k = 0 THEN CASE WHEN cand = 1 THEN 'ranking_miss' WHEN child_annotated AND anyfile = 0 THEN 'file_miss' ELSE 'recall_miss' END
   WHEN bs > 0 AND 1 - precision_at_k > bs * 1.5 THEN 'low_precision' ELSE 'accept' END AS diagnosis FROM pq JOIN mn USING (category))"""


BASE_SQL = base_sql()
SIX = ", ".join(f"round({m}, 6) AS {m}" for m in (*E.METRICS, "child_hit_at_k", "child_recall_at_k"))


@query("ir_metrics", f"WITH {BASE_SQL} SELECT query_id, diagnosis, {SIX} FROM pd")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "query_id", "diagnosis", *[F.round(m, 6).alias(m) for m in (*E.METRICS, "child_hit_at_k", "child_recall_at_k")]
    )


@query(
    "grouped_eval",
    f"""WITH {BASE_SQL} SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN difficulty IS NOT NULL THEN 'difficulty' ELSE 'all' END AS level, category, difficulty,
    count(*) AS num_queries, {", ".join(f"round(avg({m}), 6) AS {m}" for m in E.METRICS)}, sum(CAST(child_annotated AS INT)) AS num_child_annotated,
    {", ".join(f"round(coalesce(avg(CASE WHEN child_annotated THEN {c} END), 0), 6) AS {c}" for c in ("child_hit_at_k", "child_recall_at_k"))},
    {", ".join(f"count(*) FILTER (diagnosis = '{d}') AS {d}" for d in E.DIAGNOSES)} FROM pd GROUP BY GROUPING SETS ((category), (difficulty), ())""",
)
def grouped_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.grouped(base(spark, sf_dir))
    rounded = [*E.METRICS, "child_hit_at_k", "child_recall_at_k"]
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in out.columns])


def compare_sql(asks: str = ASKS) -> str:
    return f"""WITH RECURSIVE {base_sql(asks)}, lo AS (SELECT query_id, 'recall_at_k' AS metric, CAST(recall_at_k AS DOUBLE) AS a, CASE WHEN precision_at_k > 0.3 THEN recall_at_k * 0.9 ELSE recall_at_k + mrr * 0.1 END AS b FROM pd WHERE category <> 'c9'
      UNION ALL SELECT query_id, 'mrr', mrr, CASE WHEN precision_at_k > 0.3 THEN mrr * 0.9 ELSE mrr + mrr * 0.1 END FROM pd WHERE category <> 'c9'
      UNION ALL SELECT query_id, 'ndcg_at_k', ndcg_at_k, CASE WHEN precision_at_k > 0.3 THEN ndcg_at_k * 0.9 ELSE ndcg_at_k + mrr * 0.1 END FROM pd WHERE category <> 'c9'),
    df AS (SELECT metric, round(a - b, 12) AS d FROM lo),
    ra AS (SELECT metric, d, rank() OVER w + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM df WHERE d <> 0 WINDOW w AS (PARTITION BY metric ORDER BY abs(d))),
    sg AS (SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM ra GROUP BY metric),
    me AS (SELECT metric, count(*) AS pairs, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(b) - avg(a), 6) AS delta FROM lo GROUP BY metric)"""


@query("run_compare", compare_sql() + " SELECT metric, pairs, a, b, delta, n, w_plus, w_minus FROM me JOIN sg USING (metric)")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = compared_runs(spark, sf_dir)
    pairs = R.paired(a, b, ["recall_at_k", "mrr", "ndcg_at_k"])
    means = pairs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.avg("a"), 6).alias("a"),
        F.round(F.avg("b"), 6).alias("b"),
        F.round(F.avg("b") - F.avg("a"), 6).alias("delta"),
    )
    return means.join(R.signed_ranks(pairs).select("metric", "n", "w_plus", "w_minus"), "metric")


def compared_runs(spark: SparkSession, sf_dir: str, asks: str = ASKS):
    """The evaluation and a second run of it with shifted values; one label was relabelled and no longer pairs."""
    rows = materialize(base(spark, sf_dir, asks).select("query_id", "category", *E.METRICS), "run")
    a = rows.withColumn("signature", query_signature(F.col("query_id").cast("string"), F.array("category")))
    relabelled = F.when(F.col("category") == "c9", "other").otherwise(F.col("category"))

    def shifted(m):
        return F.when(F.col("precision_at_k") > 0.3, F.col(m) * 0.9).otherwise(F.col(m) + F.col("mrr") * 0.1).alias(m)

    b = rows.select(
        "query_id",
        *[shifted(m) for m in E.METRICS],
        query_signature(F.col("query_id").cast("string"), F.array(relabelled)).alias("signature"),
    )
    return a, b


@query(
    "run_significance",
    compare_sql(EVERY)
    + """,
    ti AS (SELECT metric, sum(pow(c, 3) - c) AS tie_term FROM (SELECT metric, abs(d) AS size, count(*) AS c FROM df WHERE d <> 0 GROUP BY ALL) GROUP BY metric),
    ze AS (SELECT metric, count(*) FILTER (d = 0) AS zeros FROM df GROUP BY metric),
    dp AS (SELECT 0 AS i, list_transform(range(0, 1276), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS ways
      UNION ALL SELECT i + 1, list_transform(ways, lambda w, j: w + CASE WHEN j - 1 > i THEN ways[j - 1 - i] ELSE 0 END) FROM dp WHERE i < 50),
    st AS (SELECT *, least(w_plus, w_minus) AS low, sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * tie_term) / 24) AS sp FROM sg JOIN ti USING (metric) JOIN ze USING (metric)),
    zz AS (SELECT *, CASE WHEN sp > 0 THEN abs(low - n * (n + 1) / 4.0) / sp / sqrt(2) ELSE 0 END AS x FROM st),
    pr AS (SELECT metric, CASE WHEN n <= 50 AND tie_term = 0 AND zeros = 0 THEN least(1, 2 * (SELECT list_sum(ways[1:CAST(floor(low) AS INT) + 1]) FROM dp WHERE dp.i = n) / pow(2, n))
      WHEN sp = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * (SELECT sum(exp(k * ln(2) + (2 * k + 1) * ln(greatest(x, 1e-12)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) FROM (SELECT unnest(range(0, 400)) AS k)) END AS p FROM zz),
    ok AS (SELECT metric, p FROM pr JOIN me USING (metric) WHERE pairs >= 6),
    ho AS (SELECT metric, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1)) AS p_value FROM ok)
    SELECT metric, pairs, a, b, delta, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM me LEFT JOIN ho USING (metric)""",
)
def run_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison and its test over the pairs of all vectors."""
    a, b = compared_runs(spark, sf_dir, EVERY)
    out = R.compare(a, b, ["recall_at_k", "mrr", "ndcg_at_k"])
    return out.select("metric", "pairs", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta", "p_value")], "significant")


@query(
    "query_signatures",
    "SELECT conv_id, left(sha256(CAST(conv_id AS VARCHAR) || '|' || string_agg(d, '|' ORDER BY d)), 16) AS signature FROM (SELECT conv_id, left(sha256(text), 8) AS d FROM conversations) GROUP BY conv_id",
)
def query_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.substring(F.sha2("text", 256), 1, 8)).alias("ids")
    )
    return c.select("conv_id", query_signature(F.col("conv_id").cast("string"), F.col("ids")).alias("signature"))


@query(
    "holm_correction",
    """WITH p AS (SELECT user_id AS metric, min(value) / 100 AS p_raw FROM events GROUP BY user_id)
    SELECT metric, round(least(1.0, p_raw * (count(*) OVER () - row_number() OVER (ORDER BY p_raw, metric) + 1)), 9) AS p_value FROM p""",
)
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("metric")).agg((F.min("value") / 100).alias("p_raw"))
    return R.holm(p).select("metric", F.round("p_value", 9).alias("p_value"))


SCORES_SQL = """sc AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN n_chars > 2000 THEN 0.5 ELSE 0.8 END AS faithfulness,
 CASE WHEN n_chars < 300 THEN NULL ELSE 0.25 + 0.5 * quality END AS answer_relevancy,
 CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN 1.0 ELSE 0.75 END AS context_precision,
 CASE WHEN quality = 1 THEN 0.9 ELSE 0.3 END AS context_recall, CASE WHEN lang = 'es' THEN NULL ELSE 0.6 END AS answer_correctness,
 CASE WHEN toxic = 1 THEN 'timeout' END AS judge_error, CASE WHEN n_chars > 10000 THEN 'too long' END AS generator_error
 FROM documents JOIN labels USING (doc_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "doc_id",
        "CAST(CASE WHEN toxic = 1 THEN NULL WHEN n_chars > 2000 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS faithfulness",
        "CAST(CASE WHEN n_chars < 300 THEN NULL ELSE 0.25 + 0.5 * quality END AS DOUBLE) AS answer_relevancy",
        "CAST(CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN 1.0 ELSE 0.75 END AS DOUBLE) AS context_precision",
        "CAST(CASE WHEN quality = 1 THEN 0.9 ELSE 0.3 END AS DOUBLE) AS context_recall",
        "CAST(CASE WHEN lang = 'es' THEN NULL ELSE 0.6 END AS DOUBLE) AS answer_correctness",
        "CASE WHEN toxic = 1 THEN 'timeout' END AS judge_error",
        "CASE WHEN n_chars > 10000 THEN 'too long' END AS generator_error",
        "quality",
    )
    return rows.withColumn(
        "verdict", F.when(F.col("judge_error").isNotNull(), "error").otherwise(E.verdict(F.array(*E.SCORES)))
    )


LIST5 = "[" + ", ".join(E.SCORES) + "]"
VERDICT_SQL = f"""{SCORES_SQL}, ve AS (SELECT *, CASE WHEN judge_error IS NOT NULL THEN 'error' WHEN r >= 0.75 THEN 'pass' WHEN r >= 0.5 THEN 'partial' ELSE 'fail' END AS verdict
 FROM (SELECT *, len(list_filter({LIST5}, lambda s: s >= 0.75)) / nullif(len(list_filter({LIST5}, lambda s: s IS NOT NULL)), 0) AS r FROM sc))"""


@query(
    "verdict_distribution",
    f"""WITH {VERDICT_SQL} SELECT count(*) AS num_total, {", ".join(f"count(*) FILTER (verdict = '{v}') AS verdict_{v}" for v in E.VERDICTS)},
    count(judge_error) AS judge_errors, count(generator_error) AS generator_errors FROM ve""",
)
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdict_counts(judged(spark, sf_dir))


def _means_sql(value: str) -> str:
    return f"WITH {SCORES_SQL} SELECT count(*) AS num_valid, " + ", ".join(
        f"round(avg({value.format(c=c)}), 6) AS {c}_avg" for c in E.SCORES
    ) + " FROM sc WHERE faithfulness IS NOT NULL"


@query("layer2_means", _means_sql("coalesce({c}, 0)"))
def layer2_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.judge_means(judged(spark, sf_dir))
    return out.select("num_valid", *[F.round(f"{c}_avg", 6).alias(f"{c}_avg") for c in E.SCORES])


@query("layer2_means_skip_nulls", _means_sql("{c}"))
def layer2_means_skip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.judge_means(judged(spark, sf_dir), nulls_as_zero=False)
    return out.select("num_valid", *[F.round(f"{c}_avg", 6).alias(f"{c}_avg") for c in E.SCORES])


@query(
    "judge_calibration",
    f"""WITH {SCORES_SQL}, c AS (SELECT quality = 1 AS g, context_recall AS s, CASE WHEN judge_error IS NULL THEN 0 ELSE 1 END AS e FROM sc JOIN labels USING (doc_id)),
    r AS (SELECT avg(CASE WHEN g THEN s END) AS mg, avg(CASE WHEN NOT g THEN s END) AS mb, avg(e) AS pe FROM c)
    SELECT round(mg, 6) AS mean_good, round(mb, 6) AS mean_bad, round(pe, 6) AS parse_error_ratio, round(mg - mb, 6) AS diff, mg >= 0.75 AND mb <= 0.5 AND mg - mb >= 0.5 AND pe <= 0.05 AS passed FROM r""",
)
def judge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).select(
        (F.col("quality") == 1).alias("is_good"), F.col("context_recall").alias("score"), F.col("judge_error").isNotNull().alias("parse_error")
    )
    out = E.calibration(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_good", "mean_bad", "parse_error_ratio", "diff")], "passed")


@query(
    "stage_percentiles",
    """SELECT event_type AS stage, count(*) AS runs, round(avg(ms), 1) AS avg_ms, round(quantile_cont(ms, 0.5), 1) AS p50_ms, round(quantile_cont(ms, 0.95), 1) AS p95_ms
    FROM (SELECT event_type, CASE WHEN value < 5 THEN 0 ELSE value END AS ms FROM events) WHERE ms > 0 GROUP BY event_type""",
)
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("ms")
    )
    return O.stage_report(d)


@query(
    "nearest_rank_percentiles",
    """WITH r AS (SELECT l_returnflag AS backend, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT backend, n, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN v END) AS p95 FROM r GROUP BY backend, n""",
)
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("backend"), F.col("l_extendedprice").alias("v"))
    return percentiles(d, ["backend"], "v", {"p50": 0.5, "p95": 0.95}, "nearest")


@query(
    "backend_run_stats",
    """SELECT event_type AS backend, count(*) AS total, count(*) FILTER (value >= 20) AS success, round(count(*) FILTER (value >= 20) / count(*), 6) AS success_rate,
    count(*) FILTER (value < 5) AS quality_fail, count(*) FILTER (value >= 5 AND value < 20) AS timeout FROM events GROUP BY event_type""",
)
def backend_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") >= 20
    runs = table(spark, sf_dir, "events").withColumnRenamed("event_type", "backend")
    return backend_stats(runs, "backend", ok, {"quality_fail": F.col("value") < 5, "timeout": ~ok & (F.col("value") >= 5)})


@query(
    "error_rollup",
    "SELECT CASE WHEN value < 1 THEN 'unknown' ELSE event_type END AS error_code, count(*) AS count, count(DISTINCT user_id) AS queries FROM events GROUP BY 1",
)
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.error_rollup(_errors(spark, sf_dir))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.when(F.col("value") < 1, "").otherwise(F.col("event_type")).alias("error_code"), F.col("user_id").alias("query_id"), "ts"
    )


@query(
    "error_queries",
    "SELECT error_code, query_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us FROM (SELECT CASE WHEN value < 1 THEN 'unknown' ELSE event_type END AS error_code, user_id AS query_id, ts FROM events) GROUP BY 1, 2",
)
def error_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.error_queries(_errors(spark, sf_dir)).select("error_code", "query_id", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_us"))


CALLS = """CASE event_type WHEN 'view' THEN 'generator' WHEN 'click' THEN 'judge_faithfulness' WHEN 'purchase' THEN 'judge_quality' ELSE 'other' END AS kind,
 CAST(round(value * 10) AS BIGINT) AS input_tokens, CAST(round(value) AS BIGINT) AS output_tokens, CASE WHEN value > 10 THEN value > 60 END AS cache_hit,
 event_type = 'error' AS is_error, value > 200 AS is_retry"""


@query(
    "cost_summary",
    f"""SELECT sum(input_tokens) AS total_input_tokens, sum(output_tokens) AS total_output_tokens,
    round(sum(input_tokens) / 1000 * 0.0003 + sum(output_tokens) / 1000 * 0.0012, 6) AS estimated_cost,
    round(count(*) FILTER (kind = 'generator' AND cache_hit) / count(*) FILTER (kind = 'generator' AND cache_hit IS NOT NULL), 4) AS generator_cache_hit_rate,
    round(count(*) FILTER (kind = 'judge_quality' AND cache_hit) / count(*) FILTER (kind = 'judge_quality' AND cache_hit IS NOT NULL), 4) AS judge_cache_hit_rate,
    round(count(*) FILTER (is_error) / count(*) FILTER (kind <> 'other'), 4) AS error_rate, count(*) FILTER (is_retry) AS retry_count,
    count(*) FILTER (kind = 'generator') AS generator_calls, count(*) FILTER (kind = 'judge_faithfulness') AS judge_faithfulness_calls, count(*) FILTER (kind = 'judge_quality') AS judge_quality_calls
    FROM (SELECT {CALLS} FROM events)""",
)
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cost_summary(_calls(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    events.createOrReplaceTempView("_quire_events")
    return spark.sql(f"SELECT {CALLS} FROM _quire_events")


# Spans of the run by event type, with the time in milliseconds; a null or zero time is a stage that did not run.
SPANS = "CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'generate' WHEN 'purchase' THEN 'judge_quality' ELSE 'end_to_end' END AS stage, value AS ms"
RUN_CALLS = """CASE event_type WHEN 'view' THEN 'generator' WHEN 'click' THEN 'rerank' WHEN 'purchase' THEN 'judge_quality' ELSE 'judge_faithfulness' END AS kind,
 CAST(round(value * 10) AS BIGINT) AS input_tokens, CAST(round(value) AS BIGINT) AS output_tokens, CASE WHEN value > 10 THEN value > 60 END AS cache_hit,
 value > 150 AS is_error, CASE WHEN value > 250 THEN 'Timeout' WHEN value > 180 THEN 'RateLimit' END AS error_type, value > 200 AS is_retry, value BETWEEN 5 AND 6 AS parse_error"""
_RATE = "round(count(*) FILTER (kind = '{0}' AND cache_hit) / nullif(count(*) FILTER (kind = '{0}' AND cache_hit IS NOT NULL), 0), 4)"
_STAGE_SQL = ", ".join(
    f"round(coalesce(quantile_cont(ms, {q}) FILTER (stage = '{s}'), 0), 4) AS stage_{s}_{p}" for s in O.RUN_STAGES for p, q in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
)


@query(
    "run_summary",
    f"""WITH c AS (SELECT {RUN_CALLS} FROM events), d AS (SELECT {SPANS} FROM events),
    er AS (SELECT coalesce(error_type, 'unknown') AS t, count(*) AS n FROM c WHERE is_error GROUP BY 1),
    a AS (SELECT sum(input_tokens) AS total_input_tokens, sum(output_tokens) AS total_output_tokens, quantile_cont(input_tokens, 0.95) AS input_tokens_p95, quantile_cont(output_tokens, 0.95) AS output_tokens_p95,
     round(sum(input_tokens) / 1000 * 0.0003 + sum(output_tokens) / 1000 * 0.0012, 6) AS estimated_cost, coalesce({_RATE.format('generator')}, 0) AS generator_cache_hit_rate,
     coalesce({_RATE.format('judge_quality')}, 0) AS judge_cache_hit_rate, {_RATE.format('rerank')} AS rerank_cache_hit_rate,
     round(coalesce(count(*) FILTER (is_error) / nullif(count(*) FILTER (kind <> 'rerank'), 0), 0), 4) AS error_rate, count(*) FILTER (is_retry) AS retry_count, count(*) FILTER (parse_error) AS parse_error_count,
     count(*) FILTER (kind = 'generator') AS generator_llm_calls, count(*) FILTER (kind = 'judge_faithfulness') AS judge_faithfulness_calls, count(*) FILTER (kind = 'judge_quality') AS judge_quality_calls FROM c),
    s AS (SELECT {_STAGE_SQL} FROM d)
    SELECT a.*, s.*, (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM er) AS errors_by_type FROM a, s""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary row of a run over calls and spans made from the events."""
    events = table(spark, sf_dir, "events")
    events.createOrReplaceTempView("_quire_events")
    out = O.run_summary(spark.sql(f"SELECT {RUN_CALLS} FROM _quire_events"), spark.sql(f"SELECT {SPANS} FROM _quire_events"))
    listed = F.transform(F.array_sort(F.map_entries("errors_by_type")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    # Interpolated times are rounded, so both engines give the same last digit.
    times = {c: F.round(c, 4) for c in out.columns if c.startswith("stage_")}
    return out.withColumns({"errors_by_type": F.concat_ws(",", listed), **times})


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from the neighbour lists: ten recalled, eight before and five after reranking."""
    lists = neighbours(spark, sf_dir, 10).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("recalled")
    )
    rows = lists.join(embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    second = F.coalesce(F.try_element_at("recalled", (1 + F.col("query_id") % 12).cast("int")), F.lit(-1).cast("long"))
    none = F.array().cast("array<bigint>")
    return rows.select(
        "query_id",
        (F.col("label") == 0).alias("fallback"),
        F.when(F.col("label") == 1, none).otherwise(F.slice("recalled", 1, 5)).alias("retrieved"),
        "recalled",
        F.slice("recalled", 1, 8).alias("before_rerank"),
        F.when(F.col("label") == 3, none).otherwise(F.slice("recalled", 1, 5)).alias("after_rerank"),
        F.array(F.element_at("recalled", 1), second).alias("expected"),
        F.when(F.col("label") == 2, "error").otherwise("pass").alias("verdict"),
        F.lit(None).cast("string").alias("judge_error"),
        F.when(F.col("label") == 4, "no answer").alias("generator_error"),
    )


TRACE_SQL = f"""{neighbours_sql(10)}, rc AS (SELECT query_id, list(vec_id ORDER BY rank) AS recalled FROM nb GROUP BY query_id),
 tr AS (SELECT query_id, label, recalled, recalled[1:8] AS bf, recalled[1:5] AS af, [recalled[1], coalesce(recalled[1 + query_id % 12], -1)] AS expected FROM rc JOIN embeddings ON vec_id = query_id),
 atx AS (SELECT *, list_filter(expected, lambda x: NOT list_contains(recalled, x)) AS ab, list_filter(expected, lambda x: NOT list_contains(af, x)) AS dr FROM tr)"""


@query(
    "failure_attribution",
    f"""WITH {TRACE_SQL}, k AS (SELECT *, CASE WHEN label = 0 THEN 'rerank_fallback' WHEN label = 1 THEN 'empty_recall' WHEN len(ab) > 0 THEN 'recall_absent' WHEN len(dr) > 0 THEN 'rerank_drop'
      WHEN label IN (2, 4) THEN 'generation_error' END AS failure_type FROM atx)
    SELECT query_id, failure_type, CASE failure_type WHEN 'recall_absent' THEN ab WHEN 'rerank_drop' THEN dr ELSE [] END AS missing_ids,
     CASE failure_type WHEN 'rerank_drop' THEN list_filter(dr, lambda x: NOT list_contains(bf, x)) ELSE [] END AS pool_truncation,
     CASE failure_type WHEN 'recall_absent' THEN (2 - len(ab)) / 2 WHEN 'rerank_drop' THEN (2 - len(dr)) / 2 END AS expected_hit_ratio FROM k""",
)
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.attribute(traces(spark, sf_dir))


@query(
    "evidence_coverage",
    f"""WITH {TRACE_SQL}, c AS (SELECT query_id, len(list_distinct(list_filter(expected, lambda x: list_contains(recalled, x)))) AS r, len(list_distinct(list_filter(expected, lambda x: list_contains(af, x)))) AS a, label FROM atx)
    SELECT query_id, 2 AS expected, r AS recalled, a AS after_rerank, CASE WHEN r < 2 THEN 'recall' WHEN a < r THEN 'rerank' END AS lost_stage FROM c""",
)
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.evidence_coverage(traces(spark, sf_dir))


@query("retention_latest_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retention_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.newest(table(spark, sf_dir, "events"), "ts", 500, "event_id").select("event_id", "user_id")


@query(
    "circuit_breaker",
    """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, value >= 40 AS ok FROM events),
    i AS (SELECT user_id, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS island FROM o WHERE NOT ok)
    SELECT DISTINCT user_id AS backend FROM (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) WHERE n >= 3""",
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Attempt numbers by running counts, so a user with most of the attempts is still spread over tasks.
    counts = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lit(1).alias("c"))
    o = cumulative(counts, ["user_id"], "event_id", "c").select(
        F.col("user_id").alias("backend"), F.col("cum").alias("seq"), (F.col("value") >= 40).alias("ok"), F.lit("").alias("category")
    )
    return O.circuit_open(o)


@query(
    "metric_gate",
    f"""WITH {base_sql(EVERY)}, v AS (SELECT category AS metric, round(avg(mrr), 6) AS value, round(avg(mrr) * 1.02, 6) AS base FROM pd GROUP BY category)
    SELECT metric, value, round(base - value, 6) AS delta, value >= 0.15 AND round(base - value, 6) <= 0.005 AS passed FROM v""",
)
def metric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on the means of all vectors per category."""
    means = materialize(
        base(spark, sf_dir, EVERY).groupBy(F.col("category").alias("metric")).agg(F.avg("mrr").alias("m")), "gate"
    )
    now = means.select("metric", F.round("m", 6).alias("value"))
    before = means.select("metric", F.round(F.col("m") * 1.02, 6).alias("value"))
    rules = means.select("metric", F.lit(0.15).alias("min"), F.lit(None).cast("double").alias("max"), F.lit(0.005).alias("drop"))
    return R.metric_gate(now, rules, before).select("metric", "value", "delta", "passed")
