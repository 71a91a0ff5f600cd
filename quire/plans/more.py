"""Queries over model replies, health figures and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import rerank_text
from quire.operators import models, observe
from quire.operators.evaluation import SCORES
from quire.operators.runs import delta_only
from quire.plans.common import registry, table
from quire.session import ship_by_value, spread

QUERIES, ORACLES, query = registry()


REPLY = """CASE WHEN turn = 0 THEN 'sorry, no scores' WHEN role = 'user' THEN concat('{"faithfulness": 1.7, "answer_relevancy": "bad", "context_precision": 0.', conv_id % 10, '}')
 ELSE concat('Scores:', chr(10), '```json', chr(10), '{"faithfulness": 0.', turn, ', "context_recall": -3, "answer_correctness": 0.8}', chr(10), '```') END"""


@query(
    "judge_replies",
    """SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN role = 'user' THEN 1.0 ELSE CAST('0.' || turn AS DOUBLE) END AS faithfulness, CAST(NULL AS DOUBLE) AS answer_relevancy,
    CASE WHEN turn > 0 AND role = 'user' THEN CAST('0.' || (conv_id % 10) AS DOUBLE) END AS context_precision, CASE WHEN turn > 0 AND role <> 'user' THEN 0.0 END AS context_recall,
    CASE WHEN turn > 0 AND role <> 'user' THEN 0.8 END AS answer_correctness,
    CASE WHEN turn = 0 THEN 'error' WHEN role = 'user' THEN CASE WHEN CAST('0.' || (conv_id % 10) AS DOUBLE) >= 0.75 THEN 'pass' ELSE 'partial' END
     ELSE CASE WHEN CAST('0.' || turn AS DOUBLE) >= 0.75 THEN 'partial' ELSE 'fail' END END AS verdict FROM conversations""",
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{REPLY} AS reply")
    return models.judged(rows).select("conv_id", "turn", *SCORES, "verdict")


@query(
    "health_metrics",
    """WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    i AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'P' THEN 'regressed' ELSE 'active' END AS state, CASE WHEN o_orderpriority LIKE '1%' THEN 'e2e' WHEN n IS NOT NULL THEN 'gate' END AS mode, n AS tests, o_totalprice / 5000 AS coverage
      FROM orders LEFT JOIN t ON l_orderkey = o_orderkey),
    a AS (SELECT count(*) FILTER (state = 'passed') AS passed, count(*) FILTER (state = 'regressed') AS regressed, count(*) FILTER (state = 'active') AS active,
      count(*) FILTER (state = 'passed' AND (mode IS NULL OR (mode <> 'e2e' AND (coalesce(tests, 0) < 5 OR coverage < 65)))) AS suspicious FROM i)
    SELECT passed, regressed, active, round(regressed / (passed + regressed), 6) AS regression_rate, round(passed / (passed + regressed + active), 6) AS pass_rate, suspicious FROM a""",
)
def health_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("tests"))
    items = table(spark, sf_dir, "orders").join(tests, "o_orderkey", "left").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'P' THEN 'regressed' ELSE 'active' END AS state",
        "CASE WHEN o_orderpriority LIKE '1%' THEN 'e2e' WHEN tests IS NOT NULL THEN 'gate' END AS mode",
        "tests",
        "o_totalprice / 5000 AS coverage",
    )
    out = observe.health(items)
    return out.select(
        *[F.round(c, 6).alias(c) if c.endswith("_rate") else F.col(c) for c in out.columns]
    )


@query(
    "summary_deltas",
    """WITH a AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1),
    b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'click' GROUP BY 1)
    SELECT metric, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS delta FROM a JOIN b USING (metric)""",
)
def summary_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("early", F.col("ts").cast("timestamp") < F.expr("timestamp'2024-01-15 00:00:00Z'"))

    def means(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))

    out = delta_only(means(e.where("early AND event_type <> 'view'")), means(e.where("NOT early AND event_type <> 'click'")))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")])


@query(
    "rerank_pairs",
    """SELECT doc_id, sha256('[' || CASE WHEN lang = 'fr' THEN CAST(doc_id AS VARCHAR) ELSE source END || '][' || CASE WHEN lang = 'de' THEN CAST(doc_id AS VARCHAR) ELSE '[''' || source || ''', ''' || lang || ''']' END || '] ' || text) AS digest FROM documents""",
)
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    pair = rerank_text(
        F.when(F.col("lang") == "fr", "").otherwise(F.col("source")),
        F.when(F.col("lang") == "de", none).otherwise(F.array("source", "lang")),
        F.col("doc_id").cast("string"),
        F.col("text"),
    )
    return d.select("doc_id", F.sha2(pair, 256).alias("digest"))


EMBED_DIM, EMBED_WORDS = 16, 4000


def letter_model():
    """Stand-in for an embedding model: counts of the first letters of words; like a real one it refuses long texts."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = [w for w in text.split(" ") if w]
            if len(words) > EMBED_WORDS:
                raise ValueError("too long")
            counts = [0.0] * EMBED_DIM
            for w in words:
                counts[ord(w[0]) % EMBED_DIM] += 1
            out.append(counts)
        return out

    return encode


@query(
    "embed_stage",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents),
    c AS (SELECT doc_id, len(ws) > {EMBED_WORDS} AS long, list_transform(range(0, {EMBED_DIM}), lambda i: CAST(len(list_filter(ws, lambda x: unicode(x) % {EMBED_DIM} = i)) AS DOUBLE)) AS v FROM w)
    SELECT doc_id, CASE WHEN NOT long THEN list_transform(v, lambda x: round(CASE WHEN list_sum(v) = 0 THEN 0 ELSE x / sqrt(list_inner_product(v, v)) END, 6)) END AS vector,
    CASE WHEN long THEN 'ValueError: too long' END AS vector_error FROM c""",
)
def embed_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the model stage; texts that the model refuses keep their row and get an error."""
    ship_by_value(__name__)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = models.embed(docs, "text", "vector", letter_model, EMBED_DIM)
    return out.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "vector_error")
