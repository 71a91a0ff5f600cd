"""Queries over parsing chains, cached model calls and budgets of generated questions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import keys
from quire.operators import parse_chain as P
from quire.operators.generation import generate, numbered_items, quotas
from quire.plans.common import registry, table
from quire.session import shared_dir, spread
from quire.sources.cache import CallCache, cached_call

QUERIES, ORACLES, query = registry()


def _standin(name: str, markdown: str, error: str, judged: bool = True) -> P.Backend:
    """A backend given by SQL expressions over the columns of a unit."""
    return P.Backend(name, lambda u: u.selectExpr("*", f"{markdown} AS markdown", f"{error} AS error"), judged)


# French texts get a skipped heading level from the first backend, Spanish ones an error; pages fail by their number.
FIRST = _standin(
    "first",
    "CASE WHEN (page < 0 AND lang = 'fr') OR page % 3 = 0 THEN concat('# a', chr(10), '### b', chr(10), payload) ELSE payload END",
    "CASE WHEN (page < 0 AND lang = 'es') OR page % 3 = 2 THEN 'busy' END",
)
SECOND = _standin(
    "second",
    "CASE WHEN (page < 0 AND lang = 'es' AND doc_id % 2 = 0) OR page % 4 = 2 THEN payload WHEN page >= 0 THEN ' ' END",
    "CAST(NULL AS STRING)",
)
EYES = _standin("eyes", "concat('seen ', payload)", "CASE WHEN page % 5 = 0 THEN 'gone' END", judged=False)


@query(
    "page_retry_chain",
    """WITH d AS (SELECT doc_id, lang, text, NOT (lang = 'fr' OR (lang = 'es' AND doc_id % 2 = 1)) AS whole FROM documents),
    p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM d WHERE NOT whole),
    a AS (SELECT *, CASE WHEN page % 3 = 1 AND trim(t) <> '' THEN 'first' WHEN page % 4 = 2 AND trim(t) <> '' THEN 'second' WHEN page % 5 <> 0 THEN 'eyes' END AS backend FROM p),
    g AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (backend = 'eyes') AS corrected, count(*) FILTER (backend IS NULL) AS empty,
      sum(CASE backend WHEN 'first' THEN length(t) WHEN 'second' THEN length(t) WHEN 'eyes' THEN length(t) + 5 ELSE 0 END) AS n_chars,
      sum(CASE WHEN page % 3 = 2 THEN 2 ELSE 1 END + CASE WHEN backend = 'first' THEN 0 ELSE 1 END + CASE WHEN backend IN ('first', 'second') THEN 0 WHEN page % 5 = 0 THEN 2 ELSE 1 END) AS tries FROM a GROUP BY 1)
    SELECT doc_id, CASE WHEN whole THEN CASE WHEN lang = 'es' THEN 'second' ELSE 'first' END END AS backend, coalesce(pages, 0) AS pages, coalesce(corrected, 0) AS corrected,
     coalesce(empty, 0) AS empty, CAST(coalesce(n_chars, length(text)) AS BIGINT) AS n_chars, CAST(CASE WHEN lang = 'es' THEN 3 WHEN lang = 'fr' THEN 2 ELSE 1 END + coalesce(tries, 0) AS BIGINT) AS attempts
    FROM d LEFT JOIN g USING (doc_id)""",
)
def page_retry_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a chain of two backends, failed ones with their lines as pages; the second run finds nothing to do."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.col("text").alias("payload"))
    pages = docs.select("doc_id", "lang", F.posexplode(F.split("payload", "\n")).alias("page", "payload"))
    ledger = P.ParseLedger(spark, f"{shared_dir(spark)}/attempts-{uuid.uuid4().hex}", docs.schema["doc_id"].dataType.simpleString())
    for _ in range(2):
        P.parse_documents(docs, pages, [FIRST, SECOND], EYES, ledger)
    units = P.parsed_units(docs, pages, ledger)
    stats = P.retry_stats(units, EYES.name)
    kept = P.merged_document_pages(units).groupBy("doc_id").agg(F.sum(F.length("kept")).alias("n_chars"))
    tried = ledger.attempts().groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempts"))
    return stats.join(kept, "doc_id").join(tried, "doc_id")


@query(
    "judge_cache",
    """WITH k AS (SELECT conv_id, turn, length(text) AS n, 'judge:' || conv_id || '-' || turn || ':' || substr(sha256(text), 1, 16) || ':' ||
      substr(sha256('writer|0.0|512|0.9|' || substr(sha256('answer {q}'), 1, 16)), 1, 12) || ':' || substr(sha256('faith'), 1, 8) || '/' || substr(sha256('good'), 1, 8) || ':judge-1' AS key FROM conversations)
    SELECT key, turn % 4 = 0 AS hit, CASE WHEN turn % 4 = 0 THEN 'two:' || n WHEN n % 7 <> 0 THEN 'three:' || n END AS reply,
     CASE WHEN turn % 4 <> 0 AND n % 7 = 0 THEN 'busy' END AS error FROM k""",
)
def judge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns are judged first; every fourth turn is judged anew and compacted; then, as the first answers have expired, all turns ask."""
    config = keys.config_hash("writer", 0.0, 512, 0.9, "answer {q}")
    asked = F.concat_ws("-", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations").select(
        "turn", F.length("text").alias("n"), keys.judge_key(asked, F.col("text"), config, keys.prompt_version("faith", "good"), "judge-1").alias("key")
    )
    cache = CallCache(spark, f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")

    def judge(word: str, fails: str = "NULL"):
        return lambda missing: missing.selectExpr("*", f"CASE WHEN {fails} IS NULL THEN concat('{word}:', n) END AS value", f"CAST({fails} AS STRING) AS error")

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    cached_call(rows.where("turn % 2 = 0"), "key", judge("one"), cache, start)
    cache.put(judge("two")(rows.where("turn % 4 = 0")), start + dt.timedelta(days=1), dt.timedelta(hours=72))
    cache.compact(start + dt.timedelta(days=2))
    done = cached_call(rows, "key", judge("three", "CASE WHEN n % 7 = 0 THEN 'busy' END"), cache, start + dt.timedelta(days=3, hours=12))
    return done.select("key", "hit", "reply", "error")


@query(
    "question_budget",
    """WITH n AS (SELECT count(*) AS n FROM documents),
    b AS (SELECT doc_id, text, 6 + CASE WHEN row_number() OVER (ORDER BY doc_id) <= n // 3 THEN 1 ELSE 0 END AS budget FROM documents, n),
    q AS (SELECT *, budget - least(3, greatest(1, budget // 4)) AS single_limit FROM b),
    p AS (SELECT doc_id, budget, single_limit, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM q),
    s AS (SELECT *, sum(CASE WHEN (length(t) + no) % 5 <> 0 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS cum, CASE WHEN (length(t) + no) % 5 <> 0 THEN 2 END AS items FROM p),
    sa AS (SELECT doc_id, budget, 'single' AS kind, no AS ask_no, items FROM s WHERE cum - coalesce(items, 0) < single_limit),
    g AS (SELECT doc_id, coalesce(sum(items), 0) AS got FROM sa GROUP BY 1),
    m AS (SELECT doc_id, budget, no // 2 AS ask_no, sum(length(t)) + 7 AS len FROM p GROUP BY ALL HAVING count(*) = 2),
    mc AS (SELECT *, CASE WHEN (len + ask_no) % 5 <> 0 THEN 1 END AS items, sum(CASE WHEN (len + ask_no) % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ask_no) AS cum FROM m),
    ma AS (SELECT doc_id, 'multi' AS kind, ask_no, items FROM mc JOIN g USING (doc_id) WHERE cum - coalesce(items, 0) < least(3, budget - got)),
    a AS (SELECT doc_id, kind, ask_no, items FROM sa UNION ALL SELECT * FROM ma),
    i AS (SELECT doc_id, kind, ask_no, unnest(range(items)) AS item_no FROM a WHERE items > 0)
    SELECT 'auto-' || CASE WHEN r < 10000 THEN lpad(CAST(r AS VARCHAR), 4, '0') ELSE CAST(r AS VARCHAR) END AS query_id, doc_id, kind, ask_no, item_no
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id, kind DESC, ask_no, item_no) - 1 AS r FROM i)""",
)
def question_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six or seven questions per document from its lines, by a model that gives two to a chunk, one to a pair, and fails at times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    lines = spread(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("parent_no", "content"))
    parents = lines.withColumn("chunk_id", F.col("parent_no"))

    def model(asks: DataFrame) -> DataFrame:
        good = (F.length("content") + F.col("ask_no")) % 5 != 0
        return asks.withColumn("items", F.when(good, F.when(F.col("kind") == "single", 2).otherwise(1)).cast("long")).drop("content")

    asked = generate(parents, quotas(docs, 6 * n + n // 3, 3), model, per_chunk=2, pairs=3, max_failures=1000)
    return numbered_items(asked, "auto").select("query_id", "doc_id", "kind", "ask_no", "item_no")
