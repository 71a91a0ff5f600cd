"""Queries over run reports, choices, question items and the Okapi form of sparse search."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import fusion, observe
from quire.operators import reports as R
from quire.operators.search import bm25_topk, postings, query_terms
from quire.plans.common import registry, table
from quire.plans.evaluation import CALLS, _calls
from quire.plans.retrieval import BOOSTS, EVERY, asked, bench_queries, embeddings, merge_inputs, merge_sql
from quire.session import materialize, shared_dir, spread
from quire.sources.store import ChunkStore, record_run

QUERIES, ORACLES, query = registry()


@query(
    "best_boost",
    f"""WITH {merge_sql(EVERY)}, bs AS (SELECT unnest([1.0, 1.1, 1.2, 1.3, 1.5, 2.0]) AS boost),
    bo AS (SELECT boost, query_id, key, first_rank, CASE WHEN kept >= 2 THEN rrf * CAST(boost AS DOUBLE) ELSE rrf END AS s FROM ke, bs),
    rk AS (SELECT *, row_number() OVER (PARTITION BY boost, query_id ORDER BY round(s, 9) DESC, first_rank, key) AS rank FROM bo),
    me AS (SELECT boost, query_id, max(CASE WHEN key = query_id // 10 THEN 1 ELSE 0 END) AS hit FROM rk WHERE rank <= 5 GROUP BY ALL),
    ag AS (SELECT CAST(boost AS DOUBLE) AS boost, round(avg(hit), 6) AS recall_at_k FROM me GROUP BY boost)
    SELECT boost, recall_at_k FROM ag ORDER BY recall_at_k DESC, boost LIMIT 1""",
)
def best_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost with the highest recall over all vectors; one without numbers counts as not found."""
    dense = materialize(merge_inputs(spark, sf_dir, EVERY), "grid-hits")
    fused = fusion.rrf(dense, dense.select("query_id", "key", "rank").limit(0))
    grid = fused.join(fusion.parent_hits(dense), ["query_id", "key"]).withColumn("boost", F.explode(F.array(*[F.lit(b) for b in BOOSTS])))
    s = F.when(F.col("kept") >= 2, F.col("rrf_score") * F.col("boost")).otherwise(F.col("rrf_score"))
    order = fusion.Window.partitionBy("boost", "query_id").orderBy(F.desc(F.round(s, 9)), "first_rank", "key")
    hit = (F.col("key") == F.floor(F.col("query_id") / 10)).cast("int")
    per = grid.withColumn("rank", F.row_number().over(order)).where("rank <= 5").groupBy("boost", "query_id").agg(F.max(hit).alias("hit"))
    queries = asked(embeddings(spark, sf_dir), EVERY).agg(F.count_distinct("vec_id").alias("queries"))  # one row
    sums = per.groupBy("boost").agg(F.sum("hit").alias("hits")).crossJoin(queries)
    return R.best_setting(sums.select("boost", F.round(F.col("hits") / F.col("queries"), 6).alias("recall_at_k")), "boost")


@query(
    "top_reasons",
    """SELECT backend, reason, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY n DESC, reason) AS rank
    FROM (SELECT event_type AS backend, concat('code-', CAST(floor(value / 7) AS BIGINT)) AS reason, count(*) AS n FROM events WHERE value < 100 GROUP BY ALL)) WHERE rank <= 5""",
)
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value < 100").selectExpr("event_type AS backend", "concat('code-', CAST(floor(value / 7) AS BIGINT)) AS reason")
    return R.top_reasons(e, ["backend"], "reason")


@query(
    "run_scalars",
    f"""WITH c AS (SELECT {CALLS} FROM events),
    a AS (SELECT sum(input_tokens) AS tin, sum(output_tokens) AS tout, count(*) FILTER (is_retry) AS rt FROM c),
    m AS (SELECT 'cost.total_input_tokens' AS metric, CAST(tin AS DOUBLE) AS value FROM a UNION ALL SELECT 'cost.total_output_tokens', tout FROM a UNION ALL SELECT 'cost.retry_count', rt FROM a
     UNION ALL SELECT concat('attribution.', kind), count(*) FROM c WHERE is_error OR is_retry GROUP BY 1
     UNION ALL SELECT concat('verdict.', CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END), count(*) FROM labels GROUP BY 1)
    SELECT metric, value, CASE WHEN starts_with(metric, 'cost.') THEN 'cost' WHEN starts_with(metric, 'attribution.') THEN 'attribution' ELSE 'layer2' END AS section FROM m""",
)
def run_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    cost = observe.cost_summary(calls).select("total_input_tokens", "total_output_tokens", "retry_count")
    verdicts = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    rows = R.scalars(cost, "cost.").union(R.counted(calls.where("is_error OR is_retry"), "kind", "attribution.")).union(R.counted(verdicts, "verdict", "verdict."))
    return rows.withColumn("section", R.section(F.col("metric")))


RUNS = "SELECT doc_id AS query_id, CASE WHEN {cut} THEN '' ELSE left(sha256({text}), 12) END AS signature FROM documents WHERE doc_id % 7 <> {skip}"


@query(
    "compare_flags",
    f"""WITH a AS ({RUNS.format(cut='FALSE', text='text', skip=1)}), b AS ({RUNS.format(cut="lang = 'es'", text="CASE WHEN lang = 'de' THEN upper(text) ELSE text END", skip=2)})
    SELECT count(*) FILTER (nullif(a.signature, '') = nullif(b.signature, '')) AS matched, count(a.query_id) AS total_a, count(b.query_id) AS total_b,
     count(*) FILTER (nullif(a.signature, '') = nullif(b.signature, '')) > 0 AS alignable, FALSE AS comparable, count(*) FILTER (nullif(a.signature, '') = nullif(b.signature, '')) < 6 AS degenerated
    FROM a FULL JOIN b USING (query_id)""",
)
def compare_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 7 <> 1").selectExpr("doc_id AS query_id", "left(sha2(text, 256), 12) AS signature")
    b = d.where("doc_id % 7 <> 2").selectExpr(
        "doc_id AS query_id", "CASE WHEN lang = 'es' THEN '' ELSE left(sha2(CASE WHEN lang = 'de' THEN upper(text) ELSE text END, 256), 12) END AS signature"
    )
    return R.compare_flags(a, b, "corpus-1", "corpus-2")


@query(
    "live_delta",
    """WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE CAST(quality AS DOUBLE) END AS f, n_chars / 100 AS r FROM labels JOIN documents USING (doc_id)),
    b AS (SELECT doc_id, length(text) / 200 AS r, CASE WHEN lang = 'fr' THEN NULL ELSE 0.5 END AS f FROM documents WHERE lang <> 'es'), j AS (SELECT a.f AS af, a.r AS ar, b.f AS bf, b.r AS br FROM a JOIN b USING (doc_id))
    SELECT 'faithfulness' AS metric, round(avg(af - bf), 6) AS delta, count(*) AS matching FROM j UNION ALL SELECT 'retrieve_ms', round(avg(ar - br), 6), count(*) FROM j""",
)
def live_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    now = d.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("doc_id AS query_id", "CASE WHEN toxic = 1 THEN NULL ELSE CAST(quality AS DOUBLE) END AS faithfulness", "n_chars / 100 AS retrieve_ms")
    old = d.where("lang <> 'es'").selectExpr("doc_id AS query_id", "CASE WHEN lang = 'fr' THEN NULL ELSE 0.5D END AS faithfulness", "length(text) / 200 AS retrieve_ms")
    return R.live_delta(now, old, ["faithfulness", "retrieve_ms"]).withColumn("delta", F.round("delta", 6))


@query(
    "question_items",
    """SELECT conv_id, turn, trim(text) AS query, CASE WHEN role = 'user' THEN 'fact' ELSE trim(left(text, 20)) END AS reference_facts, CASE WHEN turn % 3 = 0 THEN 'multi_hop' ELSE 'factual' END AS question_type
    FROM conversations WHERE trim(text) <> ''""",
)
def question_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    one = F.when(
        F.col("role") == "user",
        F.to_json(F.struct(F.col("text").alias("query"), F.lit("fact").alias("reference_facts"), F.when(F.col("turn") % 3 == 0, " Multi_Hop ").otherwise("odd").alias("question_type"))),
    ).otherwise(
        F.to_json(F.struct(F.col("text").alias("question"), F.expr("left(text, 20)").alias("expected_answer"), F.when(F.col("turn") % 3 == 0, "multi_hop").alias("question_type")))
    )
    reply = F.concat(F.lit('{"questions": ['), one, F.lit(', {"query": "  "}, {"question": ""}]}'))
    return c.select("conv_id", "turn", F.inline(R.questions(reply)))


@query(
    "swapped_terms",
    "SELECT doc_id, contains(text, 'the') OR contains(replace(text, 'the', 'der'), 'der') AS hit, sha256(replace(replace(text, 'the', 'der'), 'der', 'la')) AS digest FROM documents",
)
def swapped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, hit = R.swapped(F.col("text"), [("the", "der"), ("der", "la")])
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("hit"), F.sha2(text, 256).alias("digest"))


@query(
    "wrong_chunks",
    """WITH c AS (SELECT item_id AS query_id, unnest([item_id, item_id + 1, item_id // 2]) AS chunk_id FROM benchmark)
    SELECT query_id, chunk_id, place FROM (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM (SELECT DISTINCT query_id FROM c) c, documents
     WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.query_id = c.query_id AND x.chunk_id = documents.doc_id)) WHERE place <= 5""",
)
def wrong_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    correct = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array("item_id", F.col("item_id") + 1, F.floor(F.col("item_id") / 2))).alias("chunk_id"))
    return R.wrong_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), correct)


@query(
    "gold_pairs",
    "SELECT page_id, doc_id, length(html) AS n_html, n_chars FROM pages JOIN documents ON doc_id = page_id * 2 WHERE lang <> 'de'",
)
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("corpus/html/doc."), F.col("page_id") * 2, F.lit(".html")).alias("path"), F.col("html").alias("text"))
    gold = table(spark, sf_dir, "documents").where("lang <> 'de'").select(F.concat(F.lit("gold/doc."), F.col("doc_id"), F.lit(".md")).alias("path"), "text")
    out = R.gold_pairs(parsed, gold)
    return out.select("page_id", F.regexp_extract("stem", "([0-9]+)$", 1).cast("long").alias("doc_id"), F.length("text").alias("n_html"), F.length("gold").alias("n_chars"))


@query(
    "judge_context",
    """SELECT conv_id, sha256(string_agg('[来源' || (turn + 1) || ' | chunk_id: c' || turn || ' | 文档: ' || CASE WHEN role = 'user' THEN role ELSE '未知来源' END || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest
    FROM conversations GROUP BY conv_id HAVING max(turn) = count(*) - 1""",
)
def judge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.struct("turn", F.concat(F.lit("c"), "turn").alias("chunk_id"), F.when(F.col("role") == "user", "").alias("title"), F.when(F.col("role") == "user", F.col("role")).alias("source"), F.col("text").alias("content"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks")).where("element_at(chunks, -1).turn = size(chunks) - 1")
    return c.select("conv_id", F.sha2(R.judge_context(F.col("chunks")), 256).alias("digest"))


@query(
    "subset_results",
    """SELECT subset, query_id, n_chars FROM (SELECT 'public' AS subset, doc_id AS query_id, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'local', doc_id, n_chars FROM documents WHERE lang <> 'en')
    WHERE query_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def subset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "n_chars", "lang")
    both = R.subset_union({"public": d.where("lang = 'en'"), "local": d.where("lang <> 'en'")})
    return R.of_subset(both, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("query_id"))).select("subset", "query_id", "n_chars")


@query("seeded_slice", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 25")
def seeded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seeded_slice(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42, 25)


@query(
    "bm25_okapi",
    """WITH w AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS w FROM documents),
    f AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(w, '[\\p{L}\\p{N}]+')) AS term FROM w) GROUP BY ALL),
    l AS (SELECT id, sum(tf) AS doc_len FROM f GROUP BY id), n AS (SELECT (SELECT count(*) FROM documents) AS n, sum(doc_len) / (SELECT count(*) FROM documents) AS avg_len FROM l),
    d AS MATERIALIZED (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM f, n GROUP BY term, n), m AS (SELECT 0.25 * avg(raw) AS floor_idf FROM d),
    q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, id, round(sum(qtf * CASE WHEN raw < 0 THEN floor_idf ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
      FROM q JOIN d USING (term) JOIN f USING (term) JOIN l USING (id) CROSS JOIN n CROSS JOIN m GROUP BY query_id, id)
    SELECT query_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
)
def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bm25_topk(postings(docs), query_terms(bench_queries(spark, sf_dir)), 10, idf="okapi")


@query(
    "chunk_store",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b2' ELSE 'b1' END AS batch, CASE WHEN doc_id % 2 = 0 THEN length(text) + 1 ELSE length(text) END AS n_chars
    FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0""",
)
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches with an overlap and a rollback; what the store shows in the end."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    store = ChunkStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    again = docs.where("CAST(doc_id AS BIGINT) % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    for n, (batch, rows) in enumerate({"b1": docs, "b2": again}.items()):
        parents = rows.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"))
        children = rows.select(F.concat("doc_id", F.lit(":c0")).alias("chunk_id"), "doc_id", F.col("doc_id").alias("parent_id"), F.col("text").alias("content"))
        store.ingest(parents, children, batch, start + dt.timedelta(hours=n))
    store.rollback(docs.where("CAST(doc_id AS BIGINT) % 5 = 0"), start + dt.timedelta(hours=3))
    live = store.parents().groupBy("doc_id", "batch").agg(F.sum(F.length("content")).alias("n_chars"))
    return live.select("doc_id", "batch", "n_chars")


@query(
    "run_history",
    """SELECT 'run' || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS run_id, n AS day, round(v, 6) AS mrr FROM (SELECT row_number() OVER (ORDER BY lang) AS n, avg(n_chars) AS v FROM documents GROUP BY lang) ORDER BY n DESC LIMIT 3""",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per language under the same name; names are made unique and the newest three are kept."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    by_lang = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mrr"))
    for n, row in enumerate(by_lang.orderBy("lang").collect(), 1):  # one row per language
        run = spark.range(1).select(F.lit("run").alias("run_id"), F.lit(f"2024-01-{n:02d} 00:00:00").cast("timestamp").alias("ts"), F.lit(row["mrr"]).alias("mrr"))
        history = record_run(spark, path, run, keep=3)
    return history.select("run_id", F.dayofmonth("ts").alias("day"), F.round("mrr", 6).alias("mrr"))
