"""Queries over search, fusion, merging, reranking and context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import fusion
from quire.operators.chunking import child_chunks, chunk_seq, parent_chunks, parent_key, with_quality
from quire.operators.retriever import child_metrics, retrieve
from quire.operators.search import bm25_topk, dense_topk, postings, query_terms
from quire.operators.signatures import corpus_signature
from quire.plans.common import registry, table
from quire.plans.documents import overlap_sql, split_sql
from quire.session import materialize, spread
from quire.settings import DEFAULTS

QUERIES, ORACLES, query = registry()
DIM = 16
POOL = 40


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


#: The vectors that ask: every one whose id is divisible by 100, against all.
ASKS = "{0} % 100 = 0"
#: Every vector asks, where a figure is over a whole run.
EVERY = "{0} IS NOT NULL"


def asked(e: DataFrame, asks: str = ASKS) -> DataFrame:
    """The rows of ``e`` that ask."""
    return e.where(asks.format("vec_id"))


def asking(spark: SparkSession, sf_dir: str, asks: str = ASKS) -> DataFrame:
    e = asked(embeddings(spark, sf_dir), asks)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def neighbours(spark: SparkSession, sf_dir: str, k: int, corpus: str = "true", asks: str = ASKS) -> DataFrame:
    """The k nearest other vectors of each asking vector among the rows of ``corpus``: query_id, vec_id, score, rank."""
    e = embeddings(spark, sf_dir)
    if asks == EVERY:
        # In blocks, whose lists are written one by one; a vector without numbers asks, but finds nothing.
        wanted = asking(spark, sf_dir, asks).where(F.size("query_vector") > 0)
        return dense_topk(asked(e.where(corpus), asks), wanted, k, "vec_id", "embedding", write_blocks=True, others=True)
    hits = dense_topk(e.where(corpus), asking(spark, sf_dir), k + 1, "vec_id", "embedding")
    # The vector itself is usually first; whatever its place, k others remain among k + 1.
    own = F.max(F.when(F.col("vec_id") == F.col("query_id"), F.col("rank"))).over(fusion.Window.partitionBy("query_id"))
    return (
        hits.withColumn("own", F.coalesce(own, F.lit(k + 1)))
        .where((F.col("vec_id") != F.col("query_id")) & (F.col("rank") - (F.col("own") < F.col("rank")).cast("int") <= k))
        .select("query_id", "vec_id", "score", (F.col("rank") - (F.col("own") < F.col("rank")).cast("int")).alias("rank"))
    )


DOT = "round(list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def neighbours_sql(k: int, corpus: str = "TRUE", name: str = "nb", asks: str = ASKS) -> str:
    return f"""{name} AS (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format(a='q.embedding', b='e.embedding')} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE {asks.format("q.vec_id")} AND {corpus})) WHERE rank <= {k})"""


@query(
    "dense_topk",
    f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format(a='q.embedding', b='e.embedding')} AS score FROM embeddings q, embeddings e WHERE {ASKS.format('q.vec_id')})) WHERE rank <= 10""",
)
def dense_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return dense_topk(e, asking(spark, sf_dir), 10, "vec_id", "embedding")


def bm25_sql(docs: str, queries: str, k: int, out: str) -> str:
    """CTEs for BM25 over ``docs`` (id, text) and ``queries`` (query_id, text); the last is ``out``."""
    return f"""{out}w AS MATERIALIZED (SELECT id, unnest(string_split(lower(text), ' ')) AS w FROM {docs}),
 {out}f AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(w, '[\\p{{L}}\\p{{N}}]+')) AS term FROM {out}w) GROUP BY ALL),
 {out}l AS (SELECT id, sum(tf) AS doc_len FROM {out}f GROUP BY id),
 {out}n AS (SELECT (SELECT count(*) FROM {docs}) AS n, sum(doc_len) / (SELECT count(*) FROM {docs}) AS avg_len FROM {out}l),
 {out}d AS (SELECT term, count(*) AS df FROM {out}f GROUP BY term),
 {out}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {queries}) GROUP BY ALL),
 {out}s AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
   FROM {out}q JOIN {out}d USING (term) JOIN {out}f USING (term) JOIN {out}l USING (id) CROSS JOIN {out}n GROUP BY query_id, id),
 {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {out}s) WHERE rank <= {k})"""


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


DOCS_SQL = "dc AS (SELECT doc_id AS id, text FROM documents), bq AS (SELECT item_id AS query_id, text FROM benchmark)"


@query(
    "bm25_topk",
    f"WITH {DOCS_SQL}, {bm25_sql('dc', 'bq', 10, 'bm')} SELECT query_id, id AS doc_id, score, rank FROM bm",
)
def bm25_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bm25_topk(postings(docs), query_terms(bench_queries(spark, sf_dir)), 10)


# Whole texts ask, and a query without words, whose list is filled with score 0.
@query(
    "bm25_topk_filled",
    f"""WITH dc AS (SELECT doc_id AS id, text FROM documents), bq AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1, '!!!'),
    {bm25_sql('dc', 'bq', 1000000000, 'bm')},
    al AS (SELECT q.query_id, d.id, coalesce(score, 0) AS score FROM bq q CROSS JOIN dc d LEFT JOIN bm ON bm.query_id = q.query_id AND bm.id = d.id)
    SELECT query_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM al) WHERE rank <= 10""",
)
def bm25_topk_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = bench_queries(spark, sf_dir)
    q = q.union(spark.createDataFrame([(-1, "!!!")], q.schema))
    return bm25_topk(postings(docs), query_terms(q), 10, match_only=False, queries=q)


def doc_lists(spark: SparkSession, sf_dir: str):
    """Dense and sparse rank lists over whole documents for the benchmark texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bench = bench_queries(spark, sf_dir)
    vectors = docs.select("doc_id", X.hash_embed(F.col("text"), DIM).alias("vector"))
    wanted = bench.select("query_id", X.hash_embed(F.col("query"), DIM).alias("query_vector"))
    dense = dense_topk(vectors, wanted, POOL, "doc_id").withColumnRenamed("doc_id", "key")
    sparse = bm25_topk(postings(docs), query_terms(bench), POOL).withColumnRenamed("doc_id", "key")
    return docs, bench, dense, sparse


def embed_sql(text: str) -> str:
    raw = f"list_transform(range(0, {DIM}), lambda i: CAST('0x' || substring(sha256({text}), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 255.0 - 0.5)"
    return f"(SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) FROM (SELECT {raw} AS v))"


LISTS_SQL = f"""{DOCS_SQL}, {bm25_sql('dc', 'bq', POOL, 'bm')},
 dv AS (SELECT id, list_transform(range(0, {DIM}), lambda i: CAST('0x' || substring(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / CAST(255 AS DOUBLE) - 0.5) AS v FROM dc),
 qv AS (SELECT query_id, list_transform(range(0, {DIM}), lambda i: CAST('0x' || substring(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / CAST(255 AS DOUBLE) - 0.5) AS v FROM bq),
 ds AS (SELECT query_id, id, round(list_inner_product(q.v, d.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(d.v, d.v)), 6) AS score FROM qv q, dv d),
 de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= {POOL})"""
FUSE_SQL = """hi AS (SELECT query_id, id AS key, rank, 0 AS list_no FROM de UNION ALL SELECT query_id, id, rank, 1 FROM bm),
 fu AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf_score, min(list_no * 100000 + rank) AS first_seen FROM hi GROUP BY ALL),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, first_seen, key) AS rank FROM fu)"""


@query(
    "rrf_fusion",
    f"WITH {LISTS_SQL}, {FUSE_SQL} SELECT query_id, key AS doc_id, round(rrf_score, 9) AS rrf_score, rank FROM fr WHERE rank <= 5",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, dense, sparse = doc_lists(spark, sf_dir)
    return fusion.ranked(fusion.rrf(dense, sparse), 5).select(
        "query_id", F.col("key").alias("doc_id"), F.round("rrf_score", 9).alias("rrf_score"), "rank"
    )


@query(
    "rerank_context",
    f"""WITH {LISTS_SQL}, {FUSE_SQL},
    ca AS (SELECT fr.query_id, key, fr.rank AS rrf_rank, round(CAST(length(d.text) AS DOUBLE) / (1 + abs(length(d.text) - length(q.text) * 10)), 9) AS s
           FROM fr JOIN dc d ON d.id = fr.key JOIN bq q ON q.query_id = fr.query_id WHERE fr.rank <= 40),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rrf_rank) AS rank FROM ca)
    SELECT query_id, list(key ORDER BY rank) AS doc_ids,
     sha256(string_agg('[来源' || rank || '] 文档: ' || source || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_digest
    FROM rr JOIN documents ON doc_id = key WHERE rank <= 5 GROUP BY query_id""",
)
def rerank_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bench, dense, sparse = doc_lists(spark, sf_dir)
    full = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"), "source")
    pool = fusion.ranked(fusion.rrf(dense, sparse), POOL).withColumnRenamed("rank", "rrf_rank")

    store = full.withColumnRenamed("key", "chunk_id")
    candidates = fusion.attach(pool, store.select("chunk_id", "content")).join(bench, "query_id")
    best = fusion.rerank(candidates, closeness, 5).select("query_id", "key", "rank")
    rows = fusion.attach(best, store).withColumn("title", F.lit(None).cast("string"))
    ids = rows.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("doc_ids"),
        X.context_text(F.array_sort(F.collect_list(F.struct("rank", "title", "source", "content")))).alias("context"),
    )
    return ids.select("query_id", "doc_ids", F.sha2("context", 256).alias("context_digest"))


def merge_inputs(spark: SparkSession, sf_dir: str, asks: str = ASKS) -> DataFrame:
    """Vectors as children: ten neighbours in id order form a parent."""
    return neighbours(spark, sf_dir, POOL, asks=asks).select(
        "query_id",
        F.floor(F.col("vec_id") / 10).cast("long").alias("key"),
        F.col("vec_id").alias("seq"),
        "score",
        "rank",
    )


def merge_sql(asks: str = ASKS) -> str:
    return f"""{neighbours_sql(POOL, asks=asks)},
 ch AS (SELECT query_id, vec_id // 10 AS key, vec_id AS seq, score, rank FROM nb),
 ke AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf, min(rank) AS first_rank,
   len(list_reduce(list_transform(list(seq ORDER BY score DESC, rank), lambda x: [x]), lambda a, x: CASE WHEN list_has_any(a, [x[1] - 1, x[1] + 1]) THEN a ELSE list_concat(a, x) END)) AS kept
   FROM ch GROUP BY query_id, key)"""


MERGE_SQL = merge_sql()


@query(
    "auto_merge_boost",
    f"""WITH {MERGE_SQL}, bo AS (SELECT query_id, key, first_rank, kept, CASE WHEN kept >= 2 THEN rrf * 1.2 ELSE rrf END AS s FROM ke)
    SELECT query_id, key, round(s, 9) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, first_rank, key) AS rank FROM bo) WHERE rank <= 5""",
)
def auto_merge_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = materialize(merge_inputs(spark, sf_dir), "merge-hits")
    none = dense.select("query_id", "key", "rank").limit(0)
    fused = fusion.auto_merge(fusion.rrf(dense, none), dense, 1.2)
    return fusion.ranked(fused, 5).select("query_id", "key", F.round("rrf_score", 9).alias("rrf_score"), "rank")


BOOSTS = (1.0, 1.1, 1.2, 1.3, 1.5, 2.0)


@query(
    "boost_grid",
    f"""WITH {MERGE_SQL}, bs AS (SELECT unnest([1.0, 1.1, 1.2, 1.3, 1.5, 2.0]) AS boost),
    bo AS (SELECT boost, query_id, key, first_rank, CASE WHEN kept >= 2 THEN rrf * CAST(boost AS DOUBLE) ELSE rrf END AS s FROM ke, bs),
    rk AS (SELECT *, row_number() OVER (PARTITION BY boost, query_id ORDER BY round(s, 9) DESC, first_rank, key) AS rank FROM bo),
    me AS (SELECT boost, query_id, max(CASE WHEN key = query_id // 10 THEN 1.0 / rank ELSE 0 END) AS mrr FROM rk WHERE rank <= 5 GROUP BY ALL)
    SELECT CAST(boost AS DOUBLE) AS boost, count(*) AS queries, round(avg(mrr), 6) AS mrr FROM me GROUP BY boost""",
)
def boost_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = materialize(merge_inputs(spark, sf_dir), "grid-hits")
    fused = fusion.rrf(dense, dense.select("query_id", "key", "rank").limit(0))
    kept = fusion.parent_hits(dense)
    # All boosts in one job: every candidate row is repeated per grid value.
    grid = fused.join(kept, ["query_id", "key"]).withColumn("boost", F.explode(F.array(*[F.lit(b) for b in BOOSTS])))
    scored = grid.withColumn(
        "s", F.when(F.col("kept") >= 2, F.col("rrf_score") * F.col("boost")).otherwise(F.col("rrf_score"))
    )
    order = fusion.Window.partitionBy("boost", "query_id").orderBy(F.desc(F.round("s", 9)), "first_rank", "key")
    top = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    per = top.groupBy("boost", "query_id").agg(
        F.max(F.when(F.col("key") == F.floor(F.col("query_id") / 10), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")
    )
    return per.groupBy("boost").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query(
    "corpus_signature",
    """WITH h AS (SELECT sha256(doc_id || ':' || text) AS h FROM documents),
    s AS (SELECT count(*) AS n, list_transform(range(0, 8), lambda i: 0) AS z,
      """ + ", ".join(f"sum(CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT)) AS s{i}" for i in range(8)) + """ FROM h)
    SELECT n AS chunks, left(sha256(concat_ws('|', CAST(n AS VARCHAR), """ + ", ".join(f"CAST(s{i} AS VARCHAR)" for i in range(8)) + """)), 12) AS signature FROM s""",
)
def corpus_signature_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return corpus_signature(docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content")))


HYBRID_LISTS = f"""WITH bq AS (SELECT item_id AS query_id, text FROM benchmark),
 sm AS (SELECT CAST(doc_id AS VARCHAR) AS k, text AS content FROM documents WHERE length(text) // 2 < 200),
 lg AS (SELECT CAST(doc_id AS VARCHAR) AS k, text AS content FROM documents WHERE length(text) // 2 >= 200),
 {split_sql('sm', 300, 'xs')}, {split_sql('lg', 1200, 'xl')},
 sp AS (SELECT xs.k || ':' || piece_no AS chunk_id, xs.k AS doc_id, piece_no, {overlap_sql('sm.content', 'start', 'xs.content', 50)} AS content FROM xs JOIN sm ON sm.k = xs.k),
 lp AS (SELECT k || ':p' || piece_no AS chunk_id, k AS doc_id, piece_no, content FROM xl),
 cs AS (SELECT chunk_id AS k, content FROM lp), {split_sql('cs', 300, 'xc')},
 ch AS (SELECT chunk_id AS id, chunk_id AS parent, content AS text FROM sp
   UNION ALL SELECT xc.k || ':c' || piece_no, xc.k, {overlap_sql('cs.content', 'start', 'xc.content', 50)} FROM xc JOIN cs ON cs.k = xc.k),
 dc AS (SELECT chunk_id AS id, content AS text FROM sp UNION ALL SELECT chunk_id, content FROM lp),
 {bm25_sql('dc', 'bq', POOL, 'bm')},
 dv AS (SELECT id, parent, list_transform(range(0, {DIM}), lambda i: CAST('0x' || substring(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / CAST(255 AS DOUBLE) - 0.5) AS v FROM ch),
 qv AS (SELECT query_id, list_transform(range(0, {DIM}), lambda i: CAST('0x' || substring(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / CAST(255 AS DOUBLE) - 0.5) AS v FROM bq),
 ds AS (SELECT query_id, id, parent, round(list_inner_product(q.v, d.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(d.v, d.v)), 6) AS score FROM qv q, dv d),
 de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= {POOL}),
 hi AS (SELECT query_id, parent AS key, rank, 0 AS list_no FROM de UNION ALL SELECT query_id, id, rank, 1 FROM bm),
 fu AS (SELECT query_id, key, sum(1.0 / (60 + rank)) AS rrf_score, min(list_no * 100000 + rank) AS first_seen FROM hi GROUP BY ALL)"""
HYBRID_SQL = f"""{HYBRID_LISTS},
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, first_seen, key) AS rank FROM fu)
 SELECT query_id, rank, key AS chunk_id, round(rrf_score, 9) AS rrf_score, length(dc.text) AS n_chars FROM fr JOIN dc ON dc.id = key WHERE rank <= 5"""


def hybrid_lists(spark: SparkSession, sf_dir: str):
    """Queries, dense child hits, sparse parent hits and the written parents of the documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # Parents feed the children, the postings and the final fetch, so they are written once.
    parents = materialize(parent_chunks(with_quality(docs)), "parents")
    children = child_chunks(parents).select("chunk_id", "parent_id", X.hash_embed(F.col("content"), DIM).alias("vector"))
    bench = bench_queries(spark, sf_dir)
    wanted = bench.select("query_id", X.hash_embed(F.col("query"), DIM).alias("query_vector"))
    # The parent's id is the child's id without its last segment, so hits need no join back to the children.
    dense = dense_topk(children.select("chunk_id", "vector"), wanted, POOL).select(
        "query_id",
        parent_key(F.nullif(F.regexp_extract("chunk_id", r"^(.*):c[0-9]+$", 1), F.lit("")), F.col("chunk_id")).alias("key"),
        chunk_seq(F.col("chunk_id")).alias("seq"),
        "score",
        "rank",
    )
    sparse = bm25_topk(postings(parents, "chunk_id", "content"), query_terms(bench), POOL).withColumnRenamed("doc_id", "key")
    return bench, dense, sparse, parents


@query("hybrid_retrieve", HYBRID_SQL)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, dense children and sparse parents, fusion at parent level, top five parents."""
    _, dense, sparse, parents = hybrid_lists(spark, sf_dir)
    top = fusion.ranked(fusion.rrf(dense, sparse), 5)
    return fusion.attach(top, parents.select("chunk_id", "content")).select(
        "query_id", "rank", F.col("key").alias("chunk_id"), F.round("rrf_score", 9).alias("rrf_score"),
        F.length("content").alias("n_chars"),
    )


def closeness(query, text):
    """Stand-in for a pair model: how near a text is to ten times the length of its query."""
    return F.length(text).cast("double") / (1 + F.abs(F.length(text) - F.length(query) * 10))


@query(
    "retrieve_merged",
    f"""{HYBRID_LISTS},
 sq AS (SELECT query_id, parent AS key, score, rank, coalesce(TRY_CAST(regexp_replace(regexp_extract(id, '([^:]*)$', 1), '[^0-9]', '', 'g') AS BIGINT), 0) AS seq FROM de),
 ke AS (SELECT query_id, key, len(list_reduce(list_transform(list(seq ORDER BY score DESC, rank), lambda x: [x]), lambda a, x: CASE WHEN list_has_any(a, [x[1] - 1, x[1] + 1]) THEN a ELSE list_concat(a, x) END)) AS kept
   FROM sq GROUP BY query_id, key),
 bo AS (SELECT fu.*, CASE WHEN kept >= 2 THEN rrf_score * 1.2 ELSE rrf_score END AS s, count(*) OVER (PARTITION BY query_id) AS n_recalled FROM fu LEFT JOIN ke USING (query_id, key)),
 po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, first_seen, key) AS rrf_rank FROM bo),
 sc AS (SELECT po.*, round(CAST(length(dc.text) AS DOUBLE) / (1 + abs(length(dc.text) - length(bq.text) * 10)), 9) AS pair FROM po JOIN dc ON dc.id = po.key JOIN bq USING (query_id) WHERE rrf_rank <= 40),
 re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair DESC, rrf_rank) AS rank FROM sc)
 SELECT query_id, rank, key AS chunk_id, rrf_rank, round(s, 9) AS rrf_score, n_recalled FROM re WHERE rank <= 5""",
)
def retrieve_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval: fusion, auto-merge by 1.2, forty candidates reranked, the best five."""
    bench, dense, sparse, parents = hybrid_lists(spark, sf_dir)
    found = retrieve(bench, dense, sparse, parents.select("chunk_id", "content"), 5, closeness, cfg=replace(DEFAULTS, merge_boost=1.2))
    recalled = found.recalled.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_recalled"))
    return found.top.join(recalled, "query_id").select(
        "query_id", "rank", F.col("key").alias("chunk_id"), "rrf_rank", F.round("rrf_score", 9).alias("rrf_score"), "n_recalled"
    )


@query(
    "child_metrics",
    f"""WITH {neighbours_sql(POOL)}, lb AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e ON e.vec_id // 50 = q.vec_id // 50 AND e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT lb.query_id, count(*) AS n_expected, CASE WHEN count(nb.vec_id) > 0 THEN 1 ELSE 0 END AS child_hit_at_k, round(count(nb.vec_id) / count(*), 6) AS child_recall_at_k
    FROM lb LEFT JOIN nb ON nb.query_id = lb.query_id AND nb.vec_id = lb.vec_id AND nb.rank <= 20 GROUP BY lb.query_id""",
)
def child_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors in a row form a file, whose members are the labelled children of its asking vector; the first 20 of 40 hits count."""
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("child_id"), F.floor(F.col("vec_id") / 50).alias("file"))
    mine = asked(embeddings(spark, sf_dir)).select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 50).alias("file"))
    labels = mine.join(e, "file").where("child_id <> query_id")  # fifty rows per asking vector
    hits = neighbours(spark, sf_dir, POOL).withColumnRenamed("vec_id", "child_id")
    return child_metrics(hits, labels).withColumn("child_recall_at_k", F.round("child_recall_at_k", 6))


@query(
    "ordered_fetch",
    f"""WITH {neighbours_sql(5)} SELECT nb.query_id, nb.rank, d.doc_id, length(d.text) AS n_chars FROM nb JOIN documents d ON d.doc_id = nb.vec_id * 3""",
)
def ordered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch by id in input order; ids without a row are dropped."""
    hits = neighbours(spark, sf_dir, 5).select("query_id", "rank", (F.col("vec_id") * 3).alias("key"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("n_chars"))
    return fusion.attach(hits, docs).select("query_id", "rank", F.col("key").alias("doc_id"), "n_chars")


@query(
    "parent_children",
    "SELECT CAST(floor(vec_id / 10) AS BIGINT) AS parent_id, list(vec_id ORDER BY vec_id) AS children FROM embeddings GROUP BY 1",
)
def parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every parent in sequence order; a parent has ten children here, a chunk's parent a few dozen."""
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("parent_id"),
        F.concat(F.lit("d:p"), F.floor(F.col("vec_id") / 10), F.lit(":c"), F.col("vec_id")).alias("chunk_id"),
    )
    kids = e.groupBy("parent_id").agg(F.array_sort(F.collect_list(chunk_seq(F.col("chunk_id")))).alias("children"))
    return kids.select("parent_id", "children")
