"""Queries over written indexes: approximate vectors, fetch by key, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import ann
from quire.operators.search import dense_topk
from quire.plans.common import registry, table
from quire.plans.retrieval import DOT
from quire.session import materialize, shared_dir
from quire.sources.lookup import KeyedTable
from quire.sources.snapshots import SnapshotStore

QUERIES, ORACLES, query = registry()


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "ann_recall",
    f"""WITH x AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT.format(a='q.embedding', b='e.embedding')} DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
    SELECT (SELECT count(*) FROM embeddings) AS indexed, count(DISTINCT query_id) AS asked, count(*) AS pairs, TRUE AS reached FROM x WHERE rank <= 10""",
)
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the inverted lists against the exact search, over all vectors with an id divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.InvertedLists.build(e, _new(spark, "ann"), "vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = index.search(q, 10, index.tuned(q, 10))
    exact = materialize(dense_topk(e, q, 10, "vec_id", "embedding").select("query_id", F.col("vec_id").alias("row_id")), "ann-exact")
    figure = ann.recall(found, exact)
    return figure.crossJoin(exact.agg(F.count_distinct("query_id").alias("asked"))).crossJoin(index.rows().agg(F.count(F.lit(1)).alias("indexed"))).select(
        "indexed", "asked", "pairs", (F.col("hits") >= 0.9 * F.col("pairs")).alias("reached")  # one row each
    )


@query(
    "point_lookup",
    "SELECT d.doc_id, d.lang, length(d.text) AS n FROM documents d WHERE d.doc_id IN (SELECT item_id * 3 FROM benchmark)",
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fetched by the keys that the benchmark gives, from a table laid out by key."""
    keyed = KeyedTable.write(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _new(spark, "keyed"), "doc_id")
    return keyed.fetch(table(spark, sf_dir, "benchmark").select(F.col("item_id") * 3)).select("doc_id", "lang", F.length("text").alias("n"))


@query(
    "snapshot_restore",
    """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0),
    s AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL THEN 'copy' WHEN a.text <> b.text THEN 'replace' ELSE 'keep' END AS action, a.text FROM a FULL JOIN b ON a.path = b.path)
    SELECT path, action, sha256(text) AS restored FROM s""",
)
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, a second one with changed, missing and new files, and the way back to the first with its result."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    store = SnapshotStore(spark, _new(spark, "snapshots"))
    store.take("first", files.where("doc_id % 7 <> 0").select("path", "content"))
    content = F.when(F.col("doc_id") % 5 == 0, F.upper("content")).otherwise(F.col("content"))
    later = files.where("doc_id % 3 <> 0").select("path", content.alias("content"))
    now = store.take("second", later)
    steps = store.difference("first", now).select("path", "action")
    back = store.restore("first", later).select("path", F.sha2("content", 256).alias("restored"))
    return steps.join(back, "path", "left")
