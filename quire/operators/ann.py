"""Approximate vector search over an index of inverted lists that is written once and pruned by list when it is searched.

A coarse quantiser (centroids of a bounded sample) sends every row to the list of its nearest centroid. Lists are folders, so a
search reads only those that some query probes. Long lists are dealt to tasks in parts and many queries of a list in blocks: a
task holds one part and one block, whatever the size of a list, and gives its best k rows per query.

The number of probed lists is not guessed: ``tuned`` takes a bounded sample of queries, searches them exactly, and counts in which
of their nearest lists the true neighbours lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.operators.search import _Best, dense_topk
from quire.session import ship_by_value

#: Rows that the quantiser is fitted on at most, and lists at most: centroids are sent to every executor.
SAMPLE_ROWS = 50_000
MAX_LISTS = 4096
#: Rows of a list and queries of a list that one task holds about.
PART_ROWS = 20_000
BLOCK_QUERIES = 2_000
#: Queries that are searched exactly to choose the number of probed lists.
TUNE_QUERIES = 200


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector, nearest first; of equal ones the smaller number."""
    distance = (centroids**2).sum(1)[None, :] - 2 * vectors @ centroids.T
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; a centroid that loses all rows restarts at the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        at = _nearest(sample, centroids, 1)[:, 0]
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-((sample - centroids[at]) ** 2).sum(1), kind="stable")
            centroids[~full] = sample[far[: (~full).sum()]]
    return centroids


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class InvertedLists:
    """An index at ``path``: folder ``lists`` with rows by list, table ``centroids`` and table ``sizes``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # at most MAX_LISTS
        self.centroids = np.array([r["vector"] for r in rows], dtype=np.float64)

    @classmethod
    def build(cls, rows: DataFrame, path: str, row_id: str = "chunk_id", vector: str = "vector", lists: int | None = None) -> InvertedLists:
        """Index every row with a vector. The default number of lists is the square root of the number of rows."""
        ship_by_value(__name__)
        ship_by_value("quire.operators.search")
        spark, path = rows.sparkSession, path.rstrip("/")
        corpus = rows.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") > 0)
        n = corpus.count()
        lists = max(1, min(lists or int(math.sqrt(n)), MAX_LISTS, n))
        key = F.xxhash64("row_id")
        chance = min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1))
        sample = corpus.where(F.pmod(key, F.lit(1 << 30)) < int(chance * (1 << 30))).orderBy(key, "row_id").limit(SAMPLE_ROWS).select("vector").collect()
        centroids = fit_centroids(np.array([r[0] for r in sample], dtype=np.float64), lists) if n else np.zeros((0, 1))
        spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "list int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    at = _nearest(_matrix(batch.column(1), batch.num_rows), shared.value, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["row_id", "vector", "list"])

        schema = T.StructType([*corpus.schema.fields, T.StructField("list", T.IntegerType())])
        placed = corpus.mapInArrow(assign, schema).hint("rebalance", "list")  # a list that is too large for one task is split
        placed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        spark.read.schema(schema).parquet(f"{path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/lists").parquet(f"{self.path}/lists")

    def probes(self, queries: DataFrame, n: int, query_id: str, query_vector: str) -> DataFrame:
        """``query_id, query_vector, list, nth``: the ``n`` nearest lists of every query."""
        shared = self.spark.sparkContext.broadcast(self.centroids)
        narrow = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("query_vector")).where(F.size("query_vector") > 0)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = _nearest(_matrix(batch.column(1), batch.num_rows), shared.value, n)
                    width = near.shape[1]
                    owner = pa.array(np.repeat(np.arange(batch.num_rows), width))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(owner) for c in batch.columns), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), batch.num_rows))],
                        names=["query_id", "query_vector", "list", "nth"],
                    )

        return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("nth", T.IntegerType())]))

    def search(self, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """``query_id, row_id, score, rank``: the best ``k`` rows of the probed lists by inner product, ties to the smaller id."""
        asked = self.probes(queries, probes, query_id, query_vector).drop("nth")
        wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("q"))
        sizes = self.spark.read.parquet(f"{self.path}/sizes").join(wanted, "list").collect()  # at most MAX_LISTS rows
        plan = self.spark.createDataFrame(
            [(r["list"], -(-r["n"] // PART_ROWS), -(-r["q"] // BLOCK_QUERIES)) for r in sizes], "list int, parts int, blocks int"
        )
        corpus = self.rows().where(F.col("list").isin([r["list"] for r in sizes]))  # prunes folders
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = corpus.join(F.broadcast(plan), "list").select("list", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"), "row_id", "vector")
        right = asked.join(F.broadcast(plan), "list").select("list", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "query_vector")
        q_type, r_type = right.schema["query_id"].dataType, left.schema["row_id"].dataType
        q_arrow, r_arrow = to_arrow_type(q_type), to_arrow_type(r_type)
        names = ["query_id", "row_id", "score"]

        def score(rows: pa.Table, asks: pa.Table) -> pa.Table:
            ids = asks.column("query_id").to_pylist()
            best = _Best(len(ids), k)
            if len(ids) and rows.num_rows:
                matrix = _matrix(asks.column("query_vector").combine_chunks(), len(ids))
                for a in range(0, rows.num_rows, 2048):
                    part = rows.slice(a, 2048)
                    own = part.column("row_id").to_numpy()
                    best.add(matrix @ _matrix(part.column("vector").combine_chunks(), part.num_rows).T, own.astype("U") if own.dtype == object else own)
            best.settle()
            found = [] if best.ids is None else best.ids.tolist()
            return pa.Table.from_arrays([pa.array([ids[i] for i in best.query], q_arrow), pa.array(found, r_arrow), pa.array(best.score, pa.float64())], names=names)

        by = ["list", "part", "block"]
        schema = T.StructType([T.StructField("query_id", q_type), T.StructField("row_id", r_type), T.StructField("score", T.DoubleType())])
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")  # a query's rows: k per part that it met
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def tuned(self, queries: DataFrame, k: int, target: float = 0.95, query_id: str = "query_id", query_vector: str = "query_vector") -> int:
        """The least number of lists whose probing finds a share ``target`` of the exact neighbours of a sample of the queries."""
        sample = queries.orderBy(F.xxhash64(query_id), query_id).limit(TUNE_QUERIES)
        exact = dense_topk(self.rows(), sample, k, "row_id", "vector", query_id, query_vector).select(F.col(query_id).alias("query_id"), "row_id")
        at = self.rows().select("row_id", "list").join(F.broadcast(exact), "row_id")  # k rows per query of the sample
        near = self.probes(sample, len(self.centroids), query_id, query_vector).select("query_id", "list", "nth")
        counts = at.join(near, ["query_id", "list"]).groupBy("nth").count().orderBy("nth").collect()
        total, seen = sum(r["count"] for r in counts), 0
        for r in counts:
            seen += r["count"]
            if seen >= target * total:
                return r["nth"] + 1
        return max(1, len(self.centroids))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``pairs`` (exact ones) and ``hits`` (those that were found) over all queries; both have ``query_id, row_id``."""
    hit = found.select("query_id", "row_id", F.lit(1).alias("hit"))
    return exact.select("query_id", "row_id").join(hit, ["query_id", "row_id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
