"""Queries over the event table: windows, sessions, expiry."""

from __future__ import annotations

import datetime as dt
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ordered import cumulative
from quire.plans.common import registry, table
from quire.session import materialize, shared_dir
from quire.sources.store import ChunkStore
from quire.streaming import breaker, jobs

QUERIES, ORACLES, query = registry()


WINDOWS_SQL = "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _stamped(df: DataFrame, column: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    return df.select(F.unix_micros(F.col(column).cast("timestamp")).alias("start_us"), *rest)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query("events_window", WINDOWS_SQL)
def events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(jobs.panel(_events(spark, sf_dir)), "window_start")


# Append mode gives a window only once the watermark (newest time seen, less ten minutes) has passed its end.
@query(
    "events_window_stream",
    WINDOWS_SQL.replace("FROM events", "FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"),
)
def events_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(source.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    )
    job = jobs.start_panel(stream, f"{root}/out", f"{root}/checkpoint")
    job.awaitTermination()
    return _stamped(spark.read.parquet(f"{root}/out"), "window_start")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS events FROM s GROUP BY user_id, n""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(jobs.sessions(_events(spark, sf_dir)), "session_start")


@query(
    "ttl_cleanup",
    "SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTE",
)
def ttl_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "signup", "suspending").otherwise("indexed").alias("status"), F.col("ts").cast("timestamp").alias("at")
    )
    return jobs.suspended_too_long(states, dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc)).select("event_id")


BREAKER_PARTS = 3


@query(
    "circuit_breaker_stream",
    """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, value >= 40 AS ok FROM events),
    r AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM o),
    f AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id, island ORDER BY seq) AS run FROM r WHERE NOT ok)
    SELECT user_id AS backend, min(seq) AS opened_at FROM f WHERE run >= 3 GROUP BY user_id""",
)
def circuit_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt at which each user's breaker opened first, by a stream that is stopped and started again between parts."""
    root = f"{shared_dir(spark)}/breaker-{uuid.uuid4().hex}"
    counts = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", F.lit(1).alias("c"))
    outcomes = materialize(
        cumulative(counts, ["user_id"], "event_id", "c").select(
            F.col("user_id").alias("backend"), F.col("cum").alias("seq"), (F.col("value") >= 40).alias("ok"), F.lit("").alias("category"), F.col("ts").cast("timestamp").alias("ts")
        ),
        "outcomes",
    )
    most, rows = outcomes.agg(F.max("seq"), F.count(F.lit(1))).first()
    most, buckets = most or 0, max(1024, rows // 50_000)  # a bucket's rows stay few however many there are
    # Every partition of the state is opened and committed in every batch, so it gets at least eight buckets.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    settings = {"spark.sql.streaming.stateStore.providerClass": breaker.ROCKS, "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for part in range(BREAKER_PARTS):
            low, high = most * part // BREAKER_PARTS, most * (part + 1) // BREAKER_PARTS
            outcomes.where((F.col("seq") > low - 2) & (F.col("seq") <= high)).write.mode("append").parquet(f"{root}/in")  # two rows come again
            stream = spark.readStream.schema(outcomes.schema).parquet(f"{root}/in")
            breaker.start_breaker(stream, f"{root}/out", f"{root}/checkpoint", late="3650 days", buckets=buckets).awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    changes = spark.read.schema(breaker.CHANGES.format("bigint")).parquet(f"{root}/out")
    return changes.where("state = 'open'").groupBy("backend").agg(F.min("seq").alias("opened_at"))


@query(
    "stream_ingest",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars, 1 AS parents, 1 AS children FROM documents""",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ingested as micro-batches; then all batches come again, changed, from a source without a checkpoint."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    batch = math.ceil(docs.rdd.getNumPartitions() / 3)  # files of a micro-batch, each about as large as a split of the input
    docs.repartitionByRange(3 * batch, "doc_id").write.parquet(f"{root}/in")
    store = ChunkStore(spark, f"{root}/store")

    def chunks(suffix: str):
        def chunk(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            content = F.concat("text", F.lit(suffix)).alias("content")
            parents = rows.select(F.col("doc_id").alias("chunk_id"), "doc_id", content)
            return parents, rows.select(F.concat("doc_id", F.lit(":c0")).alias("chunk_id"), "doc_id", F.col("doc_id").alias("parent_id"), content)

        return chunk

    for n, suffix in enumerate(("", "!")):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", batch).parquet(f"{root}/in")
        jobs.start_ingest(stream, store, f"{root}/checkpoint-{n}", chunks(suffix)).awaitTermination()
    parents = store.parents().groupBy("doc_id").agg(F.sum(F.length("content")).alias("n_chars"), F.count(F.lit(1)).alias("parents"))
    return parents.join(store.children().groupBy("doc_id").agg(F.count(F.lit(1)).alias("children")), "doc_id")
