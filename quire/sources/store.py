"""Chunk store on Parquet, and the sinks for runs, reports and traces.

Data files are only ever added. A small log of (doc_id, batch, status) decides which rows count, so an ingest becomes
visible by one append at its end, a rollback is one append, and no commit rewrites data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import fit_bytes
from quire.operators.observe import newest, redact
from quire.session import materialize
from quire.settings import DEFAULTS

FORMAT_VERSION = 1
LOG = "doc_id string, batch string, status string, at timestamp, step int"


class ChunkStore:
    """Parents and children with the states suspending, indexed and deleted per document and batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        return _there(self.spark, self._path(name))

    def _mark(self, docs: DataFrame, status: str, step: int, at: dt.datetime, batch: str | None = None) -> None:
        rows = docs.select(
            "doc_id",
            (F.lit(batch) if batch is not None else F.col("batch")).alias("batch"),
            F.lit(status).alias("status"),
            F.lit(at).cast("timestamp").alias("at"),
            F.lit(step).alias("step"),
        )
        rows.write.mode("append").parquet(self._path("log"))

    def log(self) -> DataFrame:
        if not self._exists("log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self._path("log"))

    def state(self) -> DataFrame:
        """Latest status per (doc_id, batch) with its time."""
        last = F.max(F.struct("at", "step", "status")).alias("s")
        return self.log().groupBy("doc_id", "batch").agg(last).select("doc_id", "batch", "s.status", "s.at")

    def committed(self, batch: str) -> bool:
        """True if ``ingest_once`` has finished with this batch id."""
        return self._exists(f"done/batch={batch}/_SUCCESS")

    def ingest_once(self, parents: DataFrame, children: DataFrame, batch: str, at: dt.datetime | None = None) -> bool:
        """``ingest`` for batches that may come again: a batch id that was committed changes nothing, whatever it brings.

        The commit is the last write. What broke off before it is written again whole, under the same batch id, and the log
        takes the later entries.
        """
        if self.committed(batch):
            return False
        wrote = self.ingest(parents, children, batch, at)
        self.spark.createDataFrame([(wrote,)], "wrote boolean").coalesce(1).write.mode("overwrite").json(self._path(f"done/batch={batch}"))
        return wrote

    def ingest(self, parents: DataFrame, children: DataFrame, batch: str, at: dt.datetime | None = None) -> bool:
        """Write one batch of documents; earlier versions of the same documents give way. No parents, no change.

        Parents are computed once, by their write; the ids come from what was written. Nothing is visible before the log.
        """
        at = at or dt.datetime.now(dt.timezone.utc)
        folder = self._path(f"parents/batch={batch}")
        parents.write.mode("overwrite").parquet(folder)
        docs = self.spark.read.schema(parents.schema).parquet(folder).select("doc_id").distinct()
        if docs.isEmpty():
            return False
        self._mark(docs, "suspending", 1, at, batch)
        children.withColumn("content", fit_bytes(F.col("content"))).write.mode("overwrite").parquet(
            self._path(f"children/batch={batch}")
        )
        older = self.state().where((F.col("batch") != batch) & (F.col("status") != "deleted"))
        old = older.join(docs, "doc_id", "left_semi").select("doc_id", "batch").persist()
        self._mark(docs, "indexed", 2, at, batch)
        if not old.isEmpty():
            self._mark(old, "deleted", 3, at)
        old.unpersist()
        self._write_version()
        return True

    def _write_version(self) -> None:
        self.spark.createDataFrame([(FORMAT_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(
            self._path("meta")
        )

    def rollback(self, docs: DataFrame, at: dt.datetime | None = None) -> None:
        """Take documents out of every batch."""
        at = at or dt.datetime.now(dt.timezone.utc)
        live = self.state().where("status <> 'deleted'").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        self._mark(live, "deleted", 4, at)

    def expire(self, now: dt.datetime, minutes: int = DEFAULTS.ttl_minutes) -> None:
        """Take back documents that stayed in the state suspending for too long."""
        limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
        stuck = self.state().where((F.col("status") == "suspending") & (F.col("at") < limit))
        self._mark(stuck, "deleted", 4, now)

    def _live(self, name: str) -> DataFrame:
        rows = self.spark.read.option("basePath", self._path(name)).parquet(self._path(name))
        live = self.state().where("status = 'indexed'").select("doc_id", "batch")
        return rows.withColumn("batch", F.col("batch").cast("string")).join(live, ["doc_id", "batch"], "left_semi")

    def parents(self) -> DataFrame:
        return self._live("parents")

    def children(self) -> DataFrame:
        return self._live("children")

    def restore(self) -> tuple[DataFrame, DataFrame] | None:
        """Parents and children, or None when the store is missing or of another format version."""
        if not self._exists("meta") or not self._exists("parents"):
            return None
        version = self.spark.read.json(self._path("meta")).first()
        if version is None or version["version"] != FORMAT_VERSION:
            return None
        return self.parents(), self.children()


def record_run(spark: SparkSession, path: str, run: DataFrame, keep: int = DEFAULTS.max_runs) -> DataFrame:
    """Append one run (run_id, ts, ...), cut the history to the newest runs and return it.

    A taken run_id gets the next free counting suffix.
    """
    run_id = run.first()["run_id"]
    name = run_id
    if _there(spark, path):
        known = spark.read.schema(run.schema).parquet(path).select("run_id")
        rest = F.substring("run_id", len(run_id) + 2, 20)
        number = F.when(F.col("run_id") == run_id, 0).when(
            F.col("run_id").startswith(f"{run_id}-") & rest.rlike("^[0-9]{1,9}$"), rest.cast("int")
        )
        last = known.agg(F.max(number)).first()[0]
        name = run_id if last is None else f"{run_id}-{last + 1}"
    run.withColumn("run_id", F.lit(name)).write.mode("append").parquet(path)
    history = spark.read.schema(run.schema).parquet(path)
    if history.count() > keep:
        materialize(newest(history, "ts", keep, "run_id"), "runs").write.mode("overwrite").parquet(path)
        history = spark.read.schema(run.schema).parquet(path)
    return history


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_report(path: str, per_query: DataFrame, judged: DataFrame | None, summary: DataFrame) -> None:
    """Per-query rows with judge fields, the failures among them, and the summary, as JSON."""
    rows = per_query if judged is None else per_query.join(judged, "query_id", "left")
    rows.write.mode("overwrite").json(f"{path}/per_query")
    rows.where("diagnosis <> 'accept'").write.mode("overwrite").json(f"{path}/failures")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_traces(path: str, traces: DataFrame, sanitize: bool = False) -> None:
    """Traces as JSON by day, on request without fields whose name looks sensitive."""
    rows = redact(traces) if sanitize else traces
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)
