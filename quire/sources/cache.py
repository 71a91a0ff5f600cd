"""A table of model answers by key: upserts where the latest wins, an expiry time, compaction, and calls for missing keys only.

An upsert is a new folder (``delta-<n>``), in which rows are dealt into hashed sub-folders. Compaction writes one folder
(``base-<n>``) that replaces all before it; readers never see half of either.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize
from quire.sources.folders import finished, number

_SCHEMA = "key string, value string, expires timestamp, version long, slot int"


class CallCache:
    """``slots`` must stay the same for the life of a table. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, slots: int = 32):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.slots)).cast("int")

    def _folders(self) -> list[str]:
        """The newest base and the upserts after it."""
        done, _ = finished(self.spark, self.path)
        start = max((i for i, name in enumerate(done) if name.startswith("base-")), default=0)
        return done[start:]

    def _rows(self) -> DataFrame:
        parts = [self.spark.read.schema(_SCHEMA).option("basePath", f"{self.path}/{n}").parquet(f"{self.path}/{n}") for n in self._folders()]
        rows = self.spark.createDataFrame([], _SCHEMA) if not parts else parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def _write(self, rows: DataFrame, kind: str) -> None:
        _, n = finished(self.spark, self.path)
        placed = rows.withColumn("version", F.coalesce("version", F.lit(n).cast("long"))).withColumn("slot", self._slot())
        placed.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.path}/{kind}-{n}")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """One row per key. Of several rows of one upsert the later expiry wins, then the greater value; no expiry is the latest."""
        order = F.struct("version", F.col("expires").isNull().alias("forever"), "expires", "value")
        return rows.groupBy("slot", "key").agg(F.max(order).alias("m")).select("slot", "key", "m.value", "m.expires", "m.version")

    def put(self, rows: DataFrame, now: dt.datetime, ttl: dt.timedelta | None = None) -> None:
        """Upsert (key, value). Rows without a key or value are left out; an empty upsert changes nothing."""
        expires = F.lit(None if ttl is None else now + ttl).cast("timestamp")
        given = rows.where("key IS NOT NULL AND value IS NOT NULL").select("key", F.col("value").cast("string").alias("value"))
        self._write(given.withColumn("expires", expires).withColumn("version", F.lit(None).cast("long")), "delta")

    def get(self, keys: DataFrame, now: dt.datetime) -> DataFrame:
        """(key, value) of the first column of ``keys``, where an answer is held that has not expired. Each key once."""
        wanted = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct().withColumn("slot", self._slot())
        held = self._rows().join(wanted, ["slot", "key"], "left_semi")
        return self._latest(held).where(F.col("expires").isNull() | (F.col("expires") > F.lit(now))).select("key", "value")

    def compact(self, now: dt.datetime) -> None:
        """Keep the latest row of each key, and of these the ones that have not expired, in one folder."""
        latest = self._latest(self._rows()).where(F.col("expires").isNull() | (F.col("expires") > F.lit(now)))
        self._write(latest.select("key", "value", "expires", "version"), "base")

    def vacuum(self) -> int:
        """Delete the folders that the newest base replaced; call it when no reader may still use them."""
        done, _ = finished(self.spark, self.path)
        keep = set(self._folders())
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        old = [n for n in done if n not in keep and number(n) < min(map(number, keep))]
        for name in old:
            path = hadoop.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)


def cached_call(
    rows: DataFrame,
    key: str,
    call: Callable[[DataFrame], DataFrame],
    cache: CallCache,
    now: dt.datetime,
    ttl: dt.timedelta | None = dt.timedelta(hours=72),
    out: str = "reply",
) -> DataFrame:
    """Add the answer of each row's key as ``out``, with ``hit`` and ``error``.

    Keys are looked up before the model is called; ``call`` gets one row per missing key and adds ``value`` and ``error``. Its answers
    are written once and then stored; failures are not stored. A row without a key gets no answer.
    """
    taken = {out, "hit", "error"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns in use: {sorted(taken)}")
    found = materialize(cache.get(rows.select(key), now), "cache-hits")
    missing = rows.where(F.col(key).isNotNull()).join(found.select(F.col("key").alias(key)), key, "left_anti").dropDuplicates([key])
    fresh = materialize(call(missing).select(F.col(key).alias("key"), F.col("value").cast("string").alias("value"), "error"), "cache-misses")
    cache.put(fresh.where("error IS NULL"), now, ttl)
    none = F.lit(None).cast("string")
    answers = found.select("key", "value", F.lit(True).alias("hit"), none.alias("error")).unionByName(fresh.withColumn("hit", F.lit(False)))
    answers = answers.select(F.col("key").alias(key), F.col("value").alias(out), "hit", "error")
    return rows.join(answers, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
