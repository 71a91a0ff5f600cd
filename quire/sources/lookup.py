"""A table laid out for fetching rows by key: hashed folders, sorted files, and a Bloom filter of the key per row group.

A fetch of a few keys reads only their folders (pruned by name), and in these only row groups whose range and filter may hold one. A
fetch of many keys is a join that carries the folder number, so both sides are dealt by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are put into the plan as literals; more are joined.
LITERAL_KEYS = 1000
_FOLDER = "key_folder"


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


class KeyedTable:
    """Rows by ``key`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        made = spark.read.json(f"{self.path}/layout").first()
        self.key, self.folders = made["key"], made["folders"]

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str, folders: int = 64, group_bytes: int = 8 << 20) -> KeyedTable:
        """Write all rows; rows without a key are kept, and found by no fetch."""
        path = path.rstrip("/")
        placed = rows.withColumn(_FOLDER, F.coalesce(_folder(F.col(key), folders), F.lit(-1)))
        (
            placed.hint("rebalance", _FOLDER)
            .sortWithinPartitions(_FOLDER, key)
            .write.mode("overwrite")
            .option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option("parquet.block.size", str(group_bytes))
            .partitionBy(_FOLDER)
            .parquet(f"{path}/rows")
        )
        rows.sparkSession.createDataFrame([(key, folders)], "key string, folders int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
        return cls(rows.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    def fetch(self, keys: DataFrame) -> DataFrame:
        """All rows with one of the keys (first column of ``keys``); no row twice, whatever repeats among the keys."""
        rows = self.rows()
        wanted = keys.select(F.col(keys.columns[0]).cast(rows.schema[self.key].dataType).alias("_key")).where("_key IS NOT NULL").distinct()
        wanted = wanted.withColumn("_at", _folder(F.col("_key"), self.folders))
        few = wanted.limit(LITERAL_KEYS + 1).collect()
        if len(few) <= LITERAL_KEYS:
            chosen = rows.where(F.col(_FOLDER).isin(sorted({r["_at"] for r in few})) & F.col(self.key).isin([r["_key"] for r in few]))
        else:
            chosen = rows.join(wanted, (F.col(_FOLDER) == F.col("_at")) & (F.col(self.key) == F.col("_key")), "left_semi")
        return chosen.drop(_FOLDER)
