"""Snapshots of a corpus: bodies stored once by digest, manifests as sets of (path, digest), restore as a difference.

A snapshot adds only bodies that are not stored yet and becomes visible by its manifest, which is written last; one that broke off
leaves bodies that no manifest names and is simply taken again. A restore copies bodies only for paths whose digest differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize
from quire.sources.store import _there

BODIES = "digest string, content string"


class SnapshotStore:
    """Bodies and manifests below ``root``. Files are rows ``path, content``; a null content is an empty file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _bodies(self) -> DataFrame:
        path = f"{self.root}/bodies"
        return self.spark.read.schema(BODIES).parquet(path) if _there(self.spark, path) else self.spark.createDataFrame([], BODIES)

    @staticmethod
    def manifest_of(files: DataFrame) -> DataFrame:
        """``path, digest, size`` of files; size in bytes."""
        body = F.coalesce(F.col("content"), F.lit(""))
        return files.select("path", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))

    def take(self, name: str, files: DataFrame) -> DataFrame:
        """Store a snapshot and return its manifest. A path must not repeat; a name is taken once."""
        target = f"{self.root}/manifests/name={name}"
        if _there(self.spark, f"{target}/_SUCCESS"):
            raise ValueError(f"snapshot {name} exists")
        manifest = materialize(self.manifest_of(files), "manifest")
        if manifest.groupBy("path").count().where("count > 1").limit(1).count():
            raise ValueError("a path repeats")
        fresh = manifest.groupBy("digest").agg(F.min("path").alias("path")).join(self._bodies().select("digest"), "digest", "left_anti")
        bodies = files.join(materialize(fresh, "new-bodies"), "path").select("digest", F.coalesce("content", F.lit("")).alias("content"))
        bodies.write.mode("append").parquet(f"{self.root}/bodies")
        manifest.write.mode("overwrite").parquet(target)
        return self.manifest(name)

    def names(self) -> list[str]:
        if not _there(self.spark, f"{self.root}/manifests"):
            return []
        return sorted(r["name"] for r in self.manifests().select(F.col("name").cast("string")).distinct().collect())

    def manifests(self) -> DataFrame:
        """All manifests: ``path, digest, size, name``."""
        return self.spark.read.option("basePath", f"{self.root}/manifests").parquet(f"{self.root}/manifests")

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/manifests/name={name}")

    def read(self, name: str) -> DataFrame:
        """The files of a snapshot."""
        return self.manifest(name).join(self._bodies().dropDuplicates(["digest"]), "digest").select("path", "content")

    def difference(self, name: str, now: DataFrame) -> DataFrame:
        """``path, action, digest`` that lead from the manifest ``now`` to the snapshot: copy, replace, delete or keep."""
        old = now.select("path", F.col("digest").alias("_now"))
        joined = self.manifest(name).select("path", "digest").join(old, "path", "full")
        action = F.when(F.col("digest").isNull(), "delete").when(F.col("_now").isNull(), "copy").when(F.col("digest") != F.col("_now"), "replace").otherwise("keep")
        return joined.select("path", action.alias("action"), "digest")

    def restore(self, name: str, files: DataFrame) -> DataFrame:
        """``files`` turned into the snapshot. Kept files pass through; bodies are read for the others only."""
        steps = materialize(self.difference(name, self.manifest_of(files)), "restore")
        kept = files.join(steps.where("action = 'keep'").select("path"), "path", "left_semi").select("path", F.coalesce("content", F.lit("")).alias("content"))
        wanted = steps.where("action IN ('copy', 'replace')").select("path", "digest")
        return kept.unionByName(wanted.join(self._bodies().dropDuplicates(["digest"]), "digest").select("path", "content"))

    def damaged(self, name: str) -> DataFrame:
        """``path, digest`` whose body is missing or has another digest."""
        sound = self._bodies().where(F.sha2("content", 256) == F.col("digest")).select("digest").distinct()
        return self.manifest(name).select("path", "digest").join(sound, "digest", "left_anti").select("path", "digest")
