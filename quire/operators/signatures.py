"""Content signatures of a corpus and comparison of manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import sha_prefix


def corpus_signature(chunks: DataFrame, width: int = 12) -> DataFrame:
    """One row (chunks, signature) that changes with any content and not with row order.

    The digest of each chunk is cut into eight words and the words are summed, so every task adds up its own rows and
    no sorted text of the whole corpus is ever built. Sums are exact decimals.
    """
    digests = chunks.select(F.sha2(F.concat("chunk_id", F.lit(":"), "content"), 256).alias("h"))
    words = [
        F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"w{i}") for i in range(8)
    ]
    sums = digests.select(*words).agg(
        F.count(F.lit(1)).alias("chunks"),
        *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)],
    )
    parts = [F.col("chunks").cast("string"), *[F.col(f"s{i}") for i in range(8)]]
    return sums.select("chunks", sha_prefix(F.concat_ws("|", *parts), width).alias("signature"))


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path and SHA-256 of every file."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that differ: path, change (new, changed, missing)."""
    a = before.select("path", F.col("sha256").alias("_a"))
    b = after.select("path", F.col("sha256").alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
