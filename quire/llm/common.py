"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.core import pin
from quire.session import materialize

__all__ = ["SPACE", "bounded", "broadcast_checked", "materialize", "pin", "placed", "table", "text_words"]

#: The six ASCII white-space characters that separate words, as a literal set and as a pattern.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
#: Rows a side may have to be broadcast; each caller sends a few narrow columns, so this is some tens of MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_words(text: Column) -> Column:
    """Runs of characters outside the ASCII white space, in order; no words for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))


def bounded(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more of it than needed to know."""
    return df.limit(rows + 1).count() <= rows


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is for a shuffled join."""
    return F.broadcast(df) if bounded(df, rows) else df


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``at`` (place from 0 in the order) and ``n`` (rows) within ``group``; the rows are a written table.

    Ranges of rows are numbered apart and stitched with their counts, so a group of any size is spread over the tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "place-ranges")
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(group)  # one row per range that meets the group
    offsets = counts.select(
        group, "_range", (F.sum("_c").over(whole.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("n")
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order)
    numbered = ranged.withColumn("_k", F.row_number().over(inside) - 1).join(broadcast_checked(materialize(offsets, "place-offsets")), [group, "_range"])
    return numbered.withColumn("at", F.col("_k") + F.col("_before")).drop("_k", "_before", "_range")
