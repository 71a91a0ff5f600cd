"""Ranks and percentiles over groups of any size.

A window over a whole group puts it into one task. Here equal values are first merged into counts, then a group is cut
into value ranges of about equal size, and the running counts of the ranges are stitched with their offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

#: Rows of distinct values that one range of a group holds about.
RANGE_ROWS = 100_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null is a value like any other."""
    named = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, on).drop(*[f"_r_{c}" for c in keys])


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in an order: ranges of rows are numbered apart and stitched with their counts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "row-ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_k", inside).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, F.col("_k") + F.col("_before") - 1).drop("_k", "_before", "_range")


def cumulative(counts: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Add ``cum`` (weights up to and with this value) and ``total`` to distinct (group, value) rows.

    The number of ranges follows the number of rows, so one group may hold all of them.
    """
    counts = materialize(counts, "counts")  # read three times below
    ranges = max(8, counts.count() // RANGE_ROWS)
    # Sorted into ranges by Spark's own sampling, which costs the same per row however many ranges there are.
    ranged = counts.repartitionByRange(ranges, *group, value).withColumn("_range", F.spark_partition_id())
    placed = materialize(ranged, "value-ranges")
    sums = placed.groupBy(*group, "_range").agg(F.sum(weight).alias("_sum"))
    by_group = Window.partitionBy(*group)
    offsets = sums.select(
        *group,
        "_range",
        (F.sum("_sum").over(by_group.orderBy("_range")) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(by_group).alias("total"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _same(placed, offsets, [*group, "_range"])
        .withColumn("cum", F.col("_before") + F.sum(weight).over(inside))
        .drop("_range", "_before")
    )


def percentiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], kind: str = "linear"
) -> DataFrame:
    """Exact percentiles per group: one column per entry of ``probs`` and ``n``.

    ``linear`` interpolates between neighbours; ``nearest`` takes the value at index min(n - 1, floor(p * n)).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    run = cumulative(counts, group, "_v", "_c")

    def at(index):
        return F.min(F.when(F.col("cum") > index, F.col("_v")))

    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        if kind == "linear":
            pos = (F.col("total") - 1) * F.lit(float(p))
            aggs += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi")]
        else:
            index = F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(float(p))))
            aggs.append(at(index).alias(name))
    out = run.groupBy(*group).agg(*aggs)
    if kind == "linear":
        for name, p in probs.items():
            pos = (F.col("n") - 1) * F.lit(float(p))
            lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
            out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos))).drop(f"_{name}_lo", f"_{name}_hi")
    return out
