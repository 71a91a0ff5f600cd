"""Balanced shards by label propagation under quotas.

Documents with the same link key (equal texts by default) are neighbours through their group. Every document starts in
the shard of its hash. In each round a group points its members to the shard where most of them are; as many of the
wishes from shard i to shard j are granted as want to go the other way, plus what is free in j. Documents without a link
are ballast: they fill what the linked ones leave. A last exact step ranks each shard, linked documents first, keeps as
many rows as its quota and moves the rest into the gaps, so shards differ by one row at most and slots have no gaps.

Members of a group that sit in one shard are one weighted row (a cell), so rounds join and sum at most ``shards`` rows
per group whatever its size. A group larger than half a shard is first cut into parts by a hash of its rows. Ranks are
taken in ranges of rows and stitched with the counts of the ranges before; no shard or group is gathered in one task.
Only tables of shards x shards numbers reach the driver.

Defined cases: a null text counts as empty (size 1, checksum 0), and equal texts, also empty ones, are linked; repeated
rows are rows of their own with slots of their own; fewer rows than shards leave shards empty; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

SHARDS = 8
ROUNDS = 4


def _rows(spark, values: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    names = [c.split()[0] for c in schema.split(",")]
    kind = "array<struct<" + ",".join(":".join(c.split()) for c in schema.split(",")) + ">>"
    data = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in values]).cast(kind)
    return spark.range(1).select(F.inline(data))


def _wishes(cells: DataFrame) -> DataFrame:
    """Add ``target`` to cells (``g, part, start, label, n``): the shard of most members of the part."""
    here = cells.groupBy("g", "part", "label").agg(F.sum("n").alias("m"))
    best = here.groupBy("g", "part").agg(F.max(F.struct("m", F.xxhash64("g", "part", "label").alias("h"), "label"))["label"].alias("target"))
    return cells.join(best, ["g", "part"])


def _granted(flows: list, room: dict[int, int], used: dict[int, int]) -> list[tuple[int, int, float]]:
    """The share of the wishes (from, to) that the quotas allow."""
    want = {(r["label"], r["target"]): r["n"] for r in flows}
    rest = {(i, j): n - min(n, want.get((j, i), 0)) for (i, j), n in want.items()}
    into: dict[int, int] = {}
    for (_, j), n in rest.items():
        into[j] = into.get(j, 0) + n
    out = []
    for (i, j), n in want.items():
        free = max(0, room[j] - used.get(j, 0))
        extra = rest[i, j] * min(1.0, free / into[j]) if into[j] else 0.0
        out.append((i, j, (n - rest[i, j] + extra) / n))
    return out


def propagate(cells: DataFrame, room: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation over cells; ``room`` is the number of linked rows a shard may take."""
    spark = cells.sparkSession
    for turn in range(rounds):
        wished = materialize(_wishes(cells), "shard-wishes")
        sums = wished.groupBy("label", "target").agg(F.sum("n").alias("n")).collect()  # shards x shards rows
        used: dict[int, int] = {}
        for r in sums:
            used[r["label"]] = used.get(r["label"], 0) + r["n"]
        flows = [r for r in sums if r["label"] != r["target"]]
        if not flows:
            break
        share = _rows(spark, _granted(flows, room, used), "label int, target int, share double")
        draw = F.pmod(F.xxhash64("g", "part", "start", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = wished.join(F.broadcast(share), ["label", "target"], "left").select(  # shards x shards rows
            "g", "part", "start", F.when(draw < F.col("share"), F.col("target")).otherwise(F.col("label")).alias("label"), "n"
        )
        cells = materialize(moved, "shard-cells")
    return cells


def _position(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) of each row within its ``label``, counted range by range."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, "label", *order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    counts = ranged.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("label", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("label", "_range").orderBy(*order)
    return (
        ranged.withColumn("_k", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["label", "_range"])  # one row per range and shard that meets it
        .withColumn("rank", F.col("_k") + F.col("_before"))
        .drop("_k", "_before", "_range")
    )


def balance(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to a written table with ``rid`` (unique) and link key ``g`` (null: no link)."""
    spark = nodes.sparkSession
    n = nodes.count()
    quota = {j: n // shards + (j < n % shards) for j in range(shards)}
    largest = max(1, n // (2 * shards))
    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    groups = materialize(nodes.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "shard-groups")
    part = F.pmod(F.xxhash64("rid", F.lit(7)), F.ceil(F.col("_c") / F.lit(float(largest))).cast("bigint")).cast("int")
    placed = nodes.join(groups, "g", "left").select(
        *nodes.columns, F.when(F.col("_c").isNotNull(), part).alias("part"), start.alias("start")
    )
    placed = materialize(placed, "shard-start")
    cells = materialize(placed.where("part IS NOT NULL").groupBy("g", "part", "start").agg(F.count(F.lit(1)).alias("n")), "shard-cells")
    cells = propagate(cells.select("g", "part", "start", F.col("start").alias("label"), "n"), quota, rounds)
    moved = cells.where("start <> label").select("g", "part", "start", F.col("label").alias("_to"))
    linked = placed.where("part IS NOT NULL").join(moved, ["g", "part", "start"], "left")
    rows = linked.select(*placed.columns, F.coalesce("_to", "start").alias("label"), F.lit(0).alias("single")).unionByName(
        placed.where("part IS NULL").select("*", F.col("start").alias("label"), F.lit(1).alias("single"))
    )
    ranked = _position(rows, ["single", "g", "part", "rid"])
    have = {r["label"]: r["c"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row per shard
    return _settle(spark, ranked, quota, have).drop("part", "start", "label", "single", "rank")


def _settle(spark, ranked: DataFrame, quota: dict[int, int], have: dict[int, int]) -> DataFrame:
    """Rows beyond a shard's quota go, in order, into the gaps of the other shards."""
    over, gap, plan, gaps = 0, 0, [], []
    for j, q in quota.items():
        c = have.get(j, 0)
        plan.append((j, q, over))
        over += max(0, c - q)
        if c < q:
            gaps.append((gap, gap + q - c, j, c))
            gap += q - c
    shares = _rows(spark, plan, "label int, quota bigint, over bigint")
    spill = F.col("rank") - F.col("quota") + F.col("over")
    shard, slot = F.col("label"), F.col("rank")
    for low, high, j, c in gaps:
        taken = (F.col("rank") >= F.col("quota")) & (spill >= low) & (spill < high)
        shard = F.when(taken, F.lit(j)).otherwise(shard)
        slot = F.when(taken, spill - low + c).otherwise(slot)
    return ranked.join(F.broadcast(shares), "label").withColumns(  # one row per shard
        {"shard": shard.cast("int"), "slot": slot.cast("bigint")}
    ).drop("quota", "over")


def nodes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written narrow table: id, size, checksum, link key and a row number."""
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    return materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"),
            F.unhex(F.md5(whole)).alias("g"), F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-nodes",
    )


def op4_sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot per document under the law of equal row counts."""
    return balance(nodes_of(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
