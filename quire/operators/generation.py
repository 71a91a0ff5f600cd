"""Benchmark questions under a budget: quotas per document, rounds of asks, and numbered items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.corpus import adjacent_pairs
from quire.operators.ordered import row_numbers
from quire.session import materialize


def quotas(documents: DataFrame, target: int, pairs: int = 2) -> DataFrame:
    """``doc_id, budget, single_limit``: equal shares of ``target``, what is left over to the first documents in id order.

    A quarter of a budget, at least one item and at most ``pairs``, is held back for questions over two chunks.
    """
    ids = documents.where("doc_id IS NOT NULL").select("doc_id").distinct()
    numbered = row_numbers(ids, ["doc_id"], "_no")
    n = max(ids.count(), 1)
    budget = F.lit(target // n) + (F.col("_no") < target % n).cast("int")
    rows = numbered.select("doc_id", budget.cast("long").alias("budget"))
    held = F.least(F.lit(pairs), F.greatest(F.lit(1), F.floor(F.col("budget") / 4)))
    return rows.withColumn("single_limit", F.greatest(F.lit(0), F.col("budget") - held).cast("long"))


def next_asks(parents: DataFrame, quota: DataFrame, replies: DataFrame, per_chunk: int = 1, pairs: int = 2, max_failures: int = 3) -> DataFrame:
    """``doc_id, kind, ask_no, chunk_ids, content`` that are to be asked next; no rows when every document is done.

    ``parents`` is (doc_id, parent_no from 0 without gaps, chunk_id, content), ``replies`` (doc_id, kind, ask_no, items) with null items
    for a failure. A round asks only as much as can still be used, so no document passes its limit by more than one reply. Questions
    over pairs follow when a document's single ones are done. ``max_failures`` failures at the end of a round end a kind.
    """
    def of(kind: str, value):
        return F.when(F.col("kind") == kind, value)

    sums = []
    for kind in ("single", "multi"):
        last, won = F.coalesce(F.max(of(kind, F.col("ask_no"))), F.lit(-1)), F.coalesce(F.max(of(kind, F.when(F.col("items").isNotNull(), F.col("ask_no")))), F.lit(-1))
        sums += [
            F.coalesce(F.sum(of(kind, F.col("items"))), F.lit(0)).alias(f"{kind}_got"), last.alias(f"{kind}_last"),
            (last - won >= max_failures).alias(f"{kind}_stopped"),
        ]
    size = parents.groupBy("doc_id").agg(F.max("parent_no").alias("last_parent"))
    state = quota.join(size, "doc_id").join(replies.groupBy("doc_id").agg(*sums), "doc_id", "left")
    state = state.fillna({f"{k}_{c}": v for k in ("single", "multi") for c, v in (("got", 0), ("last", -1), ("stopped", False))})
    open_single = ~F.col("single_stopped") & (F.col("single_got") < F.col("single_limit")) & (F.col("single_last") < F.col("last_parent"))
    single = F.ceil((F.col("single_limit") - F.col("single_got")) / per_chunk)
    left = F.least(F.lit(pairs), F.col("budget") - F.col("single_got")) - F.col("multi_got")
    state = materialize(
        state.select(
            "doc_id", "single_last", "multi_last",
            F.when(open_single, single).otherwise(0).alias("singles"),
            F.when(~open_single & ~F.col("multi_stopped"), F.greatest(left, F.lit(0))).otherwise(0).alias("multis"),
        ).where("singles > 0 OR multis > 0"),
        "open-quotas",
    )
    one = parents.join(state, "doc_id").where("parent_no > single_last AND parent_no <= single_last + singles")
    two = adjacent_pairs(parents.join(state.where("multis > 0").select("doc_id"), "doc_id", "left_semi")).join(state, "doc_id")
    two = two.where("pair_no > multi_last AND pair_no <= multi_last + multis")
    return one.select("doc_id", F.lit("single").alias("kind"), F.col("parent_no").cast("long").alias("ask_no"), F.array("chunk_id").alias("chunk_ids"), "content").unionByName(
        two.select("doc_id", F.lit("multi").alias("kind"), F.col("pair_no").alias("ask_no"), F.array("first_id", "second_id").alias("chunk_ids"), "content")
    )


def generate(parents: DataFrame, quota: DataFrame, call: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Ask in rounds until every quota is used or nothing is left: all asks with what ``call`` adds, among it ``items``.

    ``items`` is the number of questions in a reply, null for a failure. Every round is written once, so a model is not asked again.
    """
    done: DataFrame | None = None
    none = parents.sparkSession.createDataFrame([], f"doc_id {parents.schema['doc_id'].dataType.simpleString()}, kind string, ask_no long, items long")
    while True:
        replies = none if done is None else done.select("doc_id", "kind", "ask_no", "items")
        asked = materialize(call(next_asks(parents, quota, replies, **options)), "asks")
        if asked.isEmpty():
            return asked if done is None else done
        done = asked if done is None else materialize(done.unionByName(asked), "asked")


def numbered_items(asked: DataFrame, prefix: str) -> DataFrame:
    """One row per question, numbered over all documents: document, single before multi, ask, place in the reply."""
    rows = asked.where("items > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("items") - 1).cast("int"))).alias("item_no"))
    rows = rows.withColumn("_late", (F.col("kind") == "multi").cast("int"))
    out = row_numbers(rows, ["doc_id", "_late", "ask_no", "item_no"], "_no")
    return out.withColumn("query_id", F.concat(F.lit(f"{prefix}-"), F.when(F.col("_no") < 10000, F.lpad(F.col("_no").cast("string"), 4, "0")).otherwise(F.col("_no").cast("string")))).drop("_no", "_late")
