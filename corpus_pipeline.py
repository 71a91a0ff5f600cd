"""The training-data pipeline: five stages over ``documents``, each written and read again.

Stages, each working on all that the one before kept:

1. ``quality_rules``: documents go that fail the base rules or a calibrated cutoff.
2. ``line_dedup``: repeated lines go; a document that loses its last line with content goes, too.
3. ``jaccard_join``: of each group of near copies (five words, 80 percent) the document with the smallest id stays.
4. ``decontaminate``: documents with a passage of the benchmark go.
5. ``bpe``: token counts and digests per document.

All but the last return the columns of ``documents``; ``n_chars`` follows a changed text. Rows with the same id are one
document: equal ones become one row in stage 3. A document without an id cannot be named by a decision of stage 3 and
stays there. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, jaccard, line_dedup
from quire.llm import quality_rules as rules
from quire.llm.common import broadcast_checked, materialize, table

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.clean_rows(docs)
    left = clean.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select("row.*")
    columns = [F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return left.select(*columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialize(jaccard.similar_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT), "groups")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(broadcast_checked(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    again = materialize(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again")), "again")
    if not again.limit(1).count():
        return left
    more = broadcast_checked(again)
    single = left.join(more, F.col("doc_id") == F.col("_again"), "left_anti")
    return single.union(left.join(more, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.op3_bpe(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: Merges of byte pairs and binomial cutoffs together are out of reach for SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
