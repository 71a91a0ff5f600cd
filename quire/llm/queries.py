"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, jaccard, line_dedup, merkle, mil, packing, pii, quality_rules, quotes, sharding, spelling, url_rules
from quire.llm.common import table

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


@query(quality_rules.ORACLE)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op9_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3_bpe(table(spark, sf_dir, "documents"))


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10_pii(table(spark, sf_dir, "documents"))


@query(decontaminate.ORACLE)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(url_rules.ORACLE)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op8_url_rules(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4_sharding(table(spark, sf_dir, "documents"))


@query()
def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.op7_quality_mil(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op5_line_dedup(table(spark, sf_dir, "documents"))


@query(jaccard.ORACLE)
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op6_jaccard(table(spark, sf_dir, "documents"))


@query()
def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.op1_quotes(table(spark, sf_dir, "conversations"))


@query(merkle.ORACLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_merkle(table(spark, sf_dir, "documents"))


@query(spelling.ORACLE)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12_spelling(table(spark, sf_dir, "documents"))


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op11_packing(table(spark, sf_dir, "documents"))
