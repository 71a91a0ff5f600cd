"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import spread


def registry():
    """Queries and SQL of a module by name, and the decorator that adds a function to them."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(fn):
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One SQL expression, valid in both engines, that gives the plain documents a Markdown shape by language: a regular
# heading tree, a tree with a skipped level, fence and table, or the plain text.
MARKDOWN = """
CASE lang
 WHEN 'en' THEN concat('# ', source, chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10), '## Part', chr(10), chr(10))))
 WHEN 'fr' THEN concat('# ', source, chr(10), '### deep', chr(10), text)
 WHEN 'es' THEN concat('intro', chr(10), '```', chr(10), '# code ', source, chr(10), '```', chr(10), chr(10), '| a | b |', chr(10),
      '|---|---|', chr(10), '| ', lang, ' | ', source, ' |', chr(10), chr(10), '# ', source, chr(10), chr(10), text)
 ELSE text END
"""


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).selectExpr("doc_id", "lang", "source", f"{MARKDOWN} AS md")
