"""Checks on machine annotations: grounding, term overlap, consistency, gates, threshold scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.markdown import strip
from quire.functions.text import tokens
from quire.operators.ordered import row_numbers

# Fixed folding of full-width punctuation to its ASCII form.
FULL_WIDTH = "，。！？；：（）【】“”‘’、　"
ASCII_FORM = ",.!?;:()[]\"\"''," + " "
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)


def fold(text: Column) -> Column:
    """Comparison form: full-width marks to ASCII, lower case, no blanks after marks, single blanks."""
    out = F.lower(F.translate(text, FULL_WIDTH, ASCII_FORM))
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return strip(F.regexp_replace(out, r"([,.!?;:]) ", "$1"))


def quote_present(quote: Column, content: Column) -> Column:
    folded = fold(F.coalesce(quote, F.lit("")))
    return (folded != "") & F.contains(fold(content), folded)


def term_overlap(query: Column, quote: Column) -> Column:
    """Share of the query's distinct terms that occur in the quote."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(tokens(quote)))), F.size(q)), F.lit(0.0))


def semantic_pass(cosine: Column, overlap: Column, min_cosine: float = 0.85, min_overlap: float = 0.1) -> Column:
    return (cosine > min_cosine) & (overlap >= min_overlap)


def consistent(rows: DataFrame, max_chunks: int = 4) -> DataFrame:
    """Derive difficulty from the number of labelled chunks, cap the labels and flag contradictions for review."""
    n = F.size("expected_parent_ids")
    return rows.select(
        *[c for c in rows.columns if c not in ("expected_parent_ids", "difficulty")],
        F.slice("expected_parent_ids", 1, max_chunks).alias("expected_parent_ids"),
        F.when(n >= 2, "multi_chunk").otherwise("single_chunk").alias("difficulty"),
        (((F.col("question_type") == "multi_hop") & (n < 2)) | (n > max_chunks)).alias("review_needed"),
    )


def reference_facts(ids: Column, quotes: Column) -> Column:
    """Quotes in the order of the labels, blank ones left out."""
    texts = F.transform(ids, lambda i: F.try_element_at(quotes, i))
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: F.coalesce(t, F.lit("")) != ""), "; ")


def scan(samples: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Share of positives kept (cosine > t) and negatives rejected (cosine <= t) per threshold.

    Samples are first counted per step of the grid, so nothing is multiplied by the number of thresholds.
    """
    grid = F.array(*[F.lit(t) for t in thresholds])
    step = F.size(F.filter(grid, lambda t: F.col("cosine") > t))  # thresholds this sample passes
    hist = samples.groupBy(step.alias("passed")).agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    # At most len(thresholds) + 1 rows from here on.
    wide = hist.agg(
        F.sum("pos").alias("pos_total"),
        F.sum("neg").alias("neg_total"),
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.coalesce(F.sum(F.when(F.col("passed") > i, F.col("pos"))), F.lit(0)).alias("kept"),
                    F.coalesce(F.sum(F.when(F.col("passed") <= i, F.col("neg"))), F.lit(0)).alias("rejected"),
                )
                for i, t in enumerate(thresholds)
            ]
        ).alias("rows"),
    )
    rows = wide.select("pos_total", "neg_total", F.inline("rows"))
    return rows.select(
        "threshold",
        F.coalesce(F.try_divide("kept", "pos_total"), F.lit(0.0)).alias("keep_rate"),
        F.coalesce(F.try_divide("rejected", "neg_total"), F.lit(0.0)).alias("reject_rate"),
    )


def operating_point(scanned: DataFrame, keep: float = 0.9, reject: float = 0.8) -> DataFrame:
    """Lowest threshold that keeps and rejects enough; one row, null threshold when there is none."""
    ok = (F.col("keep_rate") >= keep) & (F.col("reject_rate") >= reject)
    return scanned.agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold")).withColumn(
        "found", F.col("threshold").isNotNull()
    )


def hit_rate(passed: DataFrame, gold: DataFrame, chunks: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Share of annotations whose chunk is a gold chunk or close to one in the same document.

    passed (query_id, chunk_id), gold (query_id, gold_id), chunks (chunk_id, content). Only queries with gold count.
    """
    text = chunks.select("chunk_id", "content")
    rows = passed.join(gold, "query_id")
    rows = rows.join(text, "chunk_id", "left").join(
        text.select(F.col("chunk_id").alias("gold_id"), F.col("content").alias("gold_content")), "gold_id", "left"
    )
    same_doc = F.regexp_extract("chunk_id", r"^(.*):", 1) == F.regexp_extract("gold_id", r"^(.*):", 1)
    close = same_doc & (term_overlap(F.col("gold_content"), F.col("content")) >= overlap)
    hit = (F.col("chunk_id") == F.col("gold_id")) | F.coalesce(close, F.lit(False))
    per = rows.groupBy("query_id").agg(F.max(hit.cast("int")).alias("hit"))
    return per.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")
    ).withColumn("rate", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def pilot_summary(results: DataFrame, pass_rate: float = 0.8) -> DataFrame:
    row = results.agg(
        F.coalesce(F.avg(F.col("semantic_relevant").cast("double")), F.lit(0.0)).alias("semantic_rate"),
        *[F.count_if(F.col("disposition") == d).alias(d) for d in ("keep", "fix", "delete")],
    )
    return row.withColumn("passed", F.col("semantic_rate") >= pass_rate)


def delete_and_renumber(items: DataFrame, deleted: DataFrame, prefix: str = "crawler-") -> DataFrame:
    """Drop listed queries and number the rest anew in order. Numbers come from counts per block of the order."""
    left = items.join(deleted.select("query_id"), "query_id", "left_anti")
    numbered = row_numbers(left, ["position"], "_no")
    return numbered.withColumn("query_id", F.format_string(prefix + "%04d", F.col("_no"))).drop("_no")
