"""File readers: documents of several formats, benchmarks, JSON lines, file manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.core import pin
from quire.functions.html import html_decision, read_page
from quire.functions.text import auto_query_id, clean, doc_id_from_path, stem
from quire.sources.office import read_office

FORMATS = ("txt", "md", "html", "htm", "docx", "pptx", "pdf")
PARSED = "struct<markdown:string,decision:string,colpali:boolean,vlm_candidates:int,error:string>"


def _glob(kinds: tuple[str, ...]) -> str:
    """File name pattern for suffixes in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in k) for k in kinds) + "}"


def _visible(path: Column, skip: tuple[str, ...]) -> Column:
    """False for paths with a hidden segment or a skipped folder."""
    hidden = path.rlike(r"/\.[^/]+")
    for name in skip:
        hidden = hidden | F.contains(path, F.lit(f"/{name}/"))
    return ~hidden


def load_documents(
    spark: SparkSession,
    base_dir: str,
    skip: tuple[str, ...] = ("synthetic",),
    clean_formats: tuple[str, ...] = ("html", "htm", "docx", "pptx", "pdf"),
    parsers: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Documents below a folder, one row each: doc_id, title, author, doc_type, source_url, text, decision, error.

    Plain text and Markdown are taken whole; HTML, DOCX and PPTX become Markdown. ``parsers`` maps a suffix (such as
    pdf, for which no library is assumed) to a function from the file content to the struct ``PARSED``. A file that
    fails or whose suffix no parser knows keeps a row with ``error`` and no text.
    """
    def files(kinds: tuple[str, ...]) -> DataFrame:
        """Files with one of the suffixes; others are left out by name, so each file is read once."""
        below = F.substring("path", F.instr("path", base_dir.rstrip("/")) + len(base_dir.rstrip("/")), F.length("path"))
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(kinds)).load(base_dir)
        return found.select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("doc_type")).where(_visible(below, skip))

    text = F.decode(F.col("content"), "UTF-8")
    plain = F.struct(text.alias("markdown"), F.lit("whole_text").alias("decision"), F.lit(False).alias("colpali"),
                     F.lit(0).alias("vlm_candidates"), F.lit(None).cast("string").alias("error")).cast(PARSED)

    def branch(kinds: tuple[str, ...], parsed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return parsed(files(kinds)).select("path", "doc_type", "parsed")

    def html(df: DataFrame) -> DataFrame:
        page = pin(df, "_page", read_page(F.decode(F.col("content"), "UTF-8")))
        way = html_decision(F.col("_page"))
        body = F.when(way == "html_text", F.col("_page.markdown")).otherwise("")
        return page.withColumn(
            "parsed",
            F.struct(body.alias("markdown"), way.alias("decision"), F.lit(False).alias("colpali"),
                     F.col("_page.image_count").alias("vlm_candidates"), F.lit(None).cast("string").alias("error")).cast(PARSED),
        )

    parts = [
        branch(("txt", "md"), lambda d: d.withColumn("parsed", plain)),
        branch(("html", "htm"), html),
        branch(("docx", "pptx"), lambda d: d.withColumn("parsed", read_office("doc_type", "content").cast(PARSED))),
    ]
    known = set(parsers or {})
    for kind, parser in (parsers or {}).items():
        parts.append(branch((kind,), lambda d, p=parser: d.withColumn("parsed", p(F.col("content")).cast(PARSED))))
    if "pdf" not in known:
        no_parser = F.struct(F.lit("").alias("markdown"), F.lit("skip").alias("decision"), F.lit(False).alias("colpali"),
                             F.lit(0).alias("vlm_candidates"), F.lit("no parser for pdf").alias("error")).cast(PARSED)
        parts.append(branch(("pdf",), lambda d: d.withColumn("parsed", no_parser)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    body = F.col("parsed.markdown")
    return rows.select(
        doc_id_from_path(F.col("path"), base_dir).alias("doc_id"),
        stem(F.col("path")).alias("title"),
        F.lit("sd").alias("author"),
        F.concat(F.lit("."), F.col("doc_type")).alias("doc_type"),
        F.col("path").alias("source_url"),
        F.when(F.col("doc_type").isin(*clean_formats), clean(body)).otherwise(body).alias("text"),
        F.col("parsed.decision").alias("decision"),
        F.col("parsed.error").alias("error"),
        (~F.col("doc_type").isin("txt", "md")).alias("protect_tables"),
    )


def failures(documents: DataFrame) -> DataFrame:
    """Rows of the failure list."""
    return documents.where(F.col("error").isNotNull()).select("source_url", "doc_type", "error")


def usable(documents: DataFrame) -> DataFrame:
    """Documents with a non-blank text and no error."""
    return documents.where(F.col("error").isNull() & (F.trim("text") != ""))


BENCHMARK = """query_id string, query string, reference_facts string, ground_truth string, source_doc string, category string,
 difficulty string, expected_parent_ids array<string>, expected_chunk_ids array<string>, relevance map<string,int>,
 expected_files array<string>, expected_pages array<int>, expected_child_ids array<string>"""


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items of a JSON array with defaults filled, older keys honoured and flags for what was missing.

    The whole array is one file and one value, so positions come from ``posexplode`` and give the automatic ids.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", f"array<struct<{_fields(BENCHMARK)}>>")).alias("index", "i")
    )
    ids = F.when(F.coalesce(F.size("i.expected_parent_ids"), F.lit(0)) > 0, F.col("i.expected_parent_ids")).otherwise(
        F.coalesce("i.expected_chunk_ids", F.array().cast("array<string>"))
    )
    blank = F.lit("")
    empty = F.array().cast("array<string>")

    def filled(*cols):
        return F.coalesce(*[F.nullif(F.col(c), blank) for c in cols[:-1]], F.lit(cols[-1]))

    rows = raw.withColumn("_ids", ids)
    default = F.map_from_arrays("_ids", F.array_repeat(F.lit(3), F.size("_ids")))
    return rows.select(
        "index",
        F.coalesce(F.nullif(F.col("i.query_id"), blank), auto_query_id(F.col("index") + 1)).alias("query_id"),
        F.coalesce("i.query", blank).alias("query"),
        filled("i.reference_facts", "i.ground_truth", "").alias("reference_facts"),
        F.coalesce("i.source_doc", blank).alias("source_doc"),
        filled("i.category", "unknown").alias("category"),
        filled("i.difficulty", "unknown").alias("difficulty"),
        F.col("_ids").alias("expected_parent_ids"),
        F.when(F.coalesce(F.size("i.relevance"), F.lit(0)) > 0, F.col("i.relevance")).otherwise(default).alias("relevance"),
        F.coalesce("i.expected_files", empty).alias("expected_files"),
        F.coalesce("i.expected_child_ids", empty).alias("expected_child_ids"),
        *[F.col(f"i.{c}").isNull().alias(f"missing_{c}") for c in ("query_id", "relevance", "category", "difficulty")],
    )


def _fields(ddl: str) -> str:
    import re

    return re.sub(r"(^|,\s*)(\w+) ", r"\1\2:", ddl.replace("\n", " ").strip())


def stale_labels(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels that no chunk of the index carries: index, chunk_id."""
    labels = items.select("index", F.explode("expected_parent_ids").alias("chunk_id"))
    return labels.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("index", "chunk_id")


def isolated(public: DataFrame, local: DataFrame) -> DataFrame:
    """Chunk ids two stores share; must be empty."""
    return public.select("chunk_id").intersect(local.select("chunk_id"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def file_manifest(spark: SparkSession, base_dir: str) -> DataFrame:
    """Path and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base_dir)
    start = F.instr("path", base_dir.rstrip("/") + "/") + len(base_dir.rstrip("/")) + 1
    return files.select(F.substring("path", start, F.length("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


def pdf_precheck(pages: DataFrame, sample: int = 5, min_text: int = 150, gap: float = 40.0) -> DataFrame:
    """Route of a PDF from page facts (doc_id, page_no, total_pages, text_chars, image_ratio, word_x).

    Sampled pages are spaced evenly with both ends, rounded half to even. ``word_x`` holds the left edges of the words.
    """
    n = F.least(F.lit(sample), F.col("total_pages"))
    picks = F.when(n == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.bround(i * (F.col("total_pages") - 1) / F.nullif(n - 1, F.lit(0)), 0).cast("int"),
        )
    )
    xs = F.array_sort("word_x")
    gaps = F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: b - a)
    columns = (F.size("word_x") >= 5) & F.exists(gaps, lambda g: g > gap)
    has_text, has_image = F.col("text_chars") >= min_text, F.col("image_ratio") > 0
    facts = pages.where(F.array_contains(picks, F.col("page_no"))).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(has_text).alias("text_pages"),
        F.count_if(~has_text & has_image).alias("vlm_pages"),
        F.count_if(has_text & has_image).alias("vlm_candidates"),
        F.count_if(F.col("text_chars") == 0).alias("empty_pages"),
        F.max(columns).alias("multi_column"),
        F.max(F.col("image_ratio") >= 0.3).alias("colpali"),
    )
    ratio = F.col("text_pages") / F.col("sampled")
    return facts.select(
        "*",
        (F.col("empty_pages") / F.col("sampled")).alias("empty_page_ratio"),
        F.when(F.col("multi_column") | (F.col("text_pages") > 0), "whole_text").when(F.col("vlm_pages") > 0, "vlm").otherwise("skip").alias("decision"),
        F.array_compact(
            F.array(
                F.when(F.col("multi_column"), F.lit("multi_column")),
                F.when((ratio > 0) & (ratio < 0.9), F.lit("text_page_ratio_below_threshold")),
            )
        ).alias("degraded_flags"),
    )


__all__ = [
    "load_documents", "failures", "usable", "load_benchmark", "stale_labels", "isolated", "read_jsonl", "file_manifest",
    "pdf_precheck",
]
