"""Diagnose documents, route them to a strategy and cut them into parent and child chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import built, pin
from quire.functions.markdown import diagnose, strategy
from quire.functions.splitting import heading_sections, split_sections
from quire.settings import DEFAULTS, Settings


def with_quality(docs: DataFrame, text: str = "text", cfg: Settings = DEFAULTS) -> DataFrame:
    """Add ``quality`` (struct) and ``strategy``."""
    return pin(docs, "quality", built(diagnose, text, cfg)).withColumn("strategy", strategy(F.col("quality")))


def parent_chunks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    cfg: Settings = DEFAULTS,
    protect_tables: Column | None = None,
) -> DataFrame:
    """One row per parent: doc_id, chunk_id, parent_no, section_path, content, start_char_index, strategy.

    ``docs`` needs a ``strategy`` column. Numbering comes from the array position, so no window and no shuffle
    is needed. A flat_simple document has one layer only: its parents are its children.
    """
    tree = F.col("strategy") == "structured_clear"
    simple = F.col("strategy") == "flat_simple"
    plain = F.array(
        F.struct(
            F.array().cast("array<string>").alias("section_path"),
            F.col(text).alias("content"),
            F.lit(0).alias("start"),
        )
    )
    base = pin(
        docs, "_sections", F.when(tree, built(heading_sections, text, cfg.max_heading_level)).otherwise(plain)
    )
    cut = split_sections(
        base,
        F.transform("_sections", lambda s: s["content"]),
        F.when(tree, F.lit(cfg.parent_max_chars))
        .when(simple, F.lit(cfg.child_chunk_size))
        .otherwise(F.lit(cfg.parent_chunk_size)),
        F.when(simple, F.lit(cfg.child_overlap)).otherwise(F.lit(cfg.parent_overlap)),
        "_pieces",
        cfg.separators,
        protect_tables,
    )
    # Section facts join their pieces before the explode, so an exploded row carries one piece and no whole text.
    def locate(p: Column) -> Column:
        section = F.element_at("_heads", p["sec"] + 1)
        return F.struct(
            section["section_path"].alias("section_path"),
            p["content"].alias("content"),
            F.when(tree & section["whole"], section["start"]).otherwise(p["start"]).alias("start_char_index"),
        )

    heads = F.transform(
        "_sections",
        lambda s: F.struct(
            s["section_path"].alias("section_path"),
            s["start"].alias("start"),
            # A whole section starts where its heading does; a cut one counts from its own start.
            (F.length(s["content"]) <= cfg.parent_max_chars).alias("whole"),
        ),
    )
    slim = pin(cut, "_heads", heads).select(
        F.col(doc_id).cast("string").alias("doc_id"), "strategy", F.transform("_pieces", locate).alias("_pieces")
    )
    rows = slim.select("doc_id", "strategy", F.posexplode("_pieces").alias("parent_no", "_piece"))
    return rows.select(
        "doc_id",
        F.concat(
            F.col("doc_id"), F.when(simple, F.lit(":")).otherwise(F.lit(":p")), F.col("parent_no").cast("string")
        ).alias("chunk_id"),
        "parent_no",
        "_piece.section_path",
        "_piece.content",
        "_piece.start_char_index",
        "strategy",
    )


def child_chunks(
    parents: DataFrame, cfg: Settings = DEFAULTS, protect_tables: Column | None = None
) -> DataFrame:
    """Children of parents: doc_id, chunk_id, parent_id, child_no, section_path, content, start_char_index.

    Children of a flat_simple document are its parents, with an empty ``parent_id``.
    """
    simple = F.col("strategy") == "flat_simple"
    # One pass for both kinds: a parent that is its own child gets a size no text exceeds.
    rows = split_sections(
        parents,
        F.array("content"),
        F.when(simple, F.lit(2**31 - 1)).otherwise(F.lit(cfg.child_chunk_size)),
        F.when(simple, F.lit(0)).otherwise(F.lit(cfg.child_overlap)),
        "_pieces",
        cfg.separators,
        protect_tables,
    ).select(
        "doc_id",
        "chunk_id",
        "parent_no",
        "section_path",
        "start_char_index",
        simple.alias("_simple"),
        F.posexplode("_pieces").alias("_no", "_piece"),
    )
    alone = F.col("_simple")
    return rows.select(
        "doc_id",
        F.when(alone, F.col("chunk_id"))
        .otherwise(F.concat_ws(":c", "chunk_id", F.col("_no").cast("string")))
        .alias("chunk_id"),
        F.when(~alone, F.col("chunk_id")).alias("parent_id"),
        F.when(alone, F.col("parent_no")).otherwise(F.col("_no")).alias("child_no"),
        "section_path",
        F.col("_piece.content").alias("content"),
        F.when(alone, F.col("start_char_index")).otherwise(F.col("_piece.start")).alias("start_char_index"),
    )


def ingest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: Settings = DEFAULTS):
    """Documents to (parents, children)."""
    parents = parent_chunks(with_quality(docs, text, cfg), doc_id, text, cfg)
    return parents, child_chunks(parents, cfg)


def chunk_seq(chunk_id: Column) -> Column:
    """Sequence number at the end of a chunk id; 0 when its last segment holds no digit."""
    digits = F.regexp_replace(F.regexp_extract(chunk_id, r"([^:]*)$", 1), r"[^0-9]", "")
    return F.coalesce(F.try_to_number(F.when(digits != "", digits), F.lit("999999999999")).cast("long"), F.lit(0))


def parent_key(parent_id: Column, chunk_id: Column) -> Column:
    """Key for parent-level fusion: the parent, or the chunk itself when it has none."""
    return F.coalesce(F.nullif(parent_id, F.lit("")), chunk_id)
