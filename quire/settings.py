"""Tuning constants of the engine, kept in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Results depend on every number and separator below.
    child_chunk_size: int = 300
    child_overlap: int = 50
    parent_chunk_size: int = 1200
    parent_overlap: int = 0
    parent_max_chars: int = 8000
    separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", "；", "，", " ")
    max_heading_level: int = 4
    embed_token_limit: int = 8192
    heading_density_chars: int = 2000
    heading_density_min: int = 3
    fragmented_tokens: int = 200
    text_ratio_warn: float = 0.3
    table_atomic_max_chars: int = 11468
    top_k: int = 5
    candidate_k: int = 10
    rrf_k: int = 60
    rerank_top_k: int = 40
    pool_k: int = 40
    merge_boost: float = 0.0
    merge_min_child_hits: int = 2
    price_in_per_1k: float = 0.0003
    price_out_per_1k: float = 0.0012
    max_runs: int = 500
    ttl_minutes: int = 30
    html_min_text: int = 100
    html_low_text_tag_ratio: float = 10.0
    docx_min_text: int = 150
    pptx_min_text: int = 50
    pdf_sample_pages: int = 5
    pdf_min_text: int = 150
    pdf_text_page_ratio: float = 0.9
    pdf_column_gap: float = 40.0
    image_area_ratio: float = 0.3
    table_ratio: float = 0.3
    guard_window: int = 20
    min_paired_samples: int = 6
    alpha: float = 0.05
    # Published Okapi BM25 parameters; the tokenizer is pluggable.
    bm25_k1: float = 1.5
    bm25_b: float = 0.75


DEFAULTS = Settings()
