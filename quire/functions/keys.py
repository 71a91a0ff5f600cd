"""Keys of cached model calls: everything an answer depends on is part of the key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import sha_prefix


def _digest(text: str, width: int) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:width]


def config_hash(model: str, temperature: float, max_tokens: int, top_p: float, template: str) -> str:
    """Twelve hex digits of a generator's settings and prompt template."""
    return _digest("|".join([model, str(temperature), str(max_tokens), str(top_p), _digest(template, 16)]), 12)


def prompt_version(*templates: str) -> str:
    """Eight hex digits per template, joined by slashes."""
    return "/".join(_digest(t, 8) for t in templates)


def _key(kind: str, *parts: Column | str) -> Column:
    """Null if any part is null: such a call has no key and is not cached."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in (kind, *parts)]
    return F.concat(*[c for part in columns for c in (F.lit(":"), part)][1:])


def generator_key(query_id: Column, context: Column, config: str) -> Column:
    return _key("generator", query_id, sha_prefix(context, 16), config)


def judge_key(query_id: Column, context: Column, config: str, version: str, model: str) -> Column:
    return _key("judge", query_id, sha_prefix(context, 16), config, version, model)


def rerank_key(query: Column, model_version: str, signature: Column | str, enriched: bool) -> Column:
    """The pool of candidates follows from query and corpus, so their ids are no part of the key."""
    return _key("rerank", sha_prefix(query, 16), model_version, signature, "e" if enriched else "")
