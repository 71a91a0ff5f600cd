"""All registered queries and their SQL."""

from __future__ import annotations

from quire.plans import documents, evaluation, extras, indexes, more, parsing, quality, retrieval, streams

MODULES = (documents, retrieval, evaluation, quality, streams, more, extras, indexes, parsing)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
