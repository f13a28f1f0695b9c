"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from textloom.plans import engine_queries, orphan_queries, phrase_queries, span_queries, stream_queries, tag_queries, word_queries

_MODULES = (word_queries, span_queries, tag_queries, phrase_queries, stream_queries, orphan_queries, engine_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
