"""All queries of the library proper, by name."""

from __future__ import annotations

from siftwell.plans import file_queries, graph_queries, records, text_queries

_MODULES = [records, text_queries, graph_queries, file_queries]
FLAGSHIP = text_queries.QUERIES["ret_tfidf"]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
