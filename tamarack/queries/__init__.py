"""Registered queries, and SQL that says the same in DuckDB's dialect."""

from __future__ import annotations

from tamarack.queries import functions, graph, markdown, relations

QUERIES, ORACLE_SQL = {}, {}
for _part in (graph, functions, relations, markdown):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
