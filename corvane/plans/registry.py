"""Queries over the driver's tables and the SQL that checks them, by operator family."""

from __future__ import annotations

from . import queries_graph, queries_lexical, queries_retrieval, queries_sets, queries_text

MODULES = (queries_text, queries_lexical, queries_graph, queries_retrieval, queries_sets)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
