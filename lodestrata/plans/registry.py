"""Queries of the engine and SQL that gives the same rows."""

from __future__ import annotations

from . import catalog_queries, corpus_queries, provider_queries

QUERIES: dict = {**corpus_queries.QUERIES, **catalog_queries.QUERIES, **provider_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus_queries.ORACLE_SQL, **catalog_queries.ORACLE_SQL, **provider_queries.ORACLE_SQL}
