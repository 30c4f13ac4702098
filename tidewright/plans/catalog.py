"""All registered queries of the cleaning engine, and SQL that gives the same rows."""

from __future__ import annotations

from . import scalar_queries, table_queries

QUERIES = scalar_queries.QUERIES | table_queries.QUERIES
ORACLE = scalar_queries.ORACLE | table_queries.ORACLE
