"""All queries over the fixture layers and their SQL."""

from __future__ import annotations

from loamgrid.plans import kernel_queries, relational

QUERIES = relational.QUERIES | kernel_queries.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | kernel_queries.ORACLE_SQL
