"""Registry of the grid-relational queries and their SQL."""

from __future__ import annotations

from gridloom.plans import data_queries, grid_queries, table_queries  # noqa: F401  (they register themselves)


def queries() -> dict:
    return dict(grid_queries.Q)


def oracle_sql() -> dict:
    return dict(grid_queries.SQL)
