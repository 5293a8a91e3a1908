"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from granula.plans import instance_queries, report_queries, table_queries, voxel_queries

PARTS = (voxel_queries, instance_queries, table_queries, report_queries)
flagship = voxel_queries.flagship


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
