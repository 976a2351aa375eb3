"""Registry of named queries: ``QUERIES[name](spark, sf_dir)`` and ``ORACLE_SQL[name]``."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Modules of this package that add queries.
FAMILIES = ("series_queries", "cluster_queries", "forecast_queries", "retrieval_queries", "stream_queries", "markdown_queries", "hierarchy_queries", "report_queries")


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives the same rows."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


for _family in FAMILIES:
    importlib.import_module(f"opsweave.plans.{_family}")
