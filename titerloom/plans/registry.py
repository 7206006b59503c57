"""Queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "overview_payload"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a function as the query of its name."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return enter


from titerloom.plans import log_queries, marker_queries, registry_queries, rule_queries, runlog_queries, text_queries, view_queries, work_queries  # noqa: E402, F401
