"""Collects the registered queries: name -> (Spark callable, SQL oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from evalweave.registry import (  # noqa: F401 - each module registers its queries
        compare_queries, gate_queries, item_queries, metric_queries, source_queries, stream_queries,
        summary_queries, text_queries,
    )
    return dict(QUERIES), dict(ORACLES)
