"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query derives its inputs from the whole base tables (``sources.derived``),
runs the operator, and ends in a flat report projection whose column names
match the DuckDB oracle (``plans.oracle``). Doubles that come out of
aggregation are rounded to 6 digits on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # importing the modules registers their queries
    from . import q_conversations, q_documents, q_memory, q_migration, q_retention, q_streaming, q_tracing  # noqa: F401
    return dict(QUERIES)
