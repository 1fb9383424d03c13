"""Registry of named queries and their DuckDB oracle statements.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame over the full driver
tables; ``ORACLE[name]`` is an independent SQL statement over the same
tables.  Float columns are rounded to 4 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tickframe.plans import (  # noqa: F401
        q_analysis,
        q_extra,
        q_indicators,
        q_misc,
        q_models,
        q_operators,
        q_portfolio,
        q_stats,
        q_text,
        q_training,
    )
