"""Helpers for the DuckDB oracle SQL (independent re-statements of each query).

The oracle deliberately computes things the plain way: row numbers from
``ROW_NUMBER()``, EWMs row by row in a recursive CTE, exact percentiles with
``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.sources.fixtures import with_fixtures

DIGITS = 4


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every float column half up on its binary value, so that both
    engines agree on ties (adding 0.0 folds -0.0 into 0.0)."""
    scale = float(10 ** digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            cols.append((F.when(F.abs(x) < 1e11, F.floor(x * scale + 0.5) / scale).otherwise(x) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def R(sql: str, *double_cols: str, digits: int = DIGITS) -> str:
    """Wrap ``sql`` so the listed float columns are rounded like ``rounded``."""
    if not double_cols:
        return sql
    scale = float(10 ** digits)
    x = "CAST({c} AS DOUBLE)"
    rep = ", ".join(f"CASE WHEN ABS({x}) < 1e11 THEN FLOOR({x} * {scale} + 0.5) / {scale} ELSE {x} END + 0.0 AS {{c}}".format(c=c)
                    for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def Q(sql: str, *fixtures: str, doubles=()) -> str:
    """Fixture CTEs + rounding: the usual oracle statement."""
    return R(with_fixtures(sql, *fixtures), *doubles)


def series_cte(name: str = "br", src: str = "bars", by: str = "symbol", order: str = "ts") -> str:
    return (f"{name} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS rn, "
            f"COUNT(*) OVER (PARTITION BY {by}) AS n FROM {src})")


def ewm_cte(name: str, src: str, x: str, alpha: float, adjust: bool, *, start: int = 0,
            min_periods: int = 0, by: str = "symbol") -> str:
    """CTE ``name(by, rn, val)``: pandas ewm of column ``x`` of ``src(by, rn, x)``."""
    q = 1.0 - alpha
    mp = max(min_periods, 1) - 1
    step = f"r.num * {q!r} + s.x, r.den * {q!r} + 1.0" if adjust else f"r.num * {q!r} + s.x * {alpha!r}, 1.0"
    return (f"{name} AS (WITH RECURSIVE s AS MATERIALIZED (SELECT {by}, rn, COALESCE(CAST({x} AS DOUBLE), 0.0) AS x FROM {src}), "
            f"r({by}, rn, num, den) AS (SELECT {by}, rn, x, 1.0::DOUBLE FROM s WHERE rn = {start} "
            f"UNION ALL SELECT s.{by}, s.rn, {step} FROM r JOIN s ON s.{by} = r.{by} AND s.rn = r.rn + 1) "
            f"SELECT {by}, rn, CASE WHEN rn - {start} >= {mp} THEN num / den END AS val FROM r)")


def full(agg: str, x: str, n: int, win: str) -> str:
    """SQL for pandas rolling(n): null until the frame holds n values."""
    return f"CASE WHEN COUNT({x}) OVER {win} = {n} THEN {agg} OVER {win} END"


def rows_window(n: int, base: str = "w") -> str:
    return f"({base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
