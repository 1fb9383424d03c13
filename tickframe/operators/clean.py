"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions.signals import clamp as _clamp
from tickframe.operators import ordered
from tickframe.operators.series import BY

OHLCV = ("open", "high", "low", "close", "volume")


def select_available(df: DataFrame, columns, *, keep=()) -> DataFrame:
    """Keep the requested feature columns that exist (plus ``keep``)."""
    have = set(df.columns)
    return df.select(*[c for c in keep if c in have], *[c for c in columns if c in have])


def select_numeric(df: DataFrame, *, exclude=OHLCV, keep=()) -> DataFrame:
    """Every numeric column except the targets (OHLCV), plus ``keep``."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in exclude and f.name not in keep
           and not f.name.startswith("_")]
    return df.select(*keep, *num)


def default_missing(df: DataFrame, defaults: dict | None = None, *, columns=None) -> DataFrame:
    """Absent (null) fundamentals -> 0, beta -> 1.0."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    d = {c: 0.0 for c in cols}
    if "beta" in d:
        d["beta"] = 1.0
    d.update(defaults or {})
    return df.fillna(d)


def drop_incomplete(df: DataFrame, *, columns=None) -> DataFrame:
    """Drop rows with a null in any (given) column (warm-up removal)."""
    return df.na.drop(subset=columns)


def fill_default(df: DataFrame, defaults: dict) -> DataFrame:
    """P5: null -> per-column default (0; 50 for sentiment)."""
    return df.fillna(defaults)


def replace_inf(df: DataFrame, *, columns=None, value: float = 0.0) -> DataFrame:
    """±inf and NaN -> ``value`` in float columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = []
    for c in df.columns:
        if c in cols:
            x = F.col(c)
            bad = x.isin(float("inf"), float("-inf")) | F.isnan(x)
            out.append(F.when(bad, F.lit(value)).otherwise(x).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def normalize_symbol(df: DataFrame, col: str = "symbols", *, out: str = "symbol") -> DataFrame:
    """Comma-separated list -> one trimmed, upper-cased symbol per row."""
    return (df.withColumn(out, F.explode(F.split(F.col(col), ",")))
            .withColumn(out, F.upper(F.trim(F.col(out)))).filter(F.col(out) != ""))


def scale_units(df: DataFrame, columns, *, factor: float = 1e9, suffix: str = "_bn") -> DataFrame:
    """Money columns in billions."""
    return df.select("*", *[(F.col(c) / factor).alias(f"{c}{suffix}") for c in columns])


def require_history(df: DataFrame, n: int, *, by: str = BY):
    """(kept, rejected): symbols with at least n rows; the rejected
    symbols are reported with their count, not dropped silently.
    The counts are a partial aggregation joined back on the key."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    ok = counts.filter(F.col("rows") >= n).select(by)
    return df.join(ok, by, "left_semi"), counts.filter(F.col("rows") < n)


def select_report(report: DataFrame, branch: str, *, keys=(BY,)) -> DataFrame:
    """P10: project one branch of a nested report struct."""
    return report.select(*keys, f"{branch}.*")


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Bound to [lo, hi], null kept."""
    return _clamp(x, lo, hi)


def validate_weights(weights: DataFrame, *, by: str = BY, col: str = "weight", percent: bool = False):
    """(valid, rejected): weights must be in (0, 100] (percent) or
    (0, 1]; the running total in key order must stay <= 100 % (1.0).
    The running total is a prefix scan over ranges of the key."""
    cap = 100.0 if percent else 1.0
    run = ordered.prefix(ordered.spread(weights, by), [by], [(F.col(col), "sum", "_run")]).drop(ordered.RANGE)
    chk = (run
           .withColumn("reason", F.when((F.col(col) <= 0) | (F.col(col) > cap), F.lit("weight out of range"))
                       .when(F.col("_run") > cap + 1e-9, F.lit("total above 100%"))))
    return (chk.filter(F.col("reason").isNull()).drop("_run", "reason"),
            chk.filter(F.col("reason").isNotNull()).drop("_run"))
