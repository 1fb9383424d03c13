"""Sort, limit and top-k.

Top-k over all rows is ``orderBy(...).limit(k)``, which Spark plans as
TakeOrderedAndProject (each partition keeps k rows).  Top-k per group uses a
row_number window over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.series import BY


def trending(snapshots: DataFrame, *, col: str = "change_percent", by: str = BY) -> DataFrame:
    """Snapshots by absolute % change, descending (ties by symbol)."""
    return snapshots.orderBy(F.abs(F.col(col)).desc_nulls_last(), F.col(by).asc())


def movers_top_n(snapshots: DataFrame, n: int = 5, *, col: str = "change_percent", by: str = BY) -> DataFrame:
    """T5: the first n trending entries."""
    return trending(snapshots, col=col, by=by).limit(n)


def sector_top3(perf: DataFrame, *, n: int = 3, group: str = "sector", col: str = "performance",
                by: str = BY) -> DataFrame:
    """The n best performers per sector, with % performance; a sector's
    rank window holds its n survivors of the salted ranking only."""
    best = [F.col(col).desc(), F.col(by).asc()]
    w = Window.partitionBy(group).orderBy(*best)
    return (top_n_per_key(perf, group, best, n).withColumn("rank", F.row_number().over(w))
            .withColumn("performance_pct", F.col(col) * 100.0))


def first_n(df: DataFrame, n: int, *, order=None) -> DataFrame:
    """T4: the first n rows in a given order."""
    return (df.orderBy(*order) if order else df).limit(n)


def first_n_items(arr, n: int):
    """T4 (array form): the first n elements of an array column."""
    return F.slice(arr, 1, n)


def top_n_per_key(df: DataFrame, key: str, order, n: int, *, salt: int = 32) -> DataFrame:
    """The first n rows per key in ``order`` without ranking a hot key in one task.

    Stage 1 ranks inside (key, salt) where the salt is a hash of the whole
    row, so a key holding a third of all rows is spread over ``salt`` tasks;
    each keeps its n best.  Stage 2 ranks the at most n * salt survivors per
    key.  Deterministic: the salt depends only on row content.
    """
    s = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt))
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    w2 = Window.partitionBy(key).orderBy(*order)
    stage1 = df.withColumn("_salt", s).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    return (stage1.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n)
            .drop("_salt", "_r"))
