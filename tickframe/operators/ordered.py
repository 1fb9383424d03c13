"""Exact percentiles and running totals without a task that holds a whole key.

``exact_percentiles`` selects by rank: a histogram over a monotone code of the
value (``1/scale`` of an octave per cell, combined map-side) says which cells
hold the wanted ranks, and only the rows of those cells are ranked.  Nothing
is approximate, and no aggregation buffer holds a key's values.

``spread`` and ``prefix`` are a prefix scan over a global order: rows are cut
into ranges of the order by ``RANGES`` - 1 split points, each range is summed,
and a row's running value is that of its range plus the earlier ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram cells per octave of the value.
SCALE = 256
RANGES = 256
#: The range of a row in a global order.
RANGE = "_range"

_BEFORE = Window.unboundedPreceding, 0
_HOW = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, lambda a, b: F.greatest(a, b)), "min": (F.min, lambda a, b: F.least(a, b))}


def _code(x: Column, scale: int) -> Column:
    """A whole number that never falls when ``x`` grows; NaN is the largest.
    |log2 x| is below 1075 for every double; infinity counts as 2^2000."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(2000.0)) * scale).cast("long") + 1100 * scale
    code = (F.when(F.isnan(x), F.lit(4000 * scale)).when(x == 0, F.lit(0)).when(x < 0, -size).otherwise(size)).cast("long")
    return F.coalesce(code, F.lit(0).cast("long"))  # never null: a join on it adds no filter that works ``x`` out again


def exact_percentiles(df: DataFrame, by: str, col: str, quantiles: dict[str, float], *, scales=(SCALE,)) -> DataFrame:
    """(by, one column per quantile), interpolated linearly between the two
    nearest ranks.  Nulls in ``col`` are left out; a key without values has
    nulls.  ``scales`` (each a multiple of the one before) narrows the cells
    step by step: one more reading of ``df`` for each, for very large keys.
    """
    vals = df.select(F.col(by).alias("_k"), F.col(col).cast("double").alias("_x")).filter("_x is not null")
    scale = scales[0]
    cells = (vals.groupBy("_k", _code(F.col("_x"), scale).alias("_c")).agg(F.count(F.lit(1)).alias("_f"))
             .withColumn("_n", F.sum("_f").over(Window.partitionBy("_k")))
             .select("_k", "_c", "_f", F.lit(0).cast("long").alias("_below"), _ranks(F.col("_n"), quantiles.values()).alias("_ranks")))
    wants = _wanted(cells, ["_k"], "_c")
    for finer in scales[1:]:
        cells = _counted(_held(vals, wants, scale).withColumn("_c", _code(F.col("_x"), finer)), "_c")
        wants, scale = _wanted(cells, ["_k", "_old"], "_c"), finer
    found = _wanted(_counted(_held(vals, wants, scale), "_x"), ["_k", "_old"], "_x").select("_k", "_x", F.explode("_ranks").alias("_r"))
    at = lambda i, hi: F.max(F.when((F.col("_r.i") == i) & (F.col("_r.hi") == hi), F.col("_x")))
    part = lambda i: F.max(F.when(F.col("_r.i") == i, F.col("_r.part")))
    value = lambda i: F.when(part(i) == 0, at(i, 0)).otherwise(at(i, 0) * (1 - part(i)) + at(i, 1) * part(i))
    got = found.groupBy("_k").agg(*[value(i).alias(name) for i, name in enumerate(quantiles)])
    keys = df.select(F.col(by)).distinct()
    return keys.join(got, keys[by].eqNullSafe(got["_k"]), "left").drop("_k")


def _ranks(n: Column, quantiles) -> Column:
    """The 0-based ranks that the quantiles of ``n`` values lie between."""
    out = []
    for i, q in enumerate(quantiles):
        place = F.lit(float(q)) * (n - 1)
        low = F.floor(place).cast("long")
        for hi, rank in enumerate((low, F.least(low + 1, n - 1))):
            out.append(F.struct(F.lit(i).alias("i"), F.lit(hi).alias("hi"), rank.cast("long").alias("rank"), (place - low).alias("part")))
    return F.array(*out)


def _wanted(cells: DataFrame, group: list[str], order: str) -> DataFrame:
    """The cells that hold wanted ranks, with the rows below them."""
    upto = F.col("_below") + F.sum("_f").over(Window.partitionBy(*group).orderBy(order).rowsBetween(*_BEFORE))
    here = cells.withColumn("_upto", upto).withColumn("_under", F.col("_upto") - F.col("_f"))
    here = here.withColumn("_ranks", F.filter("_ranks", lambda r: (r["rank"] >= F.col("_under")) & (r["rank"] < F.col("_upto"))))
    return here.filter(F.size("_ranks") > 0).select("_k", order, F.col("_under").alias("_below"), "_ranks")


def _held(vals: DataFrame, wants: DataFrame, scale: int) -> DataFrame:
    """The rows of the wanted cells."""
    wants = wants.withColumnsRenamed({"_k": "_wk", "_c": "_old"})
    coded = vals.withColumn("_vc", _code(F.col("_x"), scale))
    return (coded.join(wants, F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("_vc") == F.col("_old")))
            .select("_k", "_old", "_x", "_below", "_ranks"))


def _counted(held: DataFrame, order: str) -> DataFrame:
    return held.groupBy("_k", "_old", order).agg(F.count(F.lit(1)).alias("_f"), F.first("_below").alias("_below"),
                                                 F.first("_ranks").alias("_ranks"))


def spread(df: DataFrame, order: str, *, ranges: int = RANGES) -> DataFrame:
    """Add the row's range in the order of column ``order`` (nulls first).

    The split points are the values with the smallest hashes, so every reading
    finds the same ones.
    """
    drawn = df.select(F.col(order).alias("_s")).filter("_s is not null").distinct()
    drawn = drawn.orderBy(F.xxhash64("_s"), "_s").limit(ranges - 1)
    splits = drawn.agg(F.sort_array(F.collect_list("_s")).alias("_splits"))  # one row
    low = F.size(F.filter("_splits", lambda s: s < F.col(order)))
    return df.join(F.broadcast(splits)).withColumn(RANGE, F.when(F.col(order).isNull(), F.lit(-1)).otherwise(low)).drop("_splits")


def prefix(df: DataFrame, order: list[str], what: list[tuple[Column, str, str]]) -> DataFrame:
    """Add running ``sum|max|min`` columns (x, how, name) over the global order
    of a frame that ``spread`` has cut."""
    totals = (df.groupBy(RANGE).agg(*[_HOW[how][0](x).alias(name) for x, how, name in what])
              .agg(F.collect_list(F.struct(RANGE, *[name for _, _, name in what])).alias("_totals")))  # one row of RANGES structs
    out = df.join(F.broadcast(totals))
    here = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(*_BEFORE)
    for x, how, name in what:
        agg, both = _HOW[how]
        out = out.withColumn("_carry", _carry(name, both)).withColumn("_local", agg(x).over(here))
        value = (F.when(F.col("_carry").isNull(), F.col("_local")).when(F.col("_local").isNull(), F.col("_carry"))
                 .otherwise(both(F.col("_carry"), F.col("_local"))))
        out = out.withColumn(name, value).drop("_carry", "_local")
    return out.drop("_totals")


def _carry(name: str, both) -> Column:
    """The total of ``name`` over all earlier ranges; null without one."""
    earlier = F.filter("_totals", lambda t: (t[RANGE] < F.col(RANGE)) & t[name].isNotNull())
    values = F.transform(F.array_sort(earlier), lambda t: t[name])
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, RANGES + 1), F.get(values, F.lit(0)), both))
