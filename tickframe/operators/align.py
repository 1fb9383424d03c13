"""Joins and set operations on series.

Dimension tables (fundamentals, sectors, weights, lexicon) are joined with a
plain equi-join: Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime), and
otherwise shuffles it, so nothing unbounded is ever forced into a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import ordered, series
from tickframe.operators.series import BY

MAX_PAIR_UNIVERSE = 1000
#: Parts that a calendar bucket's bars are spread over in the as-of join.
SALTS = 16


def align_inner(bars: DataFrame, index: DataFrame, *, on: str = "ts", suffix: str = "_idx") -> DataFrame:
    """Bars x index series on common dates (inner equi-join)."""
    idx = index.select(on, *[F.col(c).alias(f"{c}{suffix}") for c in index.columns if c not in (on, BY)])
    return bars.join(idx, on, "inner")


def _ordinals(dates: DataFrame, ts: str) -> DataFrame:
    """(ts, _ord, _dates): the place of each date in the calendar, from 0, and the number of dates."""
    days = dates.select(ts).filter(F.col(ts).isNotNull()).distinct()
    placed = ordered.prefix(ordered.spread(days, ts), [ts], [(F.lit(1), "sum", "_ord")])
    size = days.agg(F.count(F.lit(1)).alias("_dates"))  # one row
    return placed.select(ts, (F.col("_ord") - 1).alias("_ord")).join(F.broadcast(size))


@series.series_op
def _gap_ends(df: DataFrame, *, by: str = BY) -> DataFrame:
    """The place of the symbol's next row (null after the last), and whether this is its first row."""
    return (df.withColumn("_next", series.lead("_ord", 1, by))
            .withColumn("_head", F.col(series.RN) == 0))


def date_gaps(rows: DataFrame, dates: DataFrame, *, by: str = BY, ts: str = "ts", outer: bool = True) -> DataFrame:
    """(by, gap_from, gap_to): runs of calendar places without a row of the symbol,
    both ends included; with ``outer`` also before its first and after its last row.
    One row per gap, however long; rows off the calendar take no part."""
    placed = rows.select(by, ts).distinct().join(_ordinals(dates, ts), ts)
    ends = _gap_ends(placed, by=by, ts=ts)
    before = F.when(F.col("_head"), F.struct(F.lit(0).cast("long").alias("a"), (F.col("_ord") - 1).alias("b")))
    after = F.struct((F.col("_ord") + 1).alias("a"), (F.coalesce("_next", "_dates") - 1).alias("b"))
    if not outer:
        before, after = F.lit(None).cast("struct<a:bigint,b:bigint>"), F.when(F.col("_next").isNotNull(), after)
    gaps = ends.select(by, F.explode(F.array(before, after)).alias("g")).filter("g.a <= g.b")
    return gaps.select(by, F.col("g.a").alias("gap_from"), F.col("g.b").alias("gap_to"))


def _expanded(gaps: DataFrame, dates: DataFrame, *, by: str, ts: str) -> DataFrame:
    """(ts, by) of every date in the gaps."""
    places = _ordinals(dates, ts).select(ts, "_ord")
    return gaps.select(by, F.explode(F.sequence("gap_from", "gap_to")).alias("_ord")).join(places, "_ord").select(ts, by)


def align_outer(returns: DataFrame, *, value: str = "ret", by: str = BY, ts: str = "ts", fill: float | None = None) -> DataFrame:
    """Values of many series on the union of their dates, in long form.

    Every symbol has a row for every date of the union; a missing value is
    null, or ``fill`` (0.0 for the portfolio sum).  Missing dates come from the
    gaps between a symbol's rows, one row per gap, expanded here; consumers that
    skip them (A7, A26) read the returns as they are.
    """
    missing = _expanded(date_gaps(returns, returns, by=by, ts=ts), returns, by=by, ts=ts)
    kind = returns.schema[value].dataType
    return returns.select(ts, by, value).unionByName(missing.withColumn(value, F.lit(fill).cast(kind)))


def asof_ffill(bars: DataFrame, slow: DataFrame, *, value: str, by: str = BY, ts: str = "ts",
               name: str | None = None, bucket: str = "month") -> DataFrame:
    """The last ``slow`` value at or before each bar (backward as-of),
    plus its percentage change along the bar series.

    Per calendar bucket the slow table gives its own values and, from the
    bucket's start, the last value of an earlier bucket (a window over the
    calendar of buckets, not over rows); bars meet them in a salted equi-join
    on the bucket, filtered to the value's interval.  Bars before the first
    slow row keep a null value.
    """
    name = name or value
    p = series.prepare(asof_value(bars, slow, value=value, by=by, ts=ts, name=name, bucket=bucket), by, ts)
    return series.finish(value_change(p, name, by=by))


@series.series_op
def value_change(df: DataFrame, name: str, *, by: str = BY) -> DataFrame:
    """The percentage change of ``name`` along the series."""
    return df.withColumn(f"{name}_change", F.try_divide(F.col(name), series.lag(name, 1, by)) - 1.0)


def asof_value(bars: DataFrame, slow: DataFrame, *, value: str, by: str = BY, ts: str = "ts",
               name: str | None = None, bucket: str = "month") -> DataFrame:
    """The join of ``asof_ffill`` without the change."""
    name = name or value
    at = lambda c: F.date_trunc(bucket, F.col(c))
    own = slow.select(at(ts).alias("_b"), F.col(ts).cast("timestamp").alias("_lo"), F.col(value).cast("double").alias("_v"))
    calendar = (bars.select(at(ts).alias("_b")).distinct().withColumn("_last", F.lit(None).cast("double"))
                .unionByName(own.groupBy("_b").agg(F.max_by("_v", "_lo").alias("_last")))
                .groupBy("_b").agg(F.max("_last").alias("_last")))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carried = calendar.select("_b", F.col("_b").alias("_lo"), F.last("_last", ignorenulls=True).over(earlier).alias("_v"), F.lit(0).alias("_k"))
    within = Window.partitionBy("_b").orderBy("_lo", "_k")
    iv = (carried.unionByName(own.withColumn("_k", F.lit(1)))
          .withColumn("_hi", F.lead("_lo", 1).over(within)).drop("_k")
          .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    b = bars.withColumn("_b", at(ts)).withColumn("_s", F.pmod(F.xxhash64(by, ts), F.lit(SALTS)).cast("int"))
    when = b[ts].cast("timestamp")
    cond = (b["_b"] == iv["_b"]) & (b["_s"] == iv["_s"]) & (when >= iv["_lo"]) & (iv["_hi"].isNull() | (when < iv["_hi"]))
    return b.join(iv, cond, "left").select(*[b[c] for c in bars.columns], iv["_v"].alias(name))


def attach(bars: DataFrame, dim: DataFrame, *, on: str = BY, defaults: dict | None = None) -> DataFrame:
    """Per-key attributes onto every row (left join) with
    defaults for missing keys."""
    out = bars.join(dim, on, "left")
    return out.fillna(defaults) if defaults else out


def attach_fundamentals(bars: DataFrame, fundamentals: DataFrame, *, on: str = BY) -> DataFrame:
    """Fundamentals onto every bar; missing values 0, beta 1."""
    return attach(bars, fundamentals, on=on, defaults=fundamental_defaults(fundamentals, on))


def fundamental_defaults(fundamentals: DataFrame, on: str = BY) -> dict:
    return {c: 1.0 if c == "beta" else 0.0 for c in fundamentals.columns if c != on}


#: What a symbol without news counts.
SENTIMENT_DEFAULTS = {"sentiment_score": 50.0, "news_count": 0}


def attach_sentiment(bars: DataFrame, sentiment: DataFrame, *, on: str = BY,
                     score: str = "sentiment_score", count: str = "news_count") -> DataFrame:
    """Per-symbol sentiment onto every bar; default score 50, count 0."""
    return attach(bars, sentiment.select(on, score, count), on=on, defaults={score: 50.0, count: 0})


def packed(bars: DataFrame, dim: DataFrame, name: str, *, on: str = BY) -> DataFrame:
    """``dim``'s rows of each key as one array column: ``attach`` for narrow rows
    ahead of windows, which must not see a bar twice where a key repeats."""
    rows = dim.groupBy(on).agg(F.collect_list(F.struct(*[c for c in dim.columns if c != on])).alias(name))
    return bars.join(rows, on, "left")


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """One row per packed row of ``name``, its fields as columns (nulls for a missing key)."""
    fields = df.schema[name].dataType.elementType.names
    out = df.withColumn(name, F.explode_outer(name))
    return out.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{f}").alias(f) for f in fields])


def attach_sector(df: DataFrame, sectors: DataFrame, *, on: str = BY) -> DataFrame:
    """Symbol -> sector, industry ('Unknown' when missing)."""
    return attach(df, sectors, on=on, defaults={"sector": "Unknown", "industry": "Unknown"})


def symbols_without_data(universe: DataFrame, bars: DataFrame, *, on: str = BY):
    """(kept, reported) = universe members with bars (semi join) and
    without (anti join)."""
    keys = bars.select(on).distinct()
    return universe.join(keys, on, "left_semi"), universe.join(keys, on, "left_anti")


def horizon_cross(df: DataFrame, days=(7, 14, 21, 30), *, n: int | None = None) -> DataFrame:
    """Each row x forecast day (explicit list, or 1..n)."""
    arr = F.sequence(F.lit(1), F.lit(n)) if n else F.array(*[F.lit(d) for d in days])
    return df.withColumn("day", F.explode(arr))


def attach_weights(df: DataFrame, weights: DataFrame | None, *, on: str = BY) -> DataFrame:
    """Weights by key; equal weights over the symbols present when none given."""
    if weights is not None:
        return df.join(weights, on, "inner")
    k = df.select(on).distinct().count()
    return df.withColumn("weight", F.lit(1.0 / k) if k else F.lit(None).cast("double"))


def pairwise_series(returns: DataFrame, universe: DataFrame, *, value: str = "ret", by: str = BY,
                    ts: str = "ts") -> DataFrame:
    """(sym_a, sym_b) pairs on the same date, a <= b, for a bounded
    universe (the portfolio's symbols).

    Pairs are emitted only inside the universe: per date at most k(k+1)/2
    rows for k universe symbols, and k is checked against MAX_PAIR_UNIVERSE.
    """
    k = universe.select(by).distinct().count()
    if k > MAX_PAIR_UNIVERSE:
        raise ValueError(f"pairwise universe of {k} symbols exceeds {MAX_PAIR_UNIVERSE}")
    r = returns.join(universe.select(by).distinct(), by, "left_semi").select(ts, by, value).filter(
        F.col(value).isNotNull())
    a = r.select(ts, F.col(by).alias("sym_a"), F.col(value).alias("ret_a"))
    b = r.select(ts, F.col(by).alias("sym_b"), F.col(value).alias("ret_b"))
    return a.join(b, ts).filter(F.col("sym_a") <= F.col("sym_b"))


def common_dates(left: DataFrame, right: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Dates present in both series."""
    return left.select(ts).intersect(right.select(ts))


def union_dates(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """The union of dates over all symbols."""
    return df.select(ts).distinct()


def union_samples(*frames: DataFrame) -> DataFrame:
    """Append samples of several frames by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_levels(df: DataFrame, col: str) -> DataFrame:
    """U4: distinct labels."""
    return df.select(col).distinct()


def missing_dates(calendar: DataFrame, bars: DataFrame, *, by: str = BY, ts: str = "ts") -> DataFrame:
    """Calendar dates inside each symbol's own first..last date that the
    symbol lacks: the gaps between its rows, expanded.  Bars off the calendar
    are no ends of a gap."""
    return _expanded(date_gaps(bars, calendar, by=by, ts=ts, outer=False), calendar, by=by, ts=ts).select(by, ts)
