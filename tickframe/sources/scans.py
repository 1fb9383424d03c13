"""Sources, scans and sinks.

Scans are ``spark.read`` with filters Catalyst pushes into the Parquet
reader (symbol lists become ``In`` filters, date ranges become range
filters); sinks are ``DataFrame.write``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.operators.ranking import top_n_per_key
from tickframe.operators.series import BY

BARS_SCHEMA = T.StructType([
    T.StructField("symbol", T.LongType()), T.StructField("ts", T.DateType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType())])


def bars_scan(spark: SparkSession, path: str, *, symbols=None, start=None, end=None,
              fmt: str = "parquet") -> DataFrame:
    """Load bars, optionally for a symbol list (pushed as an In filter)."""
    df = spark.read.format(fmt).load(path)
    if symbols is not None:
        df = df.filter(F.col(BY).isin(list(symbols)))
    return bars_range(df, start=start, end=end)


def bars_range(df: DataFrame, *, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Explicit date range, start inclusive, end exclusive."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("date"))
    return df


_PERIOD_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}
_PERIOD_DAYS = {"1d": 1, "5d": 5}


def bars_lookback(df: DataFrame, period: str = "1y", *, by: str = BY, ts: str = "ts") -> DataFrame:
    """S3: relative period measured back from each symbol's last bar:
    1d, 5d (calendar days), 1mo..10y (months), ytd, max.  Keeps bars with
    ts > last - period (ytd: ts >= Jan 1 of the last bar's year)."""
    if period == "max":
        return df
    last = df.groupBy(by).agg(F.max(ts).alias("_last"))
    j = df.join(last, by)
    if period == "ytd":
        cond = F.col(ts) >= F.trunc("_last", "year")
    elif period in _PERIOD_DAYS:
        cond = F.col(ts) > F.date_sub("_last", _PERIOD_DAYS[period])
    elif period in _PERIOD_MONTHS:
        cond = F.col(ts) > F.add_months("_last", -_PERIOD_MONTHS[period])
    else:
        raise ValueError(f"unknown period {period!r}")
    return j.filter(cond).drop("_last")


_INTERVAL_TRUNC = {"1d": "day", "1wk": "week", "1mo": "month", "3mo": "quarter"}


def bars_resample(df: DataFrame, interval: str = "1wk", *, by: str = BY, ts: str = "ts") -> DataFrame:
    """OHLCV bars at a coarser interval: open = first, close = last
    (min_by / max_by on ts), high = max, low = min, volume = sum.  Calendar
    intervals use ``date_trunc``; '5d' and intraday sizes ('1m'..'1h') use
    fixed windows.  All aggregates are partial, so hot symbols combine map-side."""
    if interval in _INTERVAL_TRUNC:
        key = F.to_date(F.date_trunc(_INTERVAL_TRUNC[interval], F.col(ts))) if isinstance(
            df.schema[ts].dataType, T.DateType) else F.date_trunc(_INTERVAL_TRUNC[interval], F.col(ts))
    else:
        length = {"1m": "1 minute", "2m": "2 minutes", "5m": "5 minutes", "15m": "15 minutes",
                  "30m": "30 minutes", "60m": "60 minutes", "90m": "90 minutes", "1h": "1 hour",
                  "5d": "5 days"}[interval]
        key = F.window(F.col(ts).cast("timestamp"), length).start
    return (df.groupBy(by, key.alias("bucket"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"))
            .withColumnRenamed("bucket", ts))


def bars_envelope(df: DataFrame, *, by: str = BY, ts: str = "ts") -> DataFrame:
    """Per-symbol record count and date range."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("start_date"),
                              F.max(ts).alias("end_date"))


INFO_SCHEMA = T.MapType(T.StringType(), T.DoubleType())
INFO_FIELDS = ("trailingPE", "forwardPE", "pegRatio", "priceToBook", "grossMargins", "profitMargins",
               "revenueGrowth", "debtToEquity", "currentRatio", "marketCap", "beta")


def fundamentals_scan(info: DataFrame, *, col: str = "info", by: str = BY, fields=INFO_FIELDS) -> DataFrame:
    """Sparse company record (JSON text or map) -> typed columns with
    defaults (0; beta 1.0)."""
    m = F.from_json(F.col(col), INFO_SCHEMA) if isinstance(info.schema[col].dataType, T.StringType) else F.col(col)
    out = info.select(by, m.alias("_m"))
    cols = [F.coalesce(F.element_at("_m", f), F.lit(1.0 if f == "beta" else 0.0)).alias(f) for f in fields]
    return out.select(by, *cols)


def statements_unpivot(df: DataFrame, *, ids=(BY, "statement", "period"), value: str = "value",
                       item: str = "item") -> DataFrame:
    """Wide statement rows -> long (ids, item, value)."""
    vals = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), vals, item, value)


def news_scan(news: DataFrame, *, n: int = 20, by: str = BY, ts: str = "p_date",
              tie: str = "guid") -> DataFrame:
    """The n most recent articles per symbol (ties by guid); a busy
    symbol is ranked in salted parts first."""
    return top_n_per_key(news, by, [F.col(ts).desc(), F.col(tie).desc()], n)


def csv_semicolon_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S9: ';'-separated files with a header and a fixed schema (no inference)."""
    return spark.read.schema(schema).option("sep", ";").option("header", "true").csv(path)


NEWS_CSV_SCHEMA = T.StructType([
    T.StructField("guid", T.StringType()), T.StructField("stock", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("published", T.StringType()), T.StructField("p_date", T.StringType()),
    T.StructField("sentiment_summary", T.DoubleType()), T.StructField("sentiment_title", T.DoubleType())])

NEWS_PRICE_CSV_SCHEMA = T.StructType([
    T.StructField(c, t) for c, t in [
        ("id", T.StringType()), ("stock", T.StringType()), ("news_dt", T.StringType()),
        ("check_day", T.StringType()), ("open", T.DoubleType()), ("close", T.DoubleType()),
        ("high", T.DoubleType()), ("low", T.DoubleType()), ("volume", T.DoubleType()),
        ("change", T.DoubleType()), ("sentiment_summary_avg", T.DoubleType()),
        ("sentiment_summary_med", T.DoubleType()), ("sentiment_title_avg", T.DoubleType()),
        ("sentiment_title_med", T.DoubleType())]])


def csv_semicolon_sink(df: DataFrame, path: str) -> None:
    """S9 sink: ';'-separated with header."""
    df.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


# Fixed value: index ticker -> display name.
INDEX_NAMES = {"^GSPC": "S&P 500", "^DJI": "Dow Jones Industrial Average", "^IXIC": "NASDAQ Composite",
               "^RUT": "Russell 2000"}


def macro_scan(series_df: DataFrame, *, key: str = "series", names: dict | None = None) -> DataFrame:
    """Named index/macro series; ticker -> display name via a join to a
    literal dimension (unknown tickers keep their ticker)."""
    spark = series_df.sparkSession
    dim = spark.createDataFrame(list((names or INDEX_NAMES).items()), f"{key} string, name string")
    return (series_df.join(dim, key, "left")
            .withColumn("name", F.coalesce(F.col("name"), F.col(key))))


HISTORY_ENTRY = T.StructType([
    T.StructField("total_reward", T.DoubleType()), T.StructField("avg_reward", T.DoubleType()),
    T.StructField("model_weights", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("training_samples", T.LongType()), T.StructField("timestamp", T.StringType())])
HISTORY_SCHEMA = T.MapType(T.StringType(), T.ArrayType(HISTORY_ENTRY))


def history_json_sink(history: DataFrame, path: str, *, by: str = BY) -> None:
    """Performance history (one row per entry) -> JSON lines, one line
    per symbol holding its list of entries (newest last).  Cap the history
    first (W44): a line holds all of a symbol's entries."""
    nested = (history.groupBy(by)
              .agg(F.array_sort(F.collect_list(F.struct("timestamp", "total_reward", "avg_reward", "model_weights", "training_samples")),
                                lambda a, b: F.when(a["timestamp"] < b["timestamp"], -1).when(a["timestamp"] > b["timestamp"], 1)
                                .otherwise(0)).alias("entries")))
    nested.write.mode("overwrite").json(path)


def history_json_scan(spark: SparkSession, path: str, *, by: str = BY) -> DataFrame:
    """JSON lines written by ``history_json_sink`` -> one row per entry."""
    schema = T.StructType([T.StructField(by, T.StringType()),
                           T.StructField("entries", T.ArrayType(HISTORY_ENTRY))])
    return spark.read.schema(schema).json(path).select(by, F.explode("entries").alias("e")).select(by, "e.*")


def records_sink(df: DataFrame, path: str, *, fmt: str = "json", partition_by=None) -> None:
    """Table rows as records (JSON lines or Parquet)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


#: The score that a run can reach.
MAX_SCORE = 1e6


def model_sink(model, path: str, *, score: DataFrame | None = None, max_score: float = MAX_SCORE) -> None:
    """Persist a fitted MLlib model / pipeline model and, beside it, the score
    of its run: ``score`` has one row (current_score, timestamp), from which the
    share of ``max_score`` in percent follows.  An earlier model and score are replaced."""
    model.write().overwrite().save(path)
    if score is not None:
        current = F.col("current_score").cast("double")
        (score.select(current.alias("current_score"), F.lit(float(max_score)).alias("max_score"),
                      (current / max_score * 100.0).alias("progress_percentage"), F.col("timestamp").cast("string").alias("timestamp"))
         .write.mode("overwrite").json(f"{path}/performance"))


def score_scan(spark: SparkSession, path: str) -> DataFrame:
    """The score stored beside a model by ``model_sink``."""
    return spark.read.schema("current_score double, max_score double, progress_percentage double, timestamp string").json(f"{path}/performance")


def model_scan(path: str, cls=None):
    """Load a model saved by ``model_sink`` (PipelineModel by default)."""
    if cls is None:
        from pyspark.ml import PipelineModel as cls
    return cls.load(path)


def dataset_summary(**sources: DataFrame) -> DataFrame:
    """Distinct entity count per gathered dataset: keyword = (df, key col)."""
    parts = []
    for name, (df, key) in sources.items():
        parts.append(df.agg(F.count_distinct(key).alias("entities")).select(F.lit(name).alias("dataset"),
                                                                           "entities"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
