"""Registered queries for single operators: sources and sinks (S1, S7, S9-S13),
cleaning (P1, P5, P7-P10), joins (J1, J5), labels and forms (X8, X11, X12,
X14, X15, X17, X22), and the rest (W44, A34, A36, T4, U3, U4, M3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import signals as sg
from tickframe.operators import align, clean, ranking, series
from tickframe.operators import indicators as ind
from tickframe.operators import stats as st
from tickframe.plans import models as ml
from tickframe.plans.catalog import query
from tickframe.plans.sqlkit import Q, R, rounded
from tickframe.session import checkpoint_dir
from tickframe.sources import fixtures as fx
from tickframe.sources import scans

_OHLCV = ("open", "high", "low", "close", "volume")


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("bars_scan", Q("SELECT * FROM bars WHERE symbol IN (1, 2, 3) AND ts >= DATE '1994-01-01' AND ts < DATE '1997-01-01'", "bars", doubles=_OHLCV))
def q_bars_scan(spark, sf_dir):
    """S1 + S12: bars stored by symbol, scanned again for a list and a range."""
    path = _folder(spark, "bars")
    scans.records_sink(fx.bars(spark, sf_dir), path, fmt="parquet")
    return rounded(scans.bars_scan(spark, path, symbols=[1, 2, 3], start="1994-01-01", end="1997-01-01"))


_STATEMENTS = """SELECT s_suppkey AS symbol, 'balance' AS statement, CAST(s_nationkey AS VARCHAR) AS period,
  CAST(s_acctbal AS DOUBLE) AS total_assets, CAST(s_acctbal AS DOUBLE) / 4 AS total_debt FROM supplier"""


@query("statements_unpivot", R(f"SELECT * FROM ({_STATEMENTS}) UNPIVOT (value FOR item IN (total_assets, total_debt))", "value"))
def q_statements_unpivot(spark, sf_dir):
    """Wide statement rows to (symbol, statement, period, item, value)."""
    wide = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"), F.lit("balance").alias("statement"), F.col("s_nationkey").cast("string").alias("period"),
        F.col("s_acctbal").cast("double").alias("total_assets"), (F.col("s_acctbal").cast("double") / 4).alias("total_debt"))
    return rounded(scans.statements_unpivot(wide))


@query("csv_semicolon_scan", Q("SELECT symbol, ts, open, high, low, close, volume FROM bars", "bars", doubles=_OHLCV))
def q_csv_semicolon_scan(spark, sf_dir):
    """Bars written as ';'-separated files and read with a fixed schema."""
    bars, path = fx.bars(spark, sf_dir), _folder(spark, "csv")
    scans.csv_semicolon_sink(bars, path)
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in _OHLCV else f.dataType) for f in bars.schema])
    return rounded(scans.csv_semicolon_scan(spark, path, schema))


@query("macro_scan", Q("""SELECT CASE WHEN index_name = 'MARKET' THEN '^GSPC' ELSE index_name END AS series, ts, close AS value,
  CASE WHEN index_name = 'MARKET' THEN 'S&P 500' ELSE index_name END AS name FROM index_series""", "index_series", doubles=("value",)))
def q_macro_scan(spark, sf_dir):
    """Named index series; the market index stands in for a known ticker."""
    s = fx.index_series(spark, sf_dir)
    ticker = F.when(F.col("index_name") == "MARKET", "^GSPC").otherwise(F.col("index_name"))
    return rounded(scans.macro_scan(s.select(ticker.alias("series"), "ts", F.col("close").alias("value"))))


_ENTRIES = """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(SUM(l_quantity) AS DOUBLE) AS total_reward, AVG(l_extendedprice) AS avg_reward,
  COUNT(*) AS training_samples, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS timestamp FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)"""


def _entries(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    month = F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), month.alias("timestamp"))
            .agg(F.sum("l_quantity").cast("double").alias("total_reward"), F.avg("l_extendedprice").alias("avg_reward"),
                 F.count(F.lit(1)).alias("training_samples")))


@query("history_cap", R(f"""SELECT symbol, timestamp, total_reward, avg_reward, training_samples
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS r FROM ({_ENTRIES})) WHERE r <= 20""", "total_reward", "avg_reward"))
def q_history_cap(spark, sf_dir):
    """The newest 20 history entries per symbol."""
    return rounded(ind.history_cap(_entries(spark, sf_dir), 20))


@query("history_json", R(f"""SELECT symbol, timestamp, total_reward, avg_reward, training_samples
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS r FROM ({_ENTRIES})) WHERE r <= 100""", "total_reward", "avg_reward"))
def q_history_json(spark, sf_dir):
    """Capped performance histories (W44) written as JSON and read back."""
    path = _folder(spark, "history")
    weights = F.create_map(F.lit("price"), F.col("avg_reward"))
    scans.history_json_sink(ind.history_cap(_entries(spark, sf_dir)).withColumn("model_weights", weights), path)
    return rounded(scans.history_json_scan(spark, path).drop("model_weights"))


@query("records_sink", Q("SELECT symbol, CAST(ts AS VARCHAR) AS ts, close FROM bars", "bars", doubles=("close",)))
def q_records_sink(spark, sf_dir):
    """Bars written as JSON records and read back."""
    path = _folder(spark, "records")
    scans.records_sink(fx.bars(spark, sf_dir).select("symbol", F.col("ts").cast("string").alias("ts"), "close"), path)
    return rounded(spark.read.schema("symbol long, ts string, close double").json(path))


@query("model_store", R("""SELECT regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS slope,
  regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS intercept FROM lineitem""", "slope", "intercept", digits=2))
def q_model_store(spark, sf_dir):
    """A fitted pipeline saved, loaded and asked for two predictions,
    from which its line is read."""
    from pyspark.ml.regression import LinearRegression

    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    path = _folder(spark, "model")
    scans.model_sink(ml._pipe(["q"], LinearRegression(labelCol="price", solver="normal"), scaler=None).fit(li), path)
    two = spark.range(2).select(F.col("id").cast("double").alias("q"))
    got = scans.model_scan(path).transform(two)
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("prediction")))
    return rounded(got.agg((at(1) - at(0)).alias("slope"), at(0).alias("intercept")), 2)


@query("model_score_store", R("""SELECT SUM(l_quantity) * 1.0 AS current_score, 1e6 AS max_score, SUM(l_quantity) / 1e4 AS progress_percentage,
  CAST(CAST(MAX(l_shipdate) AS DATE) AS VARCHAR) AS timestamp, regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)) AS intercept FROM lineitem""",
  "current_score", "max_score", "progress_percentage", "intercept", digits=2))
def q_model_score_store(spark, sf_dir):
    """The score of a run stored beside its model (the total quantity stands
    in for the score) and read back with the model's prediction at 0."""
    from pyspark.ml.regression import LinearRegression

    t = fx.table(spark, sf_dir, "lineitem")
    li = t.select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    path = _folder(spark, "model-score")
    model = ml._pipe(["q"], LinearRegression(labelCol="price", solver="normal"), scaler=None).fit(li)
    scans.model_sink(model, path, score=t.agg(F.sum("l_quantity").alias("current_score"), F.max(F.to_date("l_shipdate")).alias("timestamp")))
    zero = scans.model_scan(path).transform(spark.range(1).select(F.col("id").cast("double").alias("q")))
    return rounded(scans.score_scan(spark, path).join(zero.select(F.col("prediction").alias("intercept"))), 2)


@query("select_available", Q("SELECT symbol, ts, close, volume FROM bars", "bars", doubles=("close", "volume")))
def q_select_available(spark, sf_dir):
    """The wanted columns that exist."""
    return rounded(clean.select_available(fx.bars(spark, sf_dir), ["close", "no_such_feature", "volume"], keep=("symbol", "ts")))


@query("fill_default", Q("""SELECT symbol, ts, COALESCE(close / LAG(close, 7) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0.0) AS momentum_7 FROM bars""",
                         "bars", doubles=("momentum_7",)))
def q_fill_default(spark, sf_dir):
    """P5: missing warm-up values filled with their default."""
    p = ind.momentum(fx.bars(spark, sf_dir), 7).select("symbol", "ts", "momentum_7")
    return rounded(clean.fill_default(p, {"momentum_7": 0.0}))


@query("normalize_symbol", R("""SELECT o_orderkey, upper(trim(x)) AS symbol FROM (SELECT o_orderkey,
  UNNEST(string_split(' ' || o_orderpriority || ', ' || lower(o_orderstatus) || ',, ', ',')) AS x FROM orders) WHERE trim(x) <> ''"""))
def q_normalize_symbol(spark, sf_dir):
    """Comma lists to one trimmed, upper-cased name per row."""
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit(", "), F.lower("o_orderstatus"), F.lit(",, "))
    return clean.normalize_symbol(fx.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("symbols"))).select("o_orderkey", "symbol")


@query("scale_units", Q("SELECT symbol, market_cap / 1e9 AS market_cap_bn FROM fundamentals", "fundamentals", doubles=("market_cap_bn",)))
def q_scale_units(spark, sf_dir):
    """Market value in billions."""
    return rounded(clean.scale_units(fx.fundamentals(spark, sf_dir), ["market_cap"]).select("symbol", "market_cap_bn"))


@query("require_history", Q("SELECT symbol, COUNT(*) AS n, COUNT(*) >= 530 AS kept FROM bars GROUP BY symbol", "bars"))
def q_require_history(spark, sf_dir):
    """Symbols with at least 530 bars, and the others with their count."""
    kept, rejected = clean.require_history(fx.bars(spark, sf_dir), 530)
    return (kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True))
            .unionByName(rejected.select("symbol", F.col("rows").alias("n"), F.lit(False).alias("kept"))))


@query("select_report", Q("SELECT symbol, COUNT(*) AS bars, AVG(close) AS mean FROM bars GROUP BY symbol", "bars", doubles=("mean",)))
def q_select_report(spark, sf_dir):
    """P10: one branch of a nested report."""
    g = fx.bars(spark, sf_dir).groupBy("symbol").agg(F.struct(F.count(F.lit(1)).alias("bars"), F.avg("close").alias("mean")).alias("price"),
                                                     F.struct(F.sum("volume").alias("total")).alias("trade"))
    return rounded(clean.select_report(g, "price"))


@query("align_inner", Q("SELECT b.symbol, b.ts, b.close, m.close AS close_idx FROM bars b JOIN market_index m USING (ts)", "bars", "market_index",
                        doubles=("close", "close_idx")))
def q_align_inner(spark, sf_dir):
    """Bars with the index of the same date."""
    bars = fx.bars(spark, sf_dir)
    return rounded(align.align_inner(bars, fx.market_index(spark, sf_dir, bars)).select("symbol", "ts", "close", "close_idx"))


@query("attach_sentiment", Q("""SELECT b.symbol, b.ts, COALESCE(n.s, 50.0) AS sentiment_score, COALESCE(n.c, 0) AS news_count FROM bars b
LEFT JOIN (SELECT CAST(symbol AS BIGINT) AS symbol, AVG(length(title)) AS s, CAST(COUNT(*) AS INTEGER) AS c FROM news GROUP BY 1) n ON n.symbol = b.symbol""",
                             "bars", "news", doubles=("sentiment_score",)))
def q_attach_sentiment(spark, sf_dir):
    """Per-symbol news scores on every bar, 50 and 0 where there is no
    news (title lengths stand in for scores)."""
    news = (fx.news(spark, sf_dir).groupBy(F.col("symbol").cast("long").alias("symbol"))
            .agg(F.avg(F.length("title")).alias("sentiment_score"), F.count(F.lit(1)).cast("int").alias("news_count")))
    return rounded(align.attach_sentiment(fx.bars(spark, sf_dir), news).select("symbol", "ts", "sentiment_score", "news_count"))


@query("trend_adjusted_strength", Q("""WITH r AS (SELECT *, close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret,
  ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars)
SELECT symbol, GREATEST(0.0, LEAST(100.0, MAX(symbol % 10) * 10.0 - LEAST(20.0, STDDEV_SAMP(ret) FILTER (back <= 20) * 1000))) AS trend_strength
FROM r GROUP BY symbol""", "bars", doubles=("trend_strength",)))
def q_trend_adjusted_strength(spark, sf_dir):
    """Confidence less the recent return deviation (confidences stand in)."""
    bars = fx.bars(spark, sf_dir)
    probs = bars.select("symbol").distinct().withColumn("confidence", (F.col("symbol") % 10) / 10.0)
    return rounded(st.trend_adjusted_strength(probs, bars))


@query("regression_metrics", Q("""SELECT symbol, AVG((close - open) ** 2) AS mse, AVG(ABS(close - open)) AS mae,
  1 - SUM((close - open) ** 2) / (VAR_POP(close) * COUNT(*)) AS r2 FROM bars GROUP BY symbol""", "bars", doubles=("mse", "mae", "r2")))
def q_regression_metrics(spark, sf_dir):
    """Errors of the open as a prediction of the close, per symbol."""
    pred = fx.bars(spark, sf_dir).select("symbol", F.col("close").alias("label"), F.col("open").alias("prediction"))
    return rounded(st.regression_metrics(pred, by="symbol"))


@query("first_n", Q("SELECT symbol, ts, close FROM bars ORDER BY close DESC, symbol, ts LIMIT 25", "bars", doubles=("close",)))
def q_first_n(spark, sf_dir):
    """T4: the 25 highest closes."""
    order = [F.col("close").desc(), F.col("symbol"), F.col("ts")]
    return rounded(ranking.first_n(fx.bars(spark, sf_dir).select("symbol", "ts", "close"), 25, order=order))


@query("union_samples", Q("""SELECT symbol, close, NULL::DOUBLE AS volume FROM bars WHERE symbol % 2 = 0
UNION ALL SELECT symbol, close, volume FROM bars WHERE symbol % 2 = 1""", "bars", doubles=("close", "volume")))
def q_union_samples(spark, sf_dir):
    """Samples with different columns appended by name."""
    b = fx.bars(spark, sf_dir)
    return rounded(align.union_samples(b.filter("symbol % 2 = 0").select("symbol", "close"), b.filter("symbol % 2 = 1").select("volume", "close", "symbol"))
                   .select("symbol", "close", "volume"))


@query("distinct_levels", Q("SELECT DISTINCT to_grade FROM ratings", "ratings"))
def q_distinct_levels(spark, sf_dir):
    """U4: the distinct rating grades."""
    return align.distinct_levels(fx.ratings(spark, sf_dir), "to_grade")


_LEVEL = "CASE WHEN {x} > {0} THEN 'very_high' WHEN {x} > {1} THEN 'high' WHEN {x} > {2} THEN 'medium' WHEN {x} > {3} THEN 'low' ELSE 'very_low' END"
_MOOD = "CASE WHEN s {0} 70 THEN 'very_positive' WHEN s {0} 60 THEN 'positive' WHEN s {1} 40 THEN 'neutral' WHEN s {1} 30 THEN 'negative' ELSE 'very_negative' END"


@query("label_forms", R(f"""SELECT l_orderkey, l_linenumber, {_LEVEL.format(70, 50, 30, 15, x='s')} AS risk, {_LEVEL.format(0.4, 0.3, 0.2, 0.1, x='p')} AS vol,
  CASE WHEN p > 0.7 THEN 'strong_uptrend' WHEN p > 0.6 THEN 'uptrend' WHEN p < 0.3 THEN 'strong_downtrend' WHEN p < 0.4 THEN 'downtrend' ELSE 'sideways' END AS trend,
  CASE WHEN p > 0.6 THEN p WHEN p < 0.4 THEN 1 - p ELSE 0.5 END AS strength, CASE WHEN p > 0.6 THEN 'bullish' WHEN p < 0.4 THEN 'bearish' ELSE 'neutral' END AS direction,
  GREATEST(0.1, LEAST(0.95, ABS(p - 0.5) * 2 + 0.5)) AS confidence,
  CASE WHEN x >= 1e9 THEN printf('%.1fB', x / 1e9) WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE printf('%.2f', x) END AS human,
  CASE WHEN s > 80 THEN 'A+' WHEN s > 70 THEN 'A' WHEN s > 60 THEN 'B+' WHEN s > 50 THEN 'B' WHEN s > 40 THEN 'C+' WHEN s > 30 THEN 'C' WHEN s > 20 THEN 'D' ELSE 'F' END AS grade,
  {_MOOD.format('>=', '>=')} AS mood, TRY_CAST(d AS DATE) AS day
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * 2 AS s, CAST(l_quantity AS DOUBLE) / 50 AS p,
        CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 16.0 WHEN 2 THEN 16384.0 ELSE -16.0 END * CAST(l_partkey AS DOUBLE) / 7 AS x,
        CASE WHEN l_linenumber % 3 = 0 THEN 'no date' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)""", "strength", "confidence"))
def q_label_forms(spark, sf_dir):
    """Label, confidence and text forms over every line."""
    li = fx.table(spark, sf_dir, "lineitem")
    s, p = F.col("l_quantity").cast("double") * 2, F.col("l_quantity").cast("double") / 50
    n = F.col("l_linenumber") % 4
    x = F.when(n == 0, 1.0).when(n == 1, 16.0).when(n == 2, 16384.0).otherwise(-16.0) * F.col("l_partkey").cast("double") / 7
    d = F.when(F.col("l_linenumber") % 3 == 0, F.lit("no date")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return rounded(li.select("l_orderkey", "l_linenumber", sg.risk_level(s).alias("risk"), sg.vol_risk(p).alias("vol"), sg.trend_bucket(p).alias("trend"),
                             sg.trend_bucket_strength(p).alias("strength"), sg.prob_direction(p).alias("direction"),
                             sg.confidence(p, 2.0, 0.5).alias("confidence"), sg.human_number(x).alias("human"), sg.letter_grade(s).alias("grade"),
                             sg.sentiment_label(s).alias("mood"), sg.parse_date(d).alias("day")))


@query("scaled_features", Q("""SELECT symbol, ts, (close - MIN(close) OVER ()) / (MAX(close) OVER () - MIN(close) OVER ()) AS close_minmax,
  (close - AVG(close) OVER ()) / STDDEV_SAMP(close) OVER () AS close_standard FROM bars""", "bars", doubles=("close_minmax", "close_standard")))
def q_scaled_features(spark, sf_dir):
    """M3: the close under both scalers."""
    from pyspark.ml.functions import vector_to_array

    out = fx.bars(spark, sf_dir).select("symbol", "ts", "close")
    for kind in ("minmax", "standard"):
        pipe = ml._pipe(["close"], ml.Identity(), scaler=kind)
        out = pipe.fit(out).transform(out).withColumn(f"close_{kind}", vector_to_array("features")[0]).drop("_raw", "features")
    return rounded(out.drop("close"))
