"""Registered queries: scans (S3-S5, S14), cleaning (P2-P6), ranking (T1,
T3, T5), overviews (A23, A24), learners (M1, M4-M14, M18, G3) and streaming
(ST1-ST4).  Learners have no SQL oracle (rows-only checks)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators import clean, ranking
from tickframe.operators import scores as scr
from tickframe.operators import stats as st
from tickframe.plans import models as ml
from tickframe.plans.catalog import query
from tickframe.plans.q_indicators import _G, _L, _MACDR_CTES, BASE
from tickframe.plans.q_stats import _TREND, _overall_sql
from tickframe.plans.q_text import HEADLINE, NEG, POS, s_polarity
from tickframe.plans.sqlkit import Q, R, ewm_cte, rounded
from tickframe.session import staged
from tickframe.sources import fixtures as fx
from tickframe.sources import scans
from tickframe.streaming import jobs

_OHLCV = ("open", "high", "low", "close", "volume")


@query("bars_resample", Q("""SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS ts,
  arg_min(open, ts) AS open, MAX(high) AS high, MIN(low) AS low, arg_max(close, ts) AS close, SUM(volume) AS volume
FROM bars GROUP BY symbol, CAST(date_trunc('week', ts) AS DATE)""", "bars", doubles=_OHLCV))
def q_bars_resample(spark, sf_dir):
    """Weekly OHLCV bars (Monday-start weeks)."""
    return rounded(scans.bars_resample(fx.bars(spark, sf_dir), "1wk"))


@query("bars_envelope", Q("""SELECT symbol, COUNT(*) AS records, MIN(ts) AS start_date, MAX(ts) AS end_date
FROM bars GROUP BY symbol""", "bars"))
def q_bars_envelope(spark, sf_dir):
    """Record count and date range per symbol."""
    return scans.bars_envelope(fx.bars(spark, sf_dir))


@query("bars_lookback", Q("""SELECT b.symbol, b.ts, b.close FROM bars b
JOIN (SELECT symbol, MAX(ts) AS last FROM bars GROUP BY symbol) l USING (symbol)
WHERE b.ts > CAST(l.last - INTERVAL 12 MONTH AS DATE)""", "bars", doubles=("close",)))
def q_bars_lookback(spark, sf_dir):
    """S3: the last year of bars per symbol, measured from its last bar."""
    return rounded(scans.bars_lookback(fx.bars(spark, sf_dir), "1y").select("symbol", "ts", "close"))


_PERIODS = {"1d": "CAST(l.last AS DATE) - 1", "5d": "CAST(l.last AS DATE) - 5", "ytd": "CAST(date_trunc('year', l.last) AS DATE) - 1",
            "max": "DATE '0001-01-01'"}
_PERIODS |= {p: f"CAST(l.last - INTERVAL {n} MONTH AS DATE)" for p, n in
             {"1mo": 1, "3mo": 3, "6mo": 6, "2y": 24, "5y": 60, "10y": 120}.items()}


@query("bars_lookback_periods", Q("""WITH l AS (SELECT symbol, MAX(ts) AS last FROM bars GROUP BY symbol)
""" + "\nUNION ALL ".join(f"""SELECT '{p}' AS period, b.symbol, COUNT(*) AS bars, CAST(MIN(b.ts) AS DATE) AS first_ts, SUM(b.close) AS total
FROM bars b JOIN l USING (symbol) WHERE b.ts > {e} GROUP BY b.symbol""" for p, e in _PERIODS.items()), "bars", doubles=("total",)))
def q_bars_lookback_periods(spark, sf_dir):
    """S3: every other look-back period: number, first date and total close of its bars per symbol."""
    bars = fx.bars(spark, sf_dir)
    parts = [scans.bars_lookback(bars, p).groupBy(F.lit(p).alias("period"), "symbol")
             .agg(F.count(F.lit(1)).alias("bars"), F.min("ts").cast("date").alias("first_ts"), F.sum("close").alias("total")) for p in _PERIODS]
    return rounded(reduce(DataFrame.unionByName, parts))


_MONTHLY = {"1mo": "month", "3mo": "quarter"}
_INTRADAY = {"5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "60m": "60 minutes", "90m": "90 minutes", "1h": "1 hour", "5d": "5 days"}


@query("bars_resample_intervals", Q("\nUNION ALL ".join(f"""SELECT '{i}' AS "interval", symbol, CAST(date_trunc('{unit}', ts) AS DATE) AS ts,
  arg_min(open, ts) AS open, MAX(high) AS high, MIN(low) AS low, arg_max(close, ts) AS close, SUM(volume) AS volume
FROM bars GROUP BY symbol, CAST(date_trunc('{unit}', ts) AS DATE)""" for i, unit in _MONTHLY.items()), "bars", doubles=_OHLCV))
def q_bars_resample_intervals(spark, sf_dir):
    """Monthly and quarterly OHLCV bars."""
    bars = fx.bars(spark, sf_dir)
    return rounded(reduce(DataFrame.unionByName, [scans.bars_resample(bars, i).select(F.lit(i).alias("interval"), "*") for i in _MONTHLY]))


@query("bars_resample_intraday", R("\nUNION ALL ".join(f"""SELECT '{i}' AS "interval", event_type AS symbol,
  strftime(time_bucket(INTERVAL '{length}', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(value, ts) AS open, MAX(value) AS high,
  MIN(value) AS low, arg_max(value, ts) AS close, COUNT(*) * 1.0 AS volume FROM ticks GROUP BY ALL""".replace("FROM ticks", """FROM (SELECT event_type, ts, MAX(value) AS value
  FROM events GROUP BY event_type, ts)""") for i, length in _INTRADAY.items()), *_OHLCV))
def q_bars_resample_intraday(spark, sf_dir):
    """5-minute to 5-day bars of the ticks (the highest of ticks at one time)."""
    ticks = fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), "ts").agg(F.max("value").alias("close"))
    bars = ticks.select("symbol", "ts", *[F.col("close").alias(c) for c in _OHLCV[:4]], F.lit(1.0).alias("volume"))
    got = reduce(DataFrame.unionByName, [scans.bars_resample(bars, i).select(F.lit(i).alias("interval"), "*") for i in _INTRADAY])
    return rounded(got.withColumn("ts", _time("ts")))


@query("bars_range", Q("""SELECT symbol, ts, close FROM bars WHERE ts >= DATE '1995-01-01' AND ts < DATE '1996-01-01'""",
                       "bars", doubles=("close",)))
def q_bars_range(spark, sf_dir):
    """An explicit date range (start inclusive, end exclusive)."""
    return rounded(scans.bars_range(fx.bars(spark, sf_dir), start="1995-01-01", end="1996-01-01")
                   .select("symbol", "ts", "close"))


@query("fundamentals_scan", Q("""SELECT s_suppkey AS symbol, 0.0 AS trailingPE, 0.0 AS forwardPE, 0.0 AS pegRatio,
  0.0 AS priceToBook, 0.0 AS grossMargins, s_acctbal / 20000.0 AS profitMargins, 0.0 AS revenueGrowth,
  0.0 AS debtToEquity, 0.0 AS currentRatio, 0.0 AS marketCap, 1.0 AS beta FROM supplier""",
    doubles=("trailingPE", "forwardPE", "pegRatio", "priceToBook", "grossMargins", "profitMargins", "revenueGrowth",
             "debtToEquity", "currentRatio", "marketCap", "beta")))
def q_fundamentals_scan(spark, sf_dir):
    """A sparse JSON company record per supplier (only profitMargins set)
    parsed into typed columns with defaults."""
    s = fx.table(spark, sf_dir, "supplier")
    info = s.select(F.col("s_suppkey").alias("symbol"),
                    F.to_json(F.create_map(F.lit("profitMargins"), F.col("s_acctbal") / 20000.0)).alias("info"))
    return rounded(scans.fundamentals_scan(info))


@query("dataset_summary", Q("""SELECT 'bars' AS dataset, COUNT(DISTINCT symbol) AS entities FROM bars
UNION ALL SELECT 'news', COUNT(DISTINCT symbol) FROM news
UNION ALL SELECT 'ratings', COUNT(DISTINCT symbol) FROM ratings
UNION ALL SELECT 'sectors', COUNT(DISTINCT sector) FROM sector_members""", "bars", "news", "ratings", "sector_members"))
def q_dataset_summary(spark, sf_dir):
    """Distinct entities per gathered dataset."""
    return scans.dataset_summary(bars=(fx.bars(spark, sf_dir), "symbol"), news=(fx.news(spark, sf_dir), "symbol"),
                                 ratings=(fx.ratings(spark, sf_dir), "symbol"),
                                 sectors=(fx.sector_members(spark, sf_dir), "sector"))


@query("select_numeric", Q("""SELECT symbol, ts, close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret
FROM bars""", "bars", doubles=("ret",)))
def q_select_numeric(spark, sf_dir):
    """Numeric columns minus OHLCV targets (here: the return)."""
    r = st.with_returns(fx.bars(spark, sf_dir)).drop("_rn", "_n")
    return rounded(clean.select_numeric(r, exclude=_OHLCV + ("symbol",), keep=("symbol", "ts")))


@query("drop_incomplete", Q("""SELECT symbol, ts, ret FROM (SELECT symbol, ts,
  close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) WHERE ret IS NOT NULL""",
                            "bars", doubles=("ret",)))
def q_drop_incomplete(spark, sf_dir):
    """Warm-up rows (null return) removed."""
    r = st.with_returns(fx.bars(spark, sf_dir)).select("symbol", "ts", "ret")
    return rounded(clean.drop_incomplete(r))


@query("default_missing", Q("""SELECT symbol, COALESCE(trailing_pe, 0.0) AS trailing_pe, COALESCE(beta, 1.0) AS beta
FROM fundamentals""", "fundamentals", doubles=("trailing_pe", "beta")))
def q_default_missing(spark, sf_dir):
    """Missing fundamentals -> 0 (beta -> 1)."""
    f = fx.fundamentals(spark, sf_dir).select("symbol", "trailing_pe", "beta")
    return rounded(clean.default_missing(f, columns=["trailing_pe", "beta"]))


@query("replace_inf", Q("""SELECT symbol, ts, CASE WHEN day(ts) <= 4 THEN 0.0 ELSE close / volume END
  AS price_per_unit FROM bars""", "bars", doubles=("price_per_unit",)))
def q_replace_inf(spark, sf_dir):
    """Non-finite ratios (and nulls) -> 0.  The first days of each month
    stand in as bars without volume: their ratio is inf, -inf, NaN or null."""
    day = F.dayofmonth("ts")
    odd = (F.when(day == 1, F.lit(float("inf"))).when(day == 2, F.lit(float("-inf")))
           .when(day == 3, F.lit(float("nan"))).when(day > 4, F.try_divide("close", "volume")))
    b = fx.bars(spark, sf_dir).select("symbol", "ts", odd.alias("price_per_unit"))
    return rounded(clean.replace_inf(clean.fill_default(b, {"price_per_unit": 0.0})))


_SNAP = """sn AS (SELECT symbol, close AS price, (close - prev) / prev * 100 AS change_percent
  FROM (SELECT *, LAG(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev,
               ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) WHERE r = 1)"""


@query("trending", Q(f"WITH {_SNAP}\nSELECT * FROM sn", "bars", doubles=("price", "change_percent")))
def q_trending(spark, sf_dir):
    """All snapshots ordered by |% change| (order is not compared)."""
    s = st.market_snapshot(fx.bars(spark, sf_dir)).select("symbol", "price", "change_percent")
    return rounded(ranking.trending(s))


@query("movers_top_n", Q(f"WITH {_SNAP}\nSELECT * FROM sn ORDER BY ABS(change_percent) DESC NULLS LAST, symbol LIMIT 5",
                         "bars", doubles=("price", "change_percent")))
def q_movers_top_n(spark, sf_dir):
    """T5: the 5 biggest movers."""
    s = st.market_snapshot(fx.bars(spark, sf_dir)).select("symbol", "price", "change_percent")
    return rounded(ranking.movers_top_n(s, 5))


@query("sector_top3", Q("""WITH per AS (SELECT symbol, SUM(ret) AS performance FROM (SELECT symbol,
  close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) GROUP BY symbol),
j AS (SELECT per.*, s.sector FROM per JOIN sector_members s USING (symbol)),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY sector ORDER BY performance DESC, symbol) AS INTEGER) AS rank FROM j)
SELECT symbol, performance, sector, rank, performance * 100 AS performance_pct FROM r WHERE rank <= 3""",
                        "bars", "sector_members", doubles=("performance", "performance_pct")))
def q_sector_top3(spark, sf_dir):
    """The three best performers per sector."""
    r = st.with_returns(fx.bars(spark, sf_dir))
    per = r.groupBy("symbol").agg(F.sum("ret").alias("performance"))
    j = per.join(fx.sector_members(spark, sf_dir).select("symbol", "sector"), "symbol")
    return rounded(ranking.sector_top3(j))


def _overall(spark, sf_dir):
    from tickframe.plans.q_stats import comprehensive
    from tickframe.functions import signals as sg
    bars = staged(fx.bars(spark, sf_dir), "bars")
    o = comprehensive(spark, sf_dir, bars)
    tr = st.trend_regression(bars).select("symbol", "trend")
    return o.join(tr, "symbol").withColumn("risk_level", sg.risk_level("risk_score"))


_ADVICE = """CASE WHEN AVG(overall_score) > 70 THEN 'increase exposure' WHEN AVG(overall_score) > 50 THEN 'maintain exposure'
  ELSE 'reduce exposure' END"""
_SCORES = ("bars", "market_index", "fundamentals", "news", "ratings")


@query("market_overview", Q(f"""WITH o AS ({_overall_sql()}), t AS (WITH {BASE}, {_TREND} SELECT * FROM trend),
j AS (SELECT o.*, t.trend, CASE WHEN risk_score > 70 THEN 'very_high' WHEN risk_score > 50 THEN 'high' WHEN risk_score > 30 THEN 'medium'
        WHEN risk_score > 15 THEN 'low' ELSE 'very_low' END AS risk_level FROM o JOIN t USING (symbol)),
lv AS (SELECT risk_level FROM j GROUP BY risk_level ORDER BY COUNT(*) DESC, risk_level LIMIT 1)
SELECT AVG(overall_score) AS average_score, COUNT(*) AS symbols, CASE WHEN AVG(CASE WHEN contains(trend, 'up') THEN 1.0 ELSE 0.0 END) > 0.5
  THEN 'bullish' ELSE 'bearish' END AS market_sentiment, (SELECT risk_level FROM lv) AS dominant_risk, {_ADVICE} AS advice FROM j""",
    *_SCORES, doubles=("average_score",)))
def q_market_overview(spark, sf_dir):
    """Market-wide mean score, up-trend share, dominant risk level, advice."""
    return rounded(scr.market_overview(_overall(spark, sf_dir)))


@query("screen_summary", Q(f"""WITH o AS ({_overall_sql()})
SELECT AVG(overall_score) AS average_score, COUNT(*) FILTER (contains(recommendation, 'Buy')) AS buy_recommendations, COUNT(*) AS analysed FROM o""",
    *_SCORES, doubles=("average_score",)))
def q_screen_summary(spark, sf_dir):
    """Mean overall score and number of Buy-type recommendations."""
    return rounded(scr.screen_summary(_overall(spark, sf_dir)))


def _company(spark, sf_dir):
    """The learners' company columns from the two company fixtures."""
    named = {"pe_ratio": "trailingPE", "forward_pe": "forwardPE", "peg_ratio": "pegRatio", "price_to_book": "priceToBook",
             "price_to_sales": "priceToSalesTrailing12Months", "gross_margin": "grossMargins", "operating_margin": "operatingMargins",
             "return_on_equity": "returnOnEquity", "return_on_assets": "returnOnAssets", "earnings_growth": "earningsGrowth",
             "dividend_yield": "dividendYield", "free_cashflow": "operatingCashflow", "total_cash": "totalCash",
             "total_debt": "totalDebt", "book_value": "bookValue"}
    info = fx.company_info(spark, sf_dir).select("symbol", *[F.col(c).alias(n) for n, c in named.items()])
    return fx.fundamentals(spark, sf_dir).drop("trailing_pe").join(info, "symbol")


_FT = """WITH b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, COUNT(*) OVER (PARTITION BY symbol) AS n,
  close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
x AS (SELECT symbol, ts, close, rn, n, AVG(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sma_20,
  AVG(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma_50, STDDEV_SAMP(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volatility,
  r AS price_change_1d, close / LAG(close, 7) OVER w - 1 AS price_change_7d, close / LAG(close, 30) OVER w - 1 AS price_change_30d,
  volume / AVG(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volume_ratio, volume / AVG(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volume_surge,
  (close - AVG(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) / STDDEV_SAMP(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS trend_strength,
  LEAD(close, 30) OVER w / close - 1 AS fwd_return_30, LEAD(close, 7) OVER w / close - 1 AS fwd_return_7,
  STDDEV_SAMP(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS fwd_price_std_30
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, sma_20, sma_50, volatility, price_change_1d, price_change_7d, price_change_30d, volume_ratio, volume_surge, trend_strength,
  market_cap / 1e9 AS market_cap, COALESCE("trailingPE", 0.0) AS pe_ratio, beta, fwd_return_30, fwd_return_7, fwd_price_std_30
FROM x JOIN fundamentals USING (symbol) JOIN company_info USING (symbol) WHERE rn >= 50 AND rn < n - 30"""
_FT_COLS = ("sma_20", "sma_50", "volatility", "price_change_1d", "price_change_7d", "price_change_30d", "volume_ratio", "volume_surge",
            "trend_strength", "market_cap", "pe_ratio", "beta", "fwd_return_30", "fwd_return_7", "fwd_price_std_30")


@query("feature_table", Q(_FT, "bars", "fundamentals", "company_info", doubles=_FT_COLS))
def q_feature_table(spark, sf_dir):
    """M1: pooled training samples over all symbols (the columns with a plain
    SQL form; RSI, MACD and sentiment have oracles of their own)."""
    return rounded(ml.feature_table(fx.bars(spark, sf_dir), _company(spark, sf_dir)).select("symbol", "ts", *_FT_COLS))


@query("model_scores")
def q_model_scores(spark, sf_dir):
    """Five learners fitted on the pooled samples, applied to
    each symbol's latest row, combined into the model score."""
    ft = ml.feature_table(fx.bars(spark, sf_dir), _company(spark, sf_dir), keep_latest=True).persist()
    models = ml.fit_models(ft.filter(~F.col("is_latest")))
    return ml.score_latest(models, ft.filter(F.col("is_latest")))


def _within(x: str, lo: float = 0.0, hi: float = 100.0) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN GREATEST({lo}, LEAST({hi}, {x})) END"


_GIVEN = f"""WITH {BASE},
lastly AS (SELECT symbol, MAX(ts) AS ts, MAX(close) FILTER (rn = n - 1) AS close, MAX(close) FILTER (rn = n - 31) AS c30, MAX(close) FILTER (rn = n - 8) AS c7,
  AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (rn >= n - 20) AS pred_trend, STDDEV_SAMP(close) FILTER (rn >= n - 20) AS pred_risk FROM br GROUP BY symbol),
p AS (SELECT symbol, ts, close, close / c30 - 1.0 AS pred_price, pred_trend, pred_risk, 50.0 + (close / c7 - 1.0) * 500.0 AS pred_sentiment,
  revenue_growth AS pred_fundamental FROM lastly JOIN fundamentals USING (symbol)),
s AS (SELECT *, 50.0 + pred_price * 1000.0 AS price_score, 100.0 * (CASE WHEN pred_trend > 0.6 THEN pred_trend WHEN pred_trend < 0.4 THEN 1.0 - pred_trend ELSE 0.5 END)
  AS trend_score, {_within("pred_risk / close * 100.0")} AS risk_score, {_within("pred_sentiment")} AS sentiment_score,
  {_within("(pred_fundamental + 0.2) * 250.0")} AS fundamental_score,
  (({_within("ABS(pred_price) * 10.0 + 0.5", 0.1, 0.95)}) + ({_within("ABS(pred_trend - 0.5) * 2.0 + 0.5", 0.1, 0.95)})
   + ({_within("ABS(pred_risk / close - 0.2) * 5.0 + 0.5", 0.1, 0.95)})) / 3.0 AS confidence FROM p),
m AS (SELECT *, {_within("price_score * 0.25 + trend_score * 0.2 + (100.0 - risk_score) * 0.2 + sentiment_score * 0.15 + fundamental_score * 0.2")} AS model_score FROM s)
SELECT *, CASE WHEN pred_price > 0.02 THEN 'bullish' WHEN pred_price < -0.02 THEN 'bearish' ELSE 'neutral' END AS price_direction,
  CASE WHEN pred_trend > 0.7 THEN 'strong_uptrend' WHEN pred_trend > 0.6 THEN 'uptrend' WHEN pred_trend < 0.3 THEN 'strong_downtrend'
       WHEN pred_trend < 0.4 THEN 'downtrend' ELSE 'sideways' END AS trend_direction,
  CASE WHEN risk_score > 70 THEN 'very_high' WHEN risk_score > 50 THEN 'high' WHEN risk_score > 30 THEN 'medium' WHEN risk_score > 15 THEN 'low' ELSE 'very_low' END AS risk_level,
  CASE WHEN sentiment_score > 70 THEN 'very_positive' WHEN sentiment_score > 60 THEN 'positive' WHEN sentiment_score > 40 THEN 'neutral'
       WHEN sentiment_score > 30 THEN 'negative' ELSE 'very_negative' END AS sentiment,
  CASE WHEN fundamental_score > 80 THEN 'A+' WHEN fundamental_score > 70 THEN 'A' WHEN fundamental_score > 60 THEN 'B+' WHEN fundamental_score > 50 THEN 'B'
       WHEN fundamental_score > 40 THEN 'C+' WHEN fundamental_score > 30 THEN 'C' WHEN fundamental_score > 20 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN model_score >= 85 THEN 'Strong Buy' WHEN model_score >= 70 THEN 'Buy' WHEN model_score >= 55 THEN 'Hold' WHEN model_score >= 40 THEN 'Sell'
       ELSE 'Strong Sell' END AS recommendation FROM m"""


@query("model_score", Q(_GIVEN, "bars", "fundamentals", doubles=(
    "close", "pred_price", "pred_trend", "pred_risk", "pred_sentiment", "pred_fundamental", "price_score", "trend_score", "risk_score",
    "sentiment_score", "fundamental_score", "confidence", "model_score")))
def q_model_score(spark, sf_dir):
    """Scores and labels of given predictions (persistence), per symbol."""
    given = ml.persistence_predictions(fx.bars(spark, sf_dir), fx.fundamentals(spark, sf_dir))
    return rounded(ml.score_predictions(given, relative_risk=True))


_PARTS = {"price": ("current_price", "predicted_price", "expected_return", "direction", "confidence"),
          "trend": ("direction", "strength", "probability", "confidence"),
          "risk": ("risk_level", "risk_score", "predicted_volatility", "confidence"),
          "sentiment": ("sentiment", "score", "confidence"), "fundamental": ("score", "grade", "expected_return", "confidence")}
_WORDS = ("direction", "risk_level", "sentiment", "grade")


@query("model_report", Q(f"""WITH g AS ({_GIVEN})
SELECT symbol, ts, close AS price_current_price, close + close * pred_price AS price_predicted_price, pred_price AS price_expected_return,
  price_direction, {_within("ABS(pred_price) * 10.0 + 0.5", 0.1, 0.95)} AS price_confidence, trend_direction, trend_score / 100.0 AS trend_strength,
  pred_trend AS trend_probability, {_within("ABS(pred_trend - 0.5) * 2.0 + 0.5", 0.1, 0.95)} AS trend_confidence, risk_level AS risk_risk_level,
  risk_score AS risk_risk_score, pred_risk / close AS risk_predicted_volatility, {_within("ABS(pred_risk / close - 0.2) * 5.0 + 0.5", 0.1, 0.95)} AS risk_confidence,
  sentiment AS sentiment_sentiment, sentiment_score, {_within("ABS(sentiment_score - 50.0) / 50.0 + 0.5", 0.1, 0.95)} AS sentiment_confidence,
  fundamental_score, grade AS fundamental_grade, pred_fundamental AS fundamental_expected_return,
  {_within("ABS(pred_fundamental) * 5.0 + 0.5", 0.1, 0.95)} AS fundamental_confidence, model_score, recommendation
FROM g""", "bars", "fundamentals",
    doubles=[f"{part}_{c}" for part, cols in _PARTS.items() for c in cols if c not in _WORDS] + ["model_score"]))
def q_model_report(spark, sf_dir):
    """The five structs of the per-symbol report (P10 opens them), persistence predictions."""
    given = ml.persistence_predictions(fx.bars(spark, sf_dir), fx.fundamentals(spark, sf_dir))
    report = ml.prediction_report(given, relative_risk=True)
    opened = [F.col(f"{part}.{c}").alias(f"{part}_{c}") for part, cols in _PARTS.items() for c in cols]
    return rounded(report.select("symbol", "ts", *opened, "model_score", "recommendation"))


def _linear_sql(days: int = 30, decay: float = 0.99) -> str:
    """Least squares by successive elimination: every feature is taken out of
    the later ones and of the close; row -1 carries the means along."""
    xs = [f"x{i}" for i in range(1, 7)]
    steps = []
    for j, x in enumerate(xs):
        slope = lambda v, x=x: f"SUM({x} * {v}) FILTER (fit) / SUM({x} * {x}) FILTER (fit)"
        later = xs[j + 1:]
        steps.append(f"s{j} AS (SELECT symbol, {slope('y')} AS b{''.join(f', {slope(v)} AS c_{v}' for v in later)} FROM z{j} GROUP BY symbol),\n"
                     f"z{j + 1} AS (SELECT symbol, rn, fit, y - b * {x} AS y, p + b * {x} AS p"
                     f"{''.join(f', {v} - c_{v} * {x} AS {v}' for v in later)} FROM z{j} JOIN s{j} USING (symbol))")
    mean = lambda k: f"AVG(close) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    nl = ",\n"
    return f"""WITH {BASE},
{_MACDR_CTES},
gl AS (SELECT symbol, rn, {_G} AS g, {_L} AS l FROM br),
{ewm_cte("eg", "gl", "g", 1 / 14, False, min_periods=14)},
{ewm_cte("el", "gl", "l", 1 / 14, False, min_periods=14)},
ft AS (SELECT br.symbol, br.rn, close AS y, {mean(20)} AS x1, {mean(50)} AS x2,
         CASE WHEN el.val = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + eg.val / el.val) END AS x3, m.macd_rec_diff AS x4, {mean(5)} AS x5, {mean(10)} AS x6
       FROM br JOIN eg ON br.symbol = eg.symbol AND br.rn = eg.rn JOIN el ON br.symbol = el.symbol AND br.rn = el.rn
       JOIN m ON br.symbol = m.symbol AND br.rn = m.rn WINDOW w AS (PARTITION BY br.symbol ORDER BY br.rn)),
fit AS (SELECT * FROM ft WHERE rn >= 49),
mu AS (SELECT symbol, MAX(rn) AS last, AVG(y) AS my, {", ".join(f"AVG({x}) AS m{x}" for x in xs)} FROM fit GROUP BY symbol),
z0 AS (SELECT symbol, rn, TRUE AS fit, y - my AS y, 0.0::DOUBLE AS p, {", ".join(f"{x} - m{x} AS {x}" for x in xs)} FROM fit JOIN mu USING (symbol)
       UNION ALL SELECT symbol, -1, FALSE, 0.0, 0.0, {", ".join(f"m{x}" for x in xs)} FROM mu),
{nl.join(steps)},
e AS (SELECT mu.symbol, my - a.p AS intercept, a.p + z.p AS wx FROM mu JOIN z6 a ON a.symbol = mu.symbol AND a.rn = -1
      JOIN z6 z ON z.symbol = mu.symbol AND z.rn = mu.last)
SELECT symbol, CAST(day AS INTEGER) AS day, intercept + POWER({decay}, day - 1) * wx AS predicted FROM e, range(1, {days + 1}) r(day)"""


@query("forecast_linear", Q(_linear_sql(), "bars", doubles=("predicted",)))
def q_forecast_linear(spark, sf_dir):
    """Per-symbol OLS forecast path (30 days, decay 0.99)."""
    return rounded(ml.forecast_linear(fx.bars(spark, sf_dir), 30))


@query("trend_probability")
def q_trend_probability(spark, sf_dir):
    """Pooled forest on next-bar direction, latest probability per symbol."""
    return ml.trend_probability(fx.bars(spark, sf_dir))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Forest importances of the price-model features."""
    from pyspark.ml.regression import RandomForestRegressor
    ft = ml.feature_table(fx.bars(spark, sf_dir), _company(spark, sf_dir))
    t = ft.filter(F.col("fwd_return_30").isNotNull())
    m = ml._pipe(ml.PRICE_FEATURES, RandomForestRegressor(labelCol="fwd_return_30", numTrees=100, seed=42)).fit(t)
    return ml.feature_importance(m, ml.PRICE_FEATURES, spark)


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_TICKS = "SELECT event_type AS symbol, ts, event_id, value AS price FROM events"


@query("stream_bars", R(f"""SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts,
  arg_min(price, (ts, event_id)) AS open, MAX(price) AS high, MIN(price) AS low, arg_max(price, (ts, event_id)) AS close,
  CAST(COUNT(*) AS DOUBLE) AS volume, COUNT(*) AS ticks FROM ({_TICKS}) GROUP BY symbol, date_trunc('hour', ts)""",
  "open", "high", "low", "close"))
def q_stream_bars(spark, sf_dir):
    """ST1: hourly OHLCV bars from the tick stream, equal to the batch bars."""
    got = jobs.replay_ticks(spark, sf_dir, jobs.stream_bars, "stream_bars")
    return rounded(jobs.latest(got, "symbol", "ts").withColumn("ts", _time("ts")))


@query("stream_sliding_mean", R(f"""SELECT symbol, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, AVG(price) AS mean_price, CAST(COUNT(*) AS DOUBLE) AS volume
FROM (SELECT symbol, price, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start
      FROM ({_TICKS}), (SELECT UNNEST([0, 1, 2, 3]) AS k)) GROUP BY symbol, start""", "mean_price"))
def q_stream_sliding_mean(spark, sf_dir):
    """ST2: 1-hour windows sliding by 15 minutes, equal to the batch windows."""
    got = jobs.replay_ticks(spark, sf_dir, jobs.stream_sliding_mean, "stream_sliding")
    got = jobs.latest(got, "symbol", "window_start", "window_end")
    return rounded(got.withColumn("window_start", _time("window_start")).withColumn("window_end", _time("window_end")))


@query("stream_snapshot", R(f"""SELECT symbol, strftime(MAX(ts) FILTER (r = 1), '%Y-%m-%d %H:%M:%S') AS last_ts,
  MAX(price) FILTER (r = 1) AS price, MAX(price) FILTER (r = 2) AS previous_price,
  (MAX(price) FILTER (r = 1) - MAX(price) FILTER (r = 2)) / NULLIF(MAX(price) FILTER (r = 2), 0) * 100 AS change_percent
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS r FROM ({_TICKS}))
WHERE r <= 2 GROUP BY symbol""", "price", "previous_price", "change_percent"))
def q_stream_snapshot(spark, sf_dir):
    """ST3: final per-symbol snapshot state (last price, % change)."""
    got = jobs.replay_ticks(spark, sf_dir, jobs.stream_snapshot, "stream_snapshot")
    return rounded(jobs.latest(got, "symbol").withColumn("last_ts", _time("last_ts")))


@query("stream_news_sentiment", Q(f"""SELECT symbol, strftime(time_bucket(INTERVAL 7 DAY, CAST(p_date AS TIMESTAMP), TIMESTAMP '1970-01-01'),
  '%Y-%m-%d %H:%M:%S') AS window_start, AVG(score) AS score, COUNT(*) AS articles
FROM (SELECT *, {s_polarity(HEADLINE)} AS score FROM news) GROUP BY symbol, window_start""", "news", doubles=("score",)))
def q_stream_news_sentiment(spark, sf_dir):
    """ST4: de-duplicated, scored news averaged per symbol and week."""
    once = jobs.stream_deduplicated(jobs.news_stream(spark, sf_dir))
    again = spark.readStream.schema(once.schema).parquet(jobs.drive(once, "stream_news", mode="append"))
    got = jobs.run_to_table(jobs.stream_news_sentiment(again, positive=POS, negative=NEG), "stream_scores")
    return rounded(jobs.latest(got, "symbol", "window_start").withColumn("window_start", _time("window_start")))
