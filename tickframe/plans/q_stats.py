"""Registered queries: risk and return aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import scores as sc
from tickframe.functions import signals as sg
from tickframe.operators import stats as st
from tickframe.operators import sentiment as se
from tickframe.plans import analysis
from tickframe.plans.catalog import query
from tickframe.plans.q_indicators import BASE, W, fr
from tickframe.plans.q_text import NEG, POS
from tickframe.plans.sqlkit import Q, rounded
from tickframe.session import staged
from tickframe.sources import fixtures as fx

S252 = "SQRT(252.0)"


@query("compare_symbols", Q(f"""WITH {BASE},
a AS (SELECT symbol, arg_max(close, rn) AS current_price, MAX(high) AS year_high, MIN(low) AS year_low,
             AVG(volume) AS avg_volume, STDDEV_SAMP(ret) * {S252} AS volatility, AVG(ret) * 252.0 AS mu
      FROM br GROUP BY symbol)
SELECT a.symbol, current_price, year_high, year_low, avg_volume, volatility,
       CASE WHEN volatility > 0 THEN mu / volatility ELSE 0.0 END AS sharpe_ratio,
       COALESCE(f.market_cap, 0.0) AS market_cap, COALESCE(f.trailing_pe, 0.0) AS pe_ratio,
       COALESCE(s.sector, 'Unknown') AS sector
FROM a LEFT JOIN fundamentals f ON f.symbol = a.symbol LEFT JOIN sector_members s ON s.symbol = a.symbol""",
    "bars", "fundamentals", "sector_members",
    doubles=("current_price", "year_high", "year_low", "avg_volume", "volatility", "sharpe_ratio", "market_cap",
             "pe_ratio")))
def q_compare_symbols(spark, sf_dir):
    """A1: per-symbol comparison table with fundamentals and sector."""
    return rounded(st.compare_symbols(fx.bars(spark, sf_dir), fx.fundamentals(spark, sf_dir),
                                      fx.sector_members(spark, sf_dir)))


@query("volatility_summary", Q(f"""WITH {BASE}
SELECT symbol, STDDEV_SAMP(ret) AS daily_volatility, STDDEV_SAMP(ret) * {S252} AS annualized_volatility
FROM br GROUP BY symbol""", "bars", doubles=("daily_volatility", "annualized_volatility")))
def q_volatility_summary(spark, sf_dir):
    """A2: daily and annualised return volatility."""
    return rounded(st.volatility_summary(fx.bars(spark, sf_dir)))


_DD = """dd AS (SELECT symbol, (close - MAX(close) OVER r) / MAX(close) OVER r AS drawdown FROM bars
  WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("max_drawdown", Q(f"WITH {_DD}\nSELECT symbol, ABS(MIN(drawdown)) AS max_drawdown FROM dd GROUP BY symbol",
                         "bars", doubles=("max_drawdown",)))
def q_max_drawdown(spark, sf_dir):
    """A3: absolute maximum drawdown of the close."""
    return rounded(st.max_drawdown(fx.bars(spark, sf_dir)))


@query("value_at_risk", Q(f"""WITH {BASE}
SELECT symbol, quantile_cont(ret, 0.05) AS var_95, quantile_cont(ret, 0.01) AS var_99 FROM br GROUP BY symbol""",
                          "bars", doubles=("var_95", "var_99")))
def q_value_at_risk(spark, sf_dir):
    """A4: 5th / 1st percentile of daily returns (linear interpolation)."""
    return rounded(st.value_at_risk(fx.bars(spark, sf_dir)))


_BETA = """al AS (SELECT b.symbol, b.ts, b.close, m.close AS m_close FROM bars b JOIN market_index m ON b.ts = m.ts),
ar AS (SELECT symbol, ts, close / LAG(close) OVER w - 1 AS r_s, m_close / LAG(m_close) OVER w - 1 AS r_m
       FROM al WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
bt AS (SELECT symbol, COUNT(ts) AS common_dates, COVAR_SAMP(r_s, r_m) AS c, VAR_POP(r_m) AS v, CORR(r_s, r_m) AS k
       FROM ar GROUP BY symbol),
beta AS (SELECT symbol, common_dates, CASE WHEN common_dates >= 30 AND v > 0 THEN c / v ELSE 1.0 END AS beta,
         CASE WHEN common_dates >= 30 THEN COALESCE(k, 0.0) ELSE 0.0 END AS correlation FROM bt)"""


@query("beta", Q(f"WITH {_BETA}\nSELECT * FROM beta", "bars", "market_index", doubles=("beta", "correlation")))
def q_beta(spark, sf_dir):
    """A5 (+J1, U1): beta and correlation to the market index on common dates."""
    bars = fx.bars(spark, sf_dir)
    return rounded(st.beta(bars, fx.market_index(spark, sf_dir, bars)))


@query("index_correlation", Q("""WITH al AS (SELECT b.symbol, i.index_name, b.ts, b.close, i.close AS m_close
                FROM bars b JOIN index_series i ON b.ts = i.ts),
ar AS (SELECT symbol, index_name, ts, close / LAG(close) OVER w - 1 AS r_s, m_close / LAG(m_close) OVER w - 1 AS r_m
       FROM al WINDOW w AS (PARTITION BY symbol, index_name ORDER BY ts)),
g AS (SELECT symbol, index_name, COUNT(ts) AS common_dates, CORR(r_s, r_m) AS k FROM ar GROUP BY symbol, index_name)
SELECT symbol, index_name, common_dates, CASE WHEN common_dates > 30 THEN COALESCE(k, 0.0) ELSE 0.0 END AS correlation
FROM g""", "bars", "index_series", doubles=("correlation",)))
def q_index_correlation(spark, sf_dir):
    """Correlation with the market and every sector index."""
    bars = fx.bars(spark, sf_dir)
    return rounded(st.index_correlation(bars, fx.index_series(spark, sf_dir, bars)))


_TREND = f"""tr AS (SELECT symbol, regr_slope(close, rn) AS slope, COUNT(close) AS n, arg_min(close, rn) AS fc
  FROM br GROUP BY symbol),
trend AS (SELECT symbol, CASE WHEN n >= 50 THEN slope END AS slope,
  CASE WHEN n < 50 THEN 'insufficient_data' WHEN slope / fc * 100 * n > 5 THEN 'strong_uptrend'
       WHEN slope / fc * 100 * n > 1 THEN 'uptrend' WHEN slope / fc * 100 * n < -5 THEN 'strong_downtrend'
       WHEN slope / fc * 100 * n < -1 THEN 'downtrend' ELSE 'sideways' END AS trend,
  CASE WHEN n >= 50 THEN ABS(slope / fc * 100 * n) ELSE 0.0 END AS trend_strength FROM tr)"""


@query("trend_regression", Q(f"WITH {BASE}, {_TREND}\nSELECT * FROM trend", "bars",
                             doubles=("slope", "trend_strength")))
def q_trend_regression(spark, sf_dir):
    """OLS trend of close on the row number, bucketed."""
    return rounded(st.trend_regression(fx.bars(spark, sf_dir)))


def _tail(k):
    return f"STDDEV_SAMP(CASE WHEN rn >= n - {k} THEN ret END)"


@query("vol_term_structure", Q(f"""WITH {BASE}
SELECT symbol, {_tail(21)} * {S252} AS vol_1m, {_tail(63)} * {S252} AS vol_3m, {_tail(126)} * {S252} AS vol_6m,
       STDDEV_SAMP(ret) * {S252} AS vol_1y FROM br GROUP BY symbol""", "bars",
                               doubles=("vol_1m", "vol_3m", "vol_6m", "vol_1y")))
def q_vol_term_structure(spark, sf_dir):
    """Annualised vol over the last 21 / 63 / 126 / all returns."""
    return rounded(st.vol_term_structure(fx.bars(spark, sf_dir)))


@query("vol_percentiles", Q(f"""WITH {BASE},
rv AS (SELECT symbol, ret, {fr('STDDEV_SAMP', 'ret', 252)} * {S252} AS v FROM br {W})
SELECT symbol, STDDEV_SAMP(ret) * {S252} AS current, quantile_cont(v, 0.25) AS percentile_25,
       quantile_cont(v, 0.5) AS percentile_50, quantile_cont(v, 0.75) AS percentile_75,
       quantile_cont(v, 0.9) AS percentile_90 FROM rv GROUP BY symbol""", "bars",
                            doubles=("current", "percentile_25", "percentile_50", "percentile_75", "percentile_90")))
def q_vol_percentiles(spark, sf_dir):
    """A10: percentiles of the rolling 252-row annualised volatility."""
    return rounded(st.vol_percentiles(fx.bars(spark, sf_dir)))


@query("vol_forecast_simple", Q(f"""WITH {BASE},
g AS (SELECT symbol, STDDEV_SAMP(ret) AS current_vol, {_tail(20)} - {_tail(40)} AS vol_trend FROM br GROUP BY symbol)
SELECT symbol, current_vol, vol_trend, current_vol * (1 + vol_trend * 0.1) AS predicted_vol,
       CASE WHEN vol_trend > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM g""", "bars",
                                doubles=("current_vol", "vol_trend", "predicted_vol")))
def q_vol_forecast_simple(spark, sf_dir):
    """Simple volatility forecast from the 20- vs 40-return std."""
    return rounded(st.vol_forecast_simple(fx.bars(spark, sf_dir)))


@query("sector_rollup", Q(f"""WITH {BASE},
per AS (SELECT symbol, SUM(ret) AS performance, STDDEV_SAMP(ret) AS volatility, AVG(volume) AS avg_volume
        FROM br GROUP BY symbol)
SELECT sector, AVG(performance) AS avg_performance, AVG(volatility) AS avg_volatility, AVG(avg_volume) AS avg_volume,
       STDDEV_POP(performance) AS performance_spread, COUNT(per.symbol) AS symbols
FROM per JOIN sector_members s ON s.symbol = per.symbol GROUP BY sector""", "bars", "sector_members",
                          doubles=("avg_performance", "avg_volatility", "avg_volume", "performance_spread")))
def q_sector_rollup(spark, sf_dir):
    """Per-sector mean performance, volatility, volume, spread, count."""
    return rounded(st.sector_rollup(fx.bars(spark, sf_dir), fx.sector_members(spark, sf_dir)))


@query("market_snapshot", Q(f"""WITH {BASE}, p AS (SELECT *, LAG(close) OVER {W[7:]} AS prev FROM br)
SELECT symbol, ts AS last_date, close AS price, close - prev AS change, (close - prev) / prev * 100 AS change_percent,
       volume FROM p WHERE rn = n - 1""".replace("OVER w AS ", "OVER "), "bars",
                            doubles=("price", "change", "change_percent", "volume")))
def q_market_snapshot(spark, sf_dir):
    """Last close, change and % change vs the previous bar."""
    return rounded(st.market_snapshot(fx.bars(spark, sf_dir)))


@query("market_summary", Q("""WITH s AS (SELECT index_name AS symbol, ts, close,
       ROW_NUMBER() OVER (PARTITION BY index_name ORDER BY ts) - 1 AS rn FROM index_series),
m AS (SELECT symbol, rn, close, close / LAG(close, 1) OVER w - 1 AS ret, close / LAG(close, 5) OVER w - 1 AS m5,
             close / LAG(close, 20) OVER w - 1 AS m20 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn))
SELECT symbol, arg_max(close, rn) AS last_value, arg_max(ret, rn) AS change_1, arg_max(m5, rn) AS change_5,
       arg_max(m20, rn) AS change_20, STDDEV_SAMP(ret) * SQRT(252.0) AS volatility FROM m GROUP BY symbol""",
                           "bars", "index_series",
                           doubles=("last_value", "change_1", "change_5", "change_20", "volatility")))
def q_market_summary(spark, sf_dir):
    """Last value, 1/5/20-row change and volatility per index series."""
    idx = fx.index_series(spark, sf_dir).withColumnRenamed("index_name", "symbol")
    return rounded(st.market_summary(idx))


@query("volume_profile", Q("""WITH g AS (SELECT symbol, arg_max(volume, ts) AS current_volume, AVG(volume) AS avg_volume
                FROM bars GROUP BY symbol),
r AS (SELECT *, CASE WHEN avg_volume > 0 THEN current_volume / avg_volume ELSE 1.0 END AS volume_ratio FROM g)
SELECT symbol, current_volume, avg_volume, volume_ratio,
  CASE WHEN volume_ratio > 2 THEN 'high_volume' WHEN volume_ratio < 0.5 THEN 'low_volume' ELSE 'normal_volume' END
    AS volume_signal,
  CASE WHEN volume_ratio > 2 THEN LEAST(100.0, (volume_ratio - 1) * 50)
       WHEN volume_ratio < 0.5 THEN LEAST(100.0, (1 - volume_ratio) * 100) ELSE 0.0 END AS volume_strength
FROM r""", "bars", doubles=("current_volume", "avg_volume", "volume_ratio", "volume_strength")))
def q_volume_profile(spark, sf_dir):
    """Last volume vs mean volume with a bucket and strength."""
    return rounded(st.volume_profile(fx.bars(spark, sf_dir)))


def _fund_score_sql(alias: str = "f") -> str:
    pe, m, g, d = (f"COALESCE({alias}.{c}, 0.0)" for c in ("trailing_pe", "profit_margin", "revenue_growth",
                                                            "debt_to_equity"))
    return (f"GREATEST(0.0, LEAST(100.0, 50.0 + CASE WHEN {pe} > 10 AND {pe} < 25 THEN 10 WHEN {pe} > 30 THEN -10 "
            f"ELSE 0 END + CASE WHEN {m} > 0.1 THEN 15 WHEN {m} < 0 THEN -20 ELSE 0 END "
            f"+ CASE WHEN {g} > 0.1 THEN 10 WHEN {g} < -0.1 THEN -10 ELSE 0 END "
            f"+ CASE WHEN {d} < 0.5 THEN 10 WHEN {d} > 1 THEN -10 ELSE 0 END))")


@query("fundamental_score", Q(f"SELECT symbol, {_fund_score_sql()} AS fundamental_score FROM fundamentals f",
                              "fundamentals", doubles=("fundamental_score",)))
def q_fundamental_score(spark, sf_dir):
    """Rule-based fundamental score (missing values count 0)."""
    f = fx.fundamentals(spark, sf_dir)
    return rounded(f.select("symbol", sc.fundamental_score("trailing_pe", "profit_margin", "revenue_growth",
                                                            "debt_to_equity").alias("fundamental_score")))


_RISK = f"""vs AS (SELECT symbol, STDDEV_SAMP(ret) * {S252} AS annualized_volatility FROM br GROUP BY symbol),
md AS (SELECT symbol, ABS(MIN(drawdown)) AS max_drawdown FROM dd GROUP BY symbol),
risk AS (SELECT vs.symbol, annualized_volatility, max_drawdown, beta.beta,
  GREATEST(0.0, LEAST(100.0, 50.0
    + CASE WHEN annualized_volatility > 0.3 THEN 20 WHEN annualized_volatility < 0.15 THEN -10 ELSE 0 END
    + CASE WHEN max_drawdown > 0.3 THEN 15 WHEN max_drawdown < 0.1 THEN -5 ELSE 0 END
    + CASE WHEN COALESCE(beta.beta, 1.0) > 1.5 THEN 15 WHEN COALESCE(beta.beta, 1.0) < 0.5 THEN -5 ELSE 0 END))
    AS risk_score
  FROM vs JOIN md USING (symbol) LEFT JOIN beta USING (symbol))"""


def _risk_frame(spark, sf_dir, bars=None):
    bars = fx.bars(spark, sf_dir) if bars is None else bars
    j = (st.volatility_summary(bars).select("symbol", "annualized_volatility")
         .join(st.max_drawdown(bars), "symbol")
         .join(st.beta(bars, fx.market_index(spark, sf_dir, bars)).select("symbol", "beta"), "symbol", "left"))
    return j.withColumn("risk_score", sc.risk_score("annualized_volatility", "max_drawdown", "beta"))


@query("risk_score", Q(f"WITH {BASE}, {_DD}, {_BETA}, {_RISK}\nSELECT * FROM risk", "bars", "market_index",
                       doubles=("annualized_volatility", "max_drawdown", "beta", "risk_score")))
def q_risk_score(spark, sf_dir):
    """Rule-based risk score from volatility, drawdown and beta."""
    return rounded(_risk_frame(spark, sf_dir))


def _prefixed_tech_sql() -> str:
    import re
    from tickframe.plans.q_analysis import _TECH_SQL
    names = "br|ind|gl|e12|e26|line|sig|eg|el|last|agg|t|s|snap"
    return re.sub(rf"\b({names})\b", r"k_\1", _TECH_SQL)


def _overall_sql() -> str:
    from tickframe.plans.q_text import _ANALYST, _NEWS_SENT, _SOCIAL
    return f"""WITH {BASE}, {_DD}, {_BETA}, {_RISK}, {_prefixed_tech_sql()}, {_NEWS_SENT}, {_ANALYST}, {_SOCIAL},
fs AS (SELECT symbol, {_fund_score_sql()} AS fundamental_score FROM fundamentals f),
sent AS (SELECT syms.symbol, ROUND(COALESCE(ns.score, 50) * 0.4
           + COALESCE(GREATEST(0.0, LEAST(100.0, 50 + so.price_change * 1000)), 50) * 0.3
           + COALESCE(an.score, 50) * 0.3, 2) AS sentiment_score
         FROM (SELECT DISTINCT symbol FROM bars) syms LEFT JOIN ns USING (symbol) LEFT JOIN so USING (symbol)
         LEFT JOIN an USING (symbol)),
j AS (SELECT k.symbol, k.technical_score, fs.fundamental_score, sent.sentiment_score, r.risk_score,
        ROUND(COALESCE(k.technical_score, 50) * 0.3 + COALESCE(fs.fundamental_score, 50) * 0.3
              + COALESCE(sent.sentiment_score, 50) * 0.2 + (100 - COALESCE(r.risk_score, 50)) * 0.2, 2) AS overall_score
      FROM k_snap k LEFT JOIN fs USING (symbol) LEFT JOIN sent USING (symbol) LEFT JOIN risk r USING (symbol))
SELECT *, CASE WHEN overall_score >= 80 THEN 'Strong Buy' WHEN overall_score >= 65 THEN 'Buy'
               WHEN overall_score >= 50 THEN 'Hold' WHEN overall_score >= 35 THEN 'Sell' ELSE 'Strong Sell' END
          AS recommendation FROM j"""


def comprehensive(spark, sf_dir, bars=None):
    """SURVEY 3.1 as one job: technical, fundamental, sentiment and risk
    scores per symbol, the weighted overall score and the recommendation.
    The bars are read a dozen times, so they are stored once (or given so)."""
    bars = staged(fx.bars(spark, sf_dir), "bars") if bars is None else bars
    tech = analysis.technical_snapshot(bars).select("symbol", "technical_score")
    f = fx.fundamentals(spark, sf_dir)
    fs = f.select("symbol", sc.fundamental_score("trailing_pe", "profit_margin", "revenue_growth",
                                                 "debt_to_equity").alias("fundamental_score"))
    sent = se.sentiment_blend(bars, se.news_sentiment(fx.news(spark, sf_dir), positive=POS, negative=NEG),
                              se.price_reaction_sentiment(bars), se.analyst_consensus(fx.ratings(spark, sf_dir)))
    sent = sent.select("symbol", F.col("overall_sentiment_score").alias("sentiment_score"))
    risk = _risk_frame(spark, sf_dir, bars).select("symbol", "risk_score")
    j = tech.join(fs, "symbol", "left").join(sent, "symbol", "left").join(risk, "symbol", "left")
    j = j.withColumn("overall_score", sc.overall_score("technical_score", "fundamental_score",
                                                       "sentiment_score", "risk_score"))
    return j.withColumn("recommendation", sg.recommendation("overall_score"))


@query("overall_score", Q(_overall_sql(), "bars", "market_index", "fundamentals", "news", "ratings",
                          doubles=("technical_score", "fundamental_score", "sentiment_score", "risk_score",
                                   "overall_score")))
def q_overall_score(spark, sf_dir):
    """A21 + X11: weighted overall score and recommendation per symbol."""
    return rounded(comprehensive(spark, sf_dir))
