"""Registered queries: technical analysis path."""

from __future__ import annotations

from tickframe.plans import analysis
from tickframe.plans.catalog import query
from tickframe.plans.sqlkit import Q, ewm_cte, rounded
from tickframe.sources import fixtures as fx

_TECH_DOUBLES = ("close", "change_1", "change_pct_1", "change_7", "change_pct_7", "change_30", "change_pct_30",
                 "sma_20", "sma_50", "macd_line", "macd_signal_line", "rsi", "bb_upper", "bb_middle", "bb_lower",
                 "support", "resistance", "slope", "trend_strength", "volume_ratio", "ma_strength",
                 "macd_strength", "rsi_strength", "bb_strength", "distance_to_support", "distance_to_resistance",
                 "technical_score")

_TECH_SQL = f"""
br AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
              COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars),
ind AS (
  SELECT symbol, ts, rn, n, close, volume,
    CASE WHEN COUNT(close) OVER w20 = 20 THEN AVG(close) OVER w20 END AS sma_20,
    CASE WHEN COUNT(close) OVER w50 = 50 THEN AVG(close) OVER w50 END AS sma_50,
    CASE WHEN COUNT(close) OVER w20 = 20 THEN STDDEV_POP(close) OVER w20 END AS sd_20,
    CASE WHEN COUNT(high) OVER w20 = 20 THEN MAX(high) OVER w20 END AS resistance,
    CASE WHEN COUNT(low) OVER w20 = 20 THEN MIN(low) OVER w20 END AS support,
    close - LAG(close, 1) OVER w AS delta,
    LAG(close, 1) OVER w AS c1, LAG(close, 7) OVER w AS c7, LAG(close, 30) OVER w AS c30
  FROM br
  WINDOW w AS (PARTITION BY symbol ORDER BY rn),
         w20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w50 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
gl AS (SELECT symbol, rn, CASE WHEN delta > 0 THEN delta ELSE 0.0 END AS g,
              CASE WHEN delta < 0 THEN -delta ELSE 0.0 END AS l FROM ind),
{ewm_cte("e12", "br", "close", 2 / 13, False, min_periods=12)},
{ewm_cte("e26", "br", "close", 2 / 27, False, min_periods=26)},
line AS (SELECT a.symbol, a.rn, a.val - b.val AS x FROM e12 a JOIN e26 b ON a.symbol = b.symbol AND a.rn = b.rn),
{ewm_cte("sig", "line", "x", 0.2, False, start=25, min_periods=9)},
{ewm_cte("eg", "gl", "g", 1 / 14, False, min_periods=14)},
{ewm_cte("el", "gl", "l", 1 / 14, False, min_periods=14)},
last AS (
  SELECT i.*, line.x AS macd_line, sig.val AS macd_signal_line,
         CASE WHEN el.val IS NULL THEN NULL WHEN el.val = 0 THEN 100.0
              ELSE 100.0 - 100.0 / (1.0 + eg.val / el.val) END AS rsi
  FROM ind i
  LEFT JOIN line ON line.symbol = i.symbol AND line.rn = i.rn
  LEFT JOIN sig ON sig.symbol = i.symbol AND sig.rn = i.rn
  LEFT JOIN eg ON eg.symbol = i.symbol AND eg.rn = i.rn
  LEFT JOIN el ON el.symbol = i.symbol AND el.rn = i.rn
  WHERE i.rn = i.n - 1),
agg AS (SELECT symbol, regr_slope(close, rn) AS slope, COUNT(close) AS cnt,
               arg_min(close, rn) AS first_close, AVG(volume) AS avg_volume FROM br GROUP BY symbol),
t AS (
  SELECT last.symbol, last.ts AS last_date, last.close,
    CASE WHEN n >= 2 THEN close - c1 ELSE 0.0 END AS change_1,
    CASE WHEN n >= 2 THEN (close - c1) / c1 * 100 ELSE 0.0 END AS change_pct_1,
    CASE WHEN n >= 8 THEN close - c7 ELSE 0.0 END AS change_7,
    CASE WHEN n >= 8 THEN (close - c7) / c7 * 100 ELSE 0.0 END AS change_pct_7,
    CASE WHEN n >= 31 THEN close - c30 ELSE 0.0 END AS change_30,
    CASE WHEN n >= 31 THEN (close - c30) / c30 * 100 ELSE 0.0 END AS change_pct_30,
    sma_20, sma_50, macd_line, macd_signal_line, rsi,
    sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower,
    support, resistance,
    CASE WHEN cnt >= 50 THEN slope END AS slope,
    CASE WHEN cnt < 50 THEN 'insufficient_data'
         WHEN slope / first_close * 100 * cnt > 5 THEN 'strong_uptrend'
         WHEN slope / first_close * 100 * cnt > 1 THEN 'uptrend'
         WHEN slope / first_close * 100 * cnt < -5 THEN 'strong_downtrend'
         WHEN slope / first_close * 100 * cnt < -1 THEN 'downtrend' ELSE 'sideways' END AS trend,
    CASE WHEN cnt >= 50 THEN ABS(slope / first_close * 100 * cnt) ELSE 0.0 END AS trend_strength,
    CASE WHEN avg_volume > 0 THEN volume / avg_volume ELSE 1.0 END AS volume_ratio
  FROM last JOIN agg ON agg.symbol = last.symbol),
s AS (
  SELECT *,
    CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 'bullish'
         WHEN close < sma_20 AND sma_20 < sma_50 THEN 'bearish' ELSE 'neutral' END AS ma_signal,
    CASE WHEN (close > sma_20 AND sma_20 > sma_50) OR (close < sma_20 AND sma_20 < sma_50)
         THEN LEAST(100.0, ABS(close - sma_50) / sma_50 * 1000) ELSE 0.0 END AS ma_strength,
    CASE WHEN macd_line > macd_signal_line THEN 'bullish' WHEN macd_line < macd_signal_line THEN 'bearish'
         ELSE 'neutral' END AS macd_signal,
    CASE WHEN macd_line > macd_signal_line OR macd_line < macd_signal_line
         THEN LEAST(100.0, ABS(macd_line - macd_signal_line) * 1000) ELSE 0.0 END AS macd_strength,
    CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal,
    CASE WHEN rsi > 70 THEN LEAST(100.0, (rsi - 70) * 3.33) WHEN rsi < 30 THEN LEAST(100.0, (30 - rsi) * 3.33)
         ELSE 0.0 END AS rsi_strength,
    CASE WHEN close > bb_upper THEN 'overbought' WHEN close < bb_lower THEN 'oversold' ELSE 'neutral' END AS bb_signal,
    CASE WHEN close > bb_upper THEN LEAST(100.0, (close - bb_upper) / bb_upper * 1000)
         WHEN close < bb_lower THEN LEAST(100.0, (bb_lower - close) / bb_lower * 1000) ELSE 0.0 END AS bb_strength,
    (close - support) / support * 100 AS distance_to_support,
    (resistance - close) / close * 100 AS distance_to_resistance,
    CASE WHEN volume_ratio > 2 THEN 'high_volume' WHEN volume_ratio < 0.5 THEN 'low_volume'
         ELSE 'normal_volume' END AS volume_signal
  FROM t),
snap AS (
  SELECT *, GREATEST(0.0, LEAST(100.0, 50.0
    + CASE ma_signal WHEN 'bullish' THEN 15 WHEN 'bearish' THEN -15 ELSE 0 END
    + CASE macd_signal WHEN 'bullish' THEN 10 WHEN 'bearish' THEN -10 ELSE 0 END
    + CASE rsi_signal WHEN 'oversold' THEN 10 WHEN 'overbought' THEN -10 ELSE 0 END
    + CASE WHEN trend LIKE '%uptrend%' THEN 10 WHEN trend LIKE '%downtrend%' THEN -10 ELSE 0 END)) AS technical_score
  FROM s)"""


@query("technical_snapshot", Q(f"WITH {_TECH_SQL}\nSELECT * FROM snap", "bars", doubles=_TECH_DOUBLES))
def q_technical_snapshot(spark, sf_dir):
    """Flagship: per-symbol technical analysis and score over all bars."""
    return rounded(analysis.technical_snapshot(fx.bars(spark, sf_dir)))


@query("rank_symbols", Q(f"""WITH {_TECH_SQL}
SELECT symbol, technical_score,
       CAST(ROW_NUMBER() OVER (ORDER BY COALESCE(technical_score, 0) DESC, symbol) AS INTEGER) AS rank
FROM snap ORDER BY COALESCE(technical_score, 0) DESC, symbol LIMIT 10""", "bars", doubles=("technical_score",)))
def q_rank_symbols(spark, sf_dir):
    """Top 10 symbols by technical score (ties by symbol)."""
    snap = analysis.technical_snapshot(fx.bars(spark, sf_dir)).select("symbol", "technical_score")
    return rounded(analysis.rank_symbols(snap, n=10))
