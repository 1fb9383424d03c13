"""Registered queries: signal votes, backtest, forecasts, volatility models,
as-of join, attachments and reward rules (X7, G2, M15, M17, J9, X20, X21,
G5, G6, J3, J4, J7, R1-R5, A25, A32, A33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import rewards as rw
from tickframe.functions import signals as sg
from tickframe.operators import align
from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.operators import stats as st
from tickframe.plans import forecast as fc
from tickframe.plans.catalog import query
from tickframe.plans.q_indicators import BASE, W, _MACD_CTES, fr, prior
from tickframe.plans.sqlkit import Q, ewm_cte, rounded
from tickframe.sources import fixtures as fx

_VOTE_SQL = f"""WITH {BASE}, {_MACD_CTES},
x AS (SELECT br.symbol, br.rn, br.n, {fr('AVG', 'close', 20)} AS sma_20, {fr('AVG', 'close', 50)} AS sma_50,
        {fr('STDDEV_SAMP', 'close', 20)} AS sd_20, close,
        {fr('MIN', 'low', 14)} AS lo14, {fr('MAX', 'high', 14)} AS hi14,
        {fr('AVG', 'CASE WHEN delta > 0 THEN delta ELSE 0.0 END', 14)} AS ag,
        {fr('AVG', 'CASE WHEN delta < 0 THEN -delta ELSE 0.0 END', 14)} AS al
      FROM br {W}),
y AS (SELECT x.*, 100 * ((close - lo14) / NULLIF(hi14 - lo14, 0)) AS stoch_k,
        (close - (sma_20 - 2 * sd_20)) / NULLIF((sma_20 + 2 * sd_20) - (sma_20 - 2 * sd_20), 0) AS bb_position,
        CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN al = 0 THEN (CASE WHEN ag > 0 THEN 100.0 END)
             ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi FROM x),
z AS (SELECT y.*, {fr('AVG', 'stoch_k', 3)} AS stoch_d FROM y {W}),
v AS (SELECT z.symbol, z.sma_20, z.sma_50, z.rsi, m.macd, m.macd_signal, z.bb_position, z.stoch_k, z.stoch_d,
        CASE WHEN sma_20 > sma_50 THEN 'bullish' WHEN sma_20 < sma_50 THEN 'bearish' ELSE 'neutral' END AS ma_signal,
        CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal,
        CASE WHEN m.macd > m.macd_signal THEN 'bullish' WHEN m.macd < m.macd_signal THEN 'bearish'
             ELSE 'neutral' END AS macd_signal_label,
        CASE WHEN bb_position > 0.8 THEN 'overbought' WHEN bb_position < 0.2 THEN 'oversold' ELSE 'neutral' END AS bb_signal,
        CASE WHEN stoch_k > 80 AND stoch_d > 80 THEN 'overbought' WHEN stoch_k < 20 AND stoch_d < 20 THEN 'oversold'
             ELSE 'neutral' END AS stoch_signal
      FROM z JOIN m ON m.symbol = z.symbol AND m.rn = z.rn WHERE z.rn = z.n - 1),
c AS (SELECT *, (CASE WHEN ma_signal IN ('bullish', 'oversold') THEN 1 ELSE 0 END
               + CASE WHEN rsi_signal IN ('bullish', 'oversold') THEN 1 ELSE 0 END
               + CASE WHEN macd_signal_label IN ('bullish', 'oversold') THEN 1 ELSE 0 END
               + CASE WHEN bb_signal IN ('bullish', 'oversold') THEN 1 ELSE 0 END
               + CASE WHEN stoch_signal IN ('bullish', 'oversold') THEN 1 ELSE 0 END) AS bullish,
              (CASE WHEN ma_signal IN ('bearish', 'overbought') THEN 1 ELSE 0 END
               + CASE WHEN rsi_signal IN ('bearish', 'overbought') THEN 1 ELSE 0 END
               + CASE WHEN macd_signal_label IN ('bearish', 'overbought') THEN 1 ELSE 0 END
               + CASE WHEN bb_signal IN ('bearish', 'overbought') THEN 1 ELSE 0 END
               + CASE WHEN stoch_signal IN ('bearish', 'overbought') THEN 1 ELSE 0 END) AS bearish FROM v)
SELECT symbol, sma_20, sma_50, rsi, macd, macd_signal, bb_position, stoch_k, stoch_d, ma_signal, rsi_signal,
       macd_signal_label, bb_signal, stoch_signal, CAST(bullish AS INTEGER) AS bullish, CAST(bearish AS INTEGER) AS bearish,
       CASE WHEN bullish > bearish THEN 'bullish' WHEN bearish > bullish THEN 'bearish' ELSE 'neutral' END AS overall_signal
FROM c"""


@query("vote_signals", Q(_VOTE_SQL, "bars", doubles=("sma_20", "sma_50", "rsi", "macd", "macd_signal", "bb_position",
                                                      "stoch_k", "stoch_d")))
def q_vote_signals(spark, sf_dir):
    """Five technical signals at each symbol's latest bar and their vote."""
    p = series.prepare(fx.bars(spark, sf_dir))
    p = ind.sma(p, 20)
    p = ind.sma(p, 50)
    p = ind.rsi_sma(p, 14)
    p = ind.macd(p)
    p = ind.bb_position(ind.bollinger(p, 20))
    p = ind.stochastic(p, 14, 3)
    last = series.finish(ind.latest_row(p))
    v = sg.vote_signals("sma_20", "sma_50", "rsi_14", "macd", "macd_signal", "bb_position_20", "stoch_k_14",
                        "stoch_d_14")
    out = last.select("symbol", "sma_20", "sma_50", F.col("rsi_14").alias("rsi"), "macd", "macd_signal",
                      F.col("bb_position_20").alias("bb_position"), F.col("stoch_k_14").alias("stoch_k"),
                      F.col("stoch_d_14").alias("stoch_d"), v.alias("v"))
    return rounded(out.select("*", F.col("v.ma_signal"), F.col("v.rsi_signal"),
                              F.col("v.macd_signal").alias("macd_signal_label"), F.col("v.bb_signal"),
                              F.col("v.stoch_signal"), F.col("v.bullish"), F.col("v.bearish"),
                              F.col("v.overall_signal")).drop("v"))


_BT = f"""WITH {BASE},
a AS (SELECT br.*, {fr('AVG', 'close', 20)} AS s20, {fr('AVG', 'close', 50)} AS s50 FROM br {W}),
b AS (SELECT *, CASE WHEN close > s20 AND s20 > s50 THEN 1 WHEN close < s20 AND s20 < s50 THEN -1 ELSE 0 END AS pos
      FROM a),
c AS (SELECT *, LAG(pos) OVER {W[7:].replace('w AS ', '')} AS held,
        CASE WHEN pos <> COALESCE(LAG(pos) OVER {W[7:].replace('w AS ', '')}, 0) THEN 1 ELSE 0 END AS chg FROM b),
d AS (SELECT *, held * ret AS sr FROM c),
e AS (SELECT *, CASE WHEN SUM(CASE WHEN 1 + sr = 0 THEN 1 ELSE 0 END) OVER r > 0 THEN 0.0 ELSE
        (CASE WHEN SUM(CASE WHEN 1 + sr < 0 THEN 1 ELSE 0 END) OVER r % 2 = 1 THEN -1.0 ELSE 1.0 END)
        * EXP(COALESCE(SUM(CASE WHEN 1 + sr <> 0 THEN LN(ABS(1 + sr)) END) OVER r, 0.0)) END AS val
      FROM d WINDOW r AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, (val - MAX(val) OVER r) / NULLIF(MAX(val) OVER r, 0) AS dd FROM e
      WINDOW r AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, SUM(chg) AS trades,
        AVG(CASE WHEN held <> 0 THEN (CASE WHEN sr > 0 THEN 1.0 ELSE 0.0 END) END) * 100 AS win_rate,
        AVG(sr) AS mean_return, STDDEV_SAMP(sr) AS sd, MIN(dd) AS max_drawdown, arg_max(val, rn) - 1 AS total_return
      FROM f GROUP BY symbol)
SELECT symbol, CAST(trades AS BIGINT) AS trades, win_rate, mean_return,
       CASE WHEN sd > 0 THEN mean_return / sd * SQRT(252.0) ELSE 0.0 END AS sharpe_ratio, max_drawdown, total_return
FROM g"""


@query("signal_backtest", Q(_BT, "bars", doubles=("win_rate", "mean_return", "sharpe_ratio", "max_drawdown",
                                                   "total_return")))
def q_signal_backtest(spark, sf_dir):
    """Moving-average signal backtest per symbol."""
    return rounded(fc.signal_backtest(fx.bars(spark, sf_dir)))


_DRIFT = """dg AS (SELECT symbol, regr_slope(close, rn) AS slope, COUNT(close) AS n, STDDEV_POP(close) AS sd,
               arg_max(close, rn) AS last_close, MAX(ts) AS last_date
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars) GROUP BY symbol),
drift AS (SELECT symbol, CAST(d.day AS INTEGER) AS day,
        strftime(last_date + CAST(d.day AS INTEGER), '%Y-%m-%d') AS forecast_date,
        last_close + d.day * (COALESCE(slope, 0.0) + (SIN(2 * PI() * (n - 1) / 252.0) * sd * 0.1) * 0.1) AS predicted
      FROM dg, range(1, 31) d(day))"""


@query("forecast_drift", Q(f"WITH {_DRIFT}\nSELECT * FROM drift", "bars", doubles=("predicted",)))
def q_forecast_drift(spark, sf_dir):
    """Deterministic drift + seasonal forecast path, 30 days per symbol."""
    return rounded(fc.forecast_drift(fx.bars(spark, sf_dir), 30))


_RSTD = """rs AS (SELECT symbol, STDDEV_SAMP(ret) AS ret_std FROM (SELECT symbol,
          close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) GROUP BY symbol)"""


@query("forecast_interval", Q(f"""WITH {_DRIFT}, {_RSTD}
SELECT symbol, day, predicted, predicted * (1 - ret_std * 1.96) AS lower, predicted * (1 + ret_std * 1.96) AS upper
FROM drift JOIN rs USING (symbol)""", "bars", doubles=("predicted", "lower", "upper")))
def q_forecast_interval(spark, sf_dir):
    """95 % band around the drift path from the daily return std."""
    bars = fx.bars(spark, sf_dir)
    return rounded(fc.forecast_interval(fc.forecast_drift(bars, 30), bars))


@query("path_direction", Q(f"""WITH {_DRIFT},
g AS (SELECT symbol, arg_min(predicted, day) AS f, arg_max(predicted, day) AS l FROM drift GROUP BY symbol)
SELECT symbol, (l - f) / f * 100 AS path_change_pct,
  CASE WHEN (l - f) / f * 100 > 5 THEN 'strong_uptrend' WHEN (l - f) / f * 100 > 1 THEN 'uptrend'
       WHEN (l - f) / f * 100 < -5 THEN 'strong_downtrend' WHEN (l - f) / f * 100 < -1 THEN 'downtrend'
       ELSE 'sideways' END AS path_direction FROM g""", "bars", doubles=("path_change_pct",)))
def q_path_direction(spark, sf_dir):
    """Direction of each drift path from first to last step."""
    return rounded(st.path_direction(fc.forecast_drift(fx.bars(spark, sf_dir), 30)))


@query("prediction_risk", Q(f"""WITH {_DRIFT}, {_RSTD},
pv AS (SELECT symbol, STDDEV_POP(predicted) / AVG(predicted) AS path_volatility FROM drift GROUP BY symbol)
SELECT symbol, path_volatility, CASE WHEN path_volatility > ret_std * 1.5 THEN 'high'
  WHEN path_volatility > ret_std * 1.2 THEN 'medium' ELSE 'low' END AS prediction_risk
FROM pv JOIN rs USING (symbol)""", "bars", doubles=("path_volatility",)))
def q_prediction_risk(spark, sf_dir):
    """Path dispersion vs historical return volatility."""
    bars = fx.bars(spark, sf_dir)
    return rounded(st.prediction_risk(fc.forecast_drift(bars, 30), bars))


@query("horizon_cross", Q("""WITH b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
       COUNT(*) OVER (PARTITION BY symbol) AS n, close / LAG(close, 30) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m30
       FROM bars),
l AS (SELECT symbol, ts, close, COALESCE(m30, 0.0) AS er,
        GREATEST(0.1, LEAST(0.95, ABS(COALESCE(m30, 0.0)) * 10 + 0.5)) AS conf FROM b WHERE rn = n - 1),
h AS (SELECT l.*, d.day, close * (1 + er * d.day / 30.0) AS price FROM l, horizons d)
SELECT symbol, day, strftime(ts + day, '%Y-%m-%d') AS forecast_date, price AS predicted_price,
       price - close AS change, (price - close) / close * 100 AS change_percent, conf * (1 - day / 100.0) AS confidence,
       CASE WHEN er > 0.02 THEN 'bullish' WHEN er < -0.02 THEN 'bearish' ELSE 'neutral' END AS direction
FROM h""", "bars", "horizons", doubles=("predicted_price", "change", "change_percent", "confidence")))
def q_horizon_cross(spark, sf_dir):
    """J9 + X20 + X21: latest close projected to 7/14/21/30 days."""
    return rounded(fc.horizon_prices(fx.bars(spark, sf_dir)))


@query("ewma_volatility", Q(f"""WITH {BASE}, sq AS (SELECT symbol, rn, ret * ret AS x FROM br),
{ewm_cte('ev', 'sq', 'x', 0.06, False, start=1)}
SELECT br.symbol, br.ts, br.ret, ev.val AS ewma_var, SQRT(ev.val) AS ewma_vol
FROM br LEFT JOIN ev ON ev.symbol = br.symbol AND ev.rn = br.rn""", "bars", doubles=("ret", "ewma_var", "ewma_vol")))
def q_ewma_volatility(spark, sf_dir):
    """RiskMetrics-style EWMA variance of returns (lambda 0.94)."""
    return rounded(fc.ewma_volatility(fx.bars(spark, sf_dir)))


@query("ar1_fit", Q(f"""WITH {BASE}, l AS (SELECT *, LAG(ret) OVER {W[7:].replace('w AS ', '')} AS lr FROM br),
g AS (SELECT symbol, regr_slope(ret, lr) AS phi, regr_intercept(ret, lr) AS c, CAST(regr_count(ret, lr) AS BIGINT) AS pairs,
             arg_max(ret, rn) AS last_ret FROM l GROUP BY symbol)
SELECT *, c + phi * last_ret AS next_return FROM g""", "bars", doubles=("phi", "c", "last_ret", "next_return")))
def q_ar1_fit(spark, sf_dir):
    """Per-symbol AR(1) of daily returns and the one-step forecast."""
    return rounded(fc.ar1_fit(fx.bars(spark, sf_dir)))


@query("asof_ffill", Q("""WITH j AS (SELECT b.symbol, b.ts, b.close, m.cpi FROM bars b ASOF LEFT JOIN macro m ON b.ts >= m.ts)
SELECT symbol, ts, close, cpi, cpi / LAG(cpi) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS cpi_change FROM j""",
                       "bars", "macro", doubles=("close", "cpi", "cpi_change")))
def q_asof_ffill(spark, sf_dir):
    """Last monthly macro value at or before each bar, and its change."""
    b = fx.bars(spark, sf_dir).select("symbol", "ts", "close")
    return rounded(align.asof_ffill(b, fx.macro(spark, sf_dir), value="cpi"))


@query("attach_fundamentals", Q("""SELECT b.symbol, b.ts, b.close, COALESCE(f.trailing_pe, 0.0) AS trailing_pe,
  COALESCE(f.profit_margin, 0.0) AS profit_margin, COALESCE(f.revenue_growth, 0.0) AS revenue_growth,
  COALESCE(f.debt_to_equity, 0.0) AS debt_to_equity, COALESCE(f.current_ratio, 0.0) AS current_ratio,
  COALESCE(f.beta, 1.0) AS beta, COALESCE(f.market_cap, 0.0) AS market_cap
FROM bars b LEFT JOIN fundamentals f USING (symbol)""", "bars", "fundamentals",
    doubles=("close", "trailing_pe", "profit_margin", "revenue_growth", "debt_to_equity", "current_ratio", "beta",
             "market_cap")))
def q_attach_fundamentals(spark, sf_dir):
    """J4 (+P3): fundamentals onto every bar with defaults."""
    b = fx.bars(spark, sf_dir).select("symbol", "ts", "close")
    return rounded(align.attach_fundamentals(b, fx.fundamentals(spark, sf_dir)))


@query("attach_sector", Q("""SELECT b.symbol, b.ts, COALESCE(s.sector, 'Unknown') AS sector,
  COALESCE(s.industry, 'Unknown') AS industry FROM bars b LEFT JOIN sector_members s USING (symbol)""",
                          "bars", "sector_members"))
def q_attach_sector(spark, sf_dir):
    """Sector and industry onto every bar."""
    return align.attach_sector(fx.bars(spark, sf_dir).select("symbol", "ts"), fx.sector_members(spark, sf_dir))


def _reward_frame(spark, sf_dir):
    """Naive persistence forecasts scored by the reward rules: the trailing
    30-row return predicts the next 30 rows' return, its sign the trend, the
    trailing 20-row return vol the forward vol, today's price sentiment the
    one 30 rows ahead, the trailing 7-row return the next 7 rows'."""
    p = series.prepare(fx.bars(spark, sf_dir))
    w = series.win()
    p = ind.momentum(p, 30)
    p = ind.momentum(p, 7)
    p = ind.rolling_volatility(p, 20)
    p = ind.forward_return(p, 30)
    p = ind.forward_return(p, 7)
    p = ind.sentiment_from_price(p)
    fw = series.rows(1, 20)
    r = ind.pct_change(F.col("close"), 1)
    p = p.withColumn("_r", r).withColumn(
        "fwd_vol_20", F.when(F.count("_r").over(fw) == 20, F.stddev_samp("_r").over(fw)))
    p = p.withColumn("fwd_sentiment_30", F.lead("price_sentiment", 30).over(w))
    rows = series.finish(p, keep_index=True).filter((F.col("_rn") >= 30) & (F.col("_rn") < F.col("_n") - 30))
    e_p = F.abs(F.col("momentum_30") - F.col("fwd_return_30"))
    pt = F.when(F.col("momentum_30") > 0, 1.0).otherwise(0.0)
    at = F.when(F.col("fwd_return_30") > 0, 1.0).otherwise(0.0)
    return rows.select(
        "symbol", "ts",
        rw.reward_price(e_p, F.col("fwd_return_30")).alias("reward_price"),
        rw.reward_trend(F.abs(pt - at)).alias("reward_trend"),
        rw.reward_risk(F.abs(F.col("volatility_20") - F.col("fwd_vol_20"))).alias("reward_risk"),
        rw.reward_sentiment(F.abs(F.col("price_sentiment") - F.col("fwd_sentiment_30"))).alias("reward_sentiment"),
        rw.reward_fundamental(F.abs(F.col("momentum_7") - F.col("fwd_return_7"))).alias("reward_fundamental"))


def _tiers(e, tiers, last):
    return "CASE " + " ".join(f"WHEN {e} < {b} THEN {float(p)}" for b, p in tiers) + f" ELSE {float(last)} END"


_RW = f"""WITH {BASE},
a AS (SELECT br.*, close / NULLIF(LAG(close, 30) OVER w, 0) - 1 AS m30, close / NULLIF(LAG(close, 7) OVER w, 0) - 1 AS m7,
        {fr('STDDEV_SAMP', 'ret', 20)} AS v20, LEAD(close, 30) OVER w / NULLIF(close, 0) - 1 AS f30,
        LEAD(close, 7) OVER w / NULLIF(close, 0) - 1 AS f7,
        CASE WHEN COUNT(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) = 20
             THEN STDDEV_SAMP(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) END AS fv20,
        CASE WHEN rn < 20 THEN 50.0 ELSE COALESCE(GREATEST(0.0, LEAST(100.0,
          (TANH((close / NULLIF(LAG(close, 7) OVER w, 0) - 1) * 10) * 50 + 50) * 0.5
          + GREATEST(0.0, LEAST(100.0, (volume / NULLIF({prior('AVG', 'volume', 20)}, 0) - 1) * 50 + 50)) * 0.3
          + GREATEST(0.0, 100 - {prior('STDDEV_SAMP', 'close', 20)} / NULLIF({prior('AVG', 'close', 20)}, 0) * 100) * 0.2
        )), 50.0) END AS ps FROM br {W}),
b AS (SELECT a.*, LEAD(ps, 30) OVER w AS fps FROM a {W})
SELECT symbol, ts,
  GREATEST(-500.0, LEAST(1000.0, 100.0 + ({_tiers('ABS(m30 - f30)', [(0.01, 500), (0.05, 200), (0.10, 50), (0.20, -100)], -300)})
    + CASE WHEN ABS(m30 - f30) < 0.05 AND f30 <> 0 THEN 200.0 ELSE 0.0 END)) AS reward_price,
  100.0 + {_tiers('ABS((CASE WHEN m30 > 0 THEN 1.0 ELSE 0.0 END) - (CASE WHEN f30 > 0 THEN 1.0 ELSE 0.0 END))', [(0.1, 400), (0.3, 200), (0.5, 50)], -200)} AS reward_trend,
  100.0 + {_tiers('ABS(v20 - fv20)', [(0.01, 300), (0.05, 150), (0.10, 50)], -150)} AS reward_risk,
  100.0 + {_tiers('ABS(ps - fps)', [(5, 200), (15, 100), (25, 25)], -100)} AS reward_sentiment,
  100.0 + {_tiers('ABS(m7 - f7)', [(0.02, 400), (0.05, 200), (0.10, 50)], -200)} AS reward_fundamental
FROM b WHERE rn >= 30 AND rn < n - 30"""
_RD = ("reward_price", "reward_trend", "reward_risk", "reward_sentiment", "reward_fundamental")


@query("reward_scores", Q(_RW, "bars", doubles=_RD))
def q_reward_scores(spark, sf_dir):
    """R1-R5 on naive persistence forecasts, per bar."""
    return rounded(_reward_frame(spark, sf_dir))


_ROLL = ("WITH rs AS (" + _RW + """),
m AS (SELECT symbol, model, AVG(reward) AS mean_reward, COUNT(*) AS samples FROM rs
      UNPIVOT (reward FOR model IN (reward_price AS 'price', reward_trend AS 'trend', reward_risk AS 'risk',
                                    reward_sentiment AS 'sentiment', reward_fundamental AS 'fundamental'))
      GROUP BY symbol, model)
SELECT symbol, SUM(mean_reward) AS total_reward, AVG(mean_reward) AS avg_reward, MAX(samples) AS training_samples
FROM m GROUP BY symbol""")


@query("reward_rollup", Q(_ROLL, "bars", doubles=("total_reward", "avg_reward")))
def q_reward_rollup(spark, sf_dir):
    """Mean reward per model -> per-symbol total and mean, sample count."""
    from tickframe.operators.scores import reward_rollup
    return rounded(reward_rollup(_reward_frame(spark, sf_dir)))


_RUNS = ("WITH rs AS (" + _RW + """),
m AS (SELECT symbol, year(ts) AS y, model, AVG(reward) AS mean_reward, COUNT(*) AS samples FROM rs
      UNPIVOT (reward FOR model IN (reward_price AS 'price', reward_trend AS 'trend', reward_risk AS 'risk',
                                    reward_sentiment AS 'sentiment', reward_fundamental AS 'fundamental'))
      GROUP BY symbol, year(ts), model),
t AS (SELECT symbol, y, SUM(mean_reward) AS total_reward, MAX(samples) AS training_samples FROM m GROUP BY symbol, y)
SELECT symbol, CAST(MAX(y) AS INTEGER) AS trained_at, arg_max(total_reward, y) AS latest_total, arg_max(training_samples, y) AS training_samples,
       COUNT(*) AS runs FROM t GROUP BY symbol""")


@query("latest_rewards", Q(_RUNS, "bars", doubles=("latest_total",)))
def q_latest_rewards(spark, sf_dir):
    """One run a calendar year per symbol and its latest total (its share of
    the greatest score is half a unit of the fourth decimal too often to be compared)."""
    from tickframe.operators.scores import latest_rewards, reward_rollup
    runs = _reward_frame(spark, sf_dir).withColumn("run", F.struct("symbol", F.year("ts").alias("trained_at")))
    totals = reward_rollup(runs, by="run").select("run.*", "total_reward", "training_samples")
    return rounded(latest_rewards(totals).drop("progress_percentage"))


_STATUS = ("WITH rs AS (" + _RW + """)
SELECT symbol, model, AVG(reward) AS weight, CASE WHEN AVG(reward) > 0 THEN 'Good' ELSE 'Needs Training' END AS status FROM rs
UNPIVOT (reward FOR model IN (reward_price AS 'price', reward_trend AS 'trend', reward_risk AS 'risk',
                              reward_sentiment AS 'sentiment', reward_fundamental AS 'fundamental'))
GROUP BY symbol, model""")


@query("model_status", Q(_STATUS, "bars", doubles=("weight",)))
def q_model_status(spark, sf_dir):
    """Weight and status of each symbol's models."""
    from tickframe.operators.scores import model_status
    return rounded(model_status(_reward_frame(spark, sf_dir)))
