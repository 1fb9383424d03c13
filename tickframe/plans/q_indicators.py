"""Registered queries: window indicators, one per operator.

Each query runs the operator over every bar of every symbol and returns
(symbol, ts, <indicator columns>).  The oracle restates the indicator in
DuckDB window SQL over ``br`` (bars + row number + 1-row return).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.plans.catalog import query
from tickframe.plans.sqlkit import Q, ewm_cte, rounded
from tickframe.sources import fixtures as fx

BASE = """br0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
                COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars),
br AS (SELECT *, close / LAG(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret,
              close - LAG(close) OVER (PARTITION BY symbol ORDER BY rn) AS delta FROM br0)"""
W = "WINDOW w AS (PARTITION BY symbol ORDER BY rn)"


def fr(agg: str, x: str, n: int) -> str:
    """pandas rolling(n) in DuckDB: null until the frame holds n values."""
    f = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({x}) OVER {f} = {n} THEN {agg}({x}) OVER {f} END"


def prior(agg: str, x: str, n: int) -> str:
    f = f"(w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({x}) OVER {f} = {n} THEN {agg}({x}) OVER {f} END"


def _run(spark, sf_dir, ops, cols, keep_index=False):
    p = series.prepare(fx.bars(spark, sf_dir))
    for op in ops:
        p = op(p)
    out = series.finish(p, keep_index=keep_index)
    return rounded(out.select("symbol", "ts", *cols))


def reg(name, ops, cols, select_sql, ctes="", doubles=None, where=""):
    """Register a per-bar indicator query and its oracle."""
    sql = Q(f"WITH {BASE}{',' if ctes else ''}{ctes}\nSELECT br.symbol, br.ts, {select_sql} FROM br {where} {W}",
            "bars", doubles=tuple(cols if doubles is None else doubles))
    query(name, sql)(lambda spark, sf_dir: _run(spark, sf_dir, ops, cols))


SMA_N = (5, 10, 20, 50, 100, 200)
reg("sma", [lambda p, n=n: ind.sma(p, n) for n in SMA_N], [f"sma_{n}" for n in SMA_N],
    ", ".join(f"{fr('AVG', 'close', n)} AS sma_{n}" for n in SMA_N))

EMA_SPANS = (5, 9, 10, 12, 20, 26, 50, 100, 200)
reg("ema_adjusted", [lambda p, s=s: ind.ema_adjusted(p, s) for s in EMA_SPANS], [f"ema_{s}" for s in EMA_SPANS],
    ", ".join(f"(SELECT val FROM e{s} WHERE e{s}.symbol = br.symbol AND e{s}.rn = br.rn) AS ema_{s}"
              for s in EMA_SPANS),
    ctes=",\n".join(ewm_cte(f"e{s}", "br", "close", 2 / (s + 1), True) for s in EMA_SPANS))

reg("ema_recursive", [lambda p: ind.ema_recursive(p, 12), lambda p: ind.ema_recursive(p, 26)],
    ["ema_rec_12", "ema_rec_26"],
    "(SELECT val FROM e12 WHERE e12.symbol = br.symbol AND e12.rn = br.rn) AS ema_rec_12, "
    "(SELECT val FROM e26 WHERE e26.symbol = br.symbol AND e26.rn = br.rn) AS ema_rec_26",
    ctes=ewm_cte("e12", "br", "close", 2 / 13, False, min_periods=12) + ",\n"
    + ewm_cte("e26", "br", "close", 2 / 27, False, min_periods=26))

_MACD_CTES = (ewm_cte("f", "br", "close", 2 / 13, True) + ",\n" + ewm_cte("s", "br", "close", 2 / 27, True)
              + ",\nline AS (SELECT f.symbol, f.rn, f.val - s.val AS x FROM f JOIN s ON f.symbol = s.symbol "
              "AND f.rn = s.rn),\n" + ewm_cte("sg", "line", "x", 0.2, True)
              + ",\nm AS (SELECT line.symbol, line.rn, line.x AS macd, sg.val AS macd_signal, line.x - sg.val AS "
              "macd_hist FROM line JOIN sg ON line.symbol = sg.symbol AND line.rn = sg.rn)")
reg("macd", [ind.macd], ["macd", "macd_signal", "macd_hist"],
    "m.macd, m.macd_signal, m.macd_hist", ctes=_MACD_CTES,
    where="JOIN m ON m.symbol = br.symbol AND m.rn = br.rn")

_MACDR_CTES = (ewm_cte("f", "br", "close", 2 / 13, False, min_periods=12) + ",\n"
               + ewm_cte("s", "br", "close", 2 / 27, False, min_periods=26)
               + ",\nline AS (SELECT f.symbol, f.rn, f.val - s.val AS x FROM f JOIN s ON f.symbol = s.symbol "
               "AND f.rn = s.rn),\n" + ewm_cte("sg", "line", "x", 0.2, False, start=25, min_periods=9)
               + ",\nm AS (SELECT line.symbol, line.rn, line.x AS macd_rec, sg.val AS macd_rec_signal, "
               "line.x - sg.val AS macd_rec_diff FROM line LEFT JOIN sg ON line.symbol = sg.symbol "
               "AND line.rn = sg.rn)")
reg("macd_recursive", [ind.macd_recursive], ["macd_rec", "macd_rec_signal", "macd_rec_diff"],
    "m.macd_rec, m.macd_rec_signal, m.macd_rec_diff", ctes=_MACDR_CTES,
    where="JOIN m ON m.symbol = br.symbol AND m.rn = br.rn")

_G = "CASE WHEN delta > 0 THEN delta ELSE 0.0 END"
_L = "CASE WHEN delta < 0 THEN -delta ELSE 0.0 END"
reg("rsi_sma", [ind.rsi_sma], ["rsi_14"],
    f"""CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN al = 0 THEN (CASE WHEN ag > 0 THEN 100.0 END)
         ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi_14""",
    ctes=f"gl AS (SELECT *, {_G} AS g, {_L} AS l FROM br),\n"
         f"ra AS (SELECT symbol, rn, {fr('AVG', 'g', 14)} AS ag, {fr('AVG', 'l', 14)} AS al FROM gl {W})",
    where="JOIN ra USING (symbol, rn)")

reg("rsi_wilder", [ind.rsi_wilder], ["rsi_wilder_14"],
    "CASE WHEN el.val IS NULL THEN NULL WHEN el.val = 0 THEN 100.0 "
    "ELSE 100.0 - 100.0 / (1.0 + eg.val / el.val) END AS rsi_wilder_14",
    ctes=f"gl AS (SELECT symbol, rn, {_G} AS g, {_L} AS l FROM br),\n"
         + ewm_cte("eg", "gl", "g", 1 / 14, False, min_periods=14) + ",\n"
         + ewm_cte("el", "gl", "l", 1 / 14, False, min_periods=14),
    where="LEFT JOIN eg USING (symbol, rn) LEFT JOIN el USING (symbol, rn)")


def _bb_sql(prefix: str, std: str) -> str:
    mid, sd = fr("AVG", "close", 20), fr(std, "close", 20)
    return (f"{mid} AS {prefix}_mid_20, {mid} + 2 * {sd} AS {prefix}_upper_20, {mid} - 2 * {sd} AS {prefix}_lower_20")


reg("bollinger", [ind.bollinger], ["bb_mid_20", "bb_upper_20", "bb_lower_20"], _bb_sql("bb", "STDDEV_SAMP"))
reg("bollinger_pop", [ind.bollinger_pop], ["bbp_mid_20", "bbp_upper_20", "bbp_lower_20"],
    _bb_sql("bbp", "STDDEV_POP"))
_BBW = (f"ba AS (SELECT symbol, rn, {fr('AVG', 'close', 20)} AS mid, {fr('STDDEV_SAMP', 'close', 20)} AS sd "
        f"FROM br {W})")
reg("bb_width", [ind.bollinger, ind.bb_width], ["bb_width_20"],
    "((mid + 2 * sd) - (mid - 2 * sd)) / NULLIF(mid, 0) AS bb_width_20", ctes=_BBW, where="JOIN ba USING (symbol, rn)")
reg("bb_position", [ind.bollinger, ind.bb_position], ["bb_position_20"],
    "(close - (mid - 2 * sd)) / NULLIF((mid + 2 * sd) - (mid - 2 * sd), 0) AS bb_position_20",
    ctes=_BBW, where="JOIN ba USING (symbol, rn)")

_HL = (f"hl AS (SELECT symbol, rn, {fr('MIN', 'low', 14)} AS lo14, {fr('MAX', 'high', 14)} AS hi14 FROM br {W}),\n"
       "sk AS (SELECT br.symbol, br.rn, 100 * ((close - lo14) / NULLIF(hi14 - lo14, 0)) AS k FROM br "
       "JOIN hl USING (symbol, rn))")
reg("stochastic", [ind.stochastic], ["stoch_k_14", "stoch_d_14"],
    "sk.k AS stoch_k_14, (SELECT CASE WHEN COUNT(s2.k) = 3 THEN AVG(s2.k) END FROM sk s2 "
    "WHERE s2.symbol = br.symbol AND s2.rn BETWEEN br.rn - 2 AND br.rn) AS stoch_d_14",
    ctes=_HL, where="JOIN sk USING (symbol, rn)")
reg("williams_r", [ind.williams_r], ["williams_r_14"],
    "-100 * ((hi14 - close) / NULLIF(hi14 - lo14, 0)) AS williams_r_14", ctes=_HL,
    where="JOIN hl USING (symbol, rn)")
reg("atr", [ind.atr], ["atr_14"], f"{fr('AVG', 'tr', 14)} AS atr_14",
    ctes="trt AS (SELECT symbol, rn, CASE WHEN LAG(close) OVER w IS NOT NULL THEN GREATEST(high - low, "
         f"ABS(high - LAG(close) OVER w), ABS(low - LAG(close) OVER w)) END AS tr FROM br {W})",
    where="JOIN trt USING (symbol, rn)")
reg("volume_sma", [ind.volume_sma], ["volume_sma_20", "volume_ratio_20"],
    f"{fr('AVG', 'volume', 20)} AS volume_sma_20, volume / NULLIF({fr('AVG', 'volume', 20)}, 0) AS volume_ratio_20")
reg("volume_ratio", [ind.volume_sma], ["volume_ratio_20"],
    f"volume / NULLIF({fr('AVG', 'volume', 20)}, 0) AS volume_ratio_20")
reg("volume_ratio_prior", [ind.volume_ratio_prior], ["volume_ratio_prior_20"],
    f"volume / NULLIF({prior('AVG', 'volume', 20)}, 0) AS volume_ratio_prior_20")
reg("obv", [ind.obv], ["obv"],
    "CASE WHEN rn > 0 THEN SUM(volume * SIGN(delta)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    "END AS obv")

MOM_K = (1, 3, 5, 7, 10, 20, 30, 50)
reg("momentum", [lambda p, k=k: ind.momentum(p, k) for k in MOM_K], [f"momentum_{k}" for k in MOM_K],
    ", ".join(f"close / NULLIF(LAG(close, {k}) OVER w, 0) - 1 AS momentum_{k}" for k in MOM_K))

VOL_N = (5, 10, 20, 30, 50, 252)
reg("rolling_volatility", [lambda p: ind.rolling_volatility(p, VOL_N)],
    [f"volatility_{n}" for n in VOL_N], ", ".join(f"{fr('STDDEV_SAMP', 'ret', n)} AS volatility_{n}" for n in VOL_N))
reg("price_std", [lambda p, n=n: ind.price_std(p, n) for n in (5, 10, 20)], [f"price_std_{n}" for n in (5, 10, 20)],
    ", ".join(f"{fr('STDDEV_SAMP', 'close', n)} AS price_std_{n}" for n in (5, 10, 20)))
reg("price_std_prior", [ind.price_std_prior], ["price_std_prior_20"],
    f"{prior('STDDEV_SAMP', 'close', 20)} AS price_std_prior_20")
reg("support_resistance", [ind.support_resistance],
    ["resistance_20", "support_20", "dist_support_20", "dist_resistance_20"],
    f"{fr('MAX', 'high', 20)} AS resistance_20, {fr('MIN', 'low', 20)} AS support_20, "
    f"(close - {fr('MIN', 'low', 20)}) / NULLIF({fr('MIN', 'low', 20)}, 0) * 100 AS dist_support_20, "
    f"({fr('MAX', 'high', 20)} - close) / NULLIF(close, 0) * 100 AS dist_resistance_20")
reg("trend_strength", [ind.trend_strength], ["trend_strength"],
    f"(close - {fr('AVG', 'close', 50)}) / NULLIF({fr('AVG', 'close', 50)}, 0) AS trend_strength")
reg("trend_direction", [ind.trend_direction], ["trend_direction"],
    f"CASE WHEN close > {fr('AVG', 'close', 20)} THEN 1 ELSE -1 END AS trend_direction", doubles=())
reg("trend_zscore", [ind.trend_zscore], ["trend_zscore_50"],
    f"(close - {fr('AVG', 'close', 50)}) / NULLIF({fr('STDDEV_SAMP', 'close', 50)}, 0) AS trend_zscore_50")
reg("relative_volatility",
    [ind.relative_volatility, lambda p: ind.relative_volatility(p, prior=True)],
    ["relative_volatility_20", "relative_volatility_prior_20"],
    f"{fr('STDDEV_SAMP', 'close', 20)} / NULLIF({fr('AVG', 'close', 20)}, 0) AS relative_volatility_20, "
    f"{prior('STDDEV_SAMP', 'close', 20)} / NULLIF({prior('AVG', 'close', 20)}, 0) AS relative_volatility_prior_20")
LAGS = (1, 2, 3, 5, 10)
reg("lag_features", [ind.lag_features], [f"{c}_lag_{k}" for k in LAGS for c in ("close", "volume")],
    ", ".join(f"LAG({c}, {k}) OVER w AS {c}_lag_{k}" for k in LAGS for c in ("close", "volume")))
_RF = []
for _n in (5, 10, 20):
    _RF += [f"close_ma_{_n}", f"close_std_{_n}", f"volume_ma_{_n}"]
reg("rolling_features", [ind.rolling_features], _RF + ["price_to_ma20", "volume_to_ma20"],
    ", ".join(f"{fr('AVG', 'close', n)} AS close_ma_{n}, {fr('STDDEV_SAMP', 'close', n)} AS close_std_{n}, "
              f"{fr('AVG', 'volume', n)} AS volume_ma_{n}" for n in (5, 10, 20))
    + f", close / NULLIF({fr('AVG', 'close', 20)}, 0) AS price_to_ma20, "
      f"volume / NULLIF({fr('AVG', 'volume', 20)}, 0) AS volume_to_ma20")
reg("bar_shape", [ind.bar_shape], ["high_low_ratio", "close_open_ratio", "price_change", "volume_change"],
    "high / NULLIF(low, 0) AS high_low_ratio, close / NULLIF(open, 0) AS close_open_ratio, "
    "close / NULLIF(LAG(close) OVER w, 0) - 1 AS price_change, volume / NULLIF(LAG(volume) OVER w, 0) - 1 AS volume_change")
reg("ma_ratio", [lambda p, n=n: ind.ma_ratio(p, n) for n in (5, 10, 20, 50)],
    [f"ma_ratio_{n}" for n in (5, 10, 20, 50)],
    ", ".join(f"close / NULLIF({fr('AVG', 'close', n)}, 0) AS ma_ratio_{n}" for n in (5, 10, 20, 50)))
reg("sentiment_from_price", [ind.sentiment_from_price], ["price_sentiment"],
    "CASE WHEN rn < 20 THEN 50.0 ELSE COALESCE(GREATEST(0.0, LEAST(100.0, "
    "(TANH((close / NULLIF(LAG(close, 7) OVER w, 0) - 1) * 10) * 50 + 50) * 0.5 "
    f"+ GREATEST(0.0, LEAST(100.0, (volume / NULLIF({prior('AVG', 'volume', 20)}, 0) - 1) * 50 + 50)) * 0.3 "
    f"+ GREATEST(0.0, 100 - {prior('STDDEV_SAMP', 'close', 20)} / NULLIF({prior('AVG', 'close', 20)}, 0) * 100) * 0.2"
    ")), 50.0) END AS price_sentiment")
reg("local_extrema", [ind.local_extrema], ["is_local_max", "is_local_min"],
    "rn > 0 AND rn < n - 1 AND close > COALESCE(MAX(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), "
    "'-infinity'::DOUBLE) AND close > COALESCE(MAX(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), "
    "'-infinity'::DOUBLE) AS is_local_max, "
    "rn > 0 AND rn < n - 1 AND close < COALESCE(MIN(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), "
    "'infinity'::DOUBLE) AND close < COALESCE(MIN(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), "
    "'infinity'::DOUBLE) AS is_local_min", doubles=())
_RUN = "(w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
reg("drawdown_series", [ind.drawdown_series], ["drawdown"],
    f"(close - MAX(close) OVER {_RUN}) / NULLIF(MAX(close) OVER {_RUN}, 0) AS drawdown")
reg("cumulative_return", [ind.returns, ind.cumulative_return], ["ret", "cum_return"],
    "ret, CASE WHEN SUM(CASE WHEN 1 + ret = 0 THEN 1 ELSE 0 END) OVER {r} > 0 THEN 0.0 ELSE "
    "(CASE WHEN SUM(CASE WHEN 1 + ret < 0 THEN 1 ELSE 0 END) OVER {r} % 2 = 1 THEN -1.0 ELSE 1.0 END) "
    "* EXP(COALESCE(SUM(CASE WHEN 1 + ret <> 0 THEN LN(ABS(1 + ret)) END) OVER {r}, 0.0)) END - 1 "
    "AS cum_return".format(r=_RUN))
reg("cumulative_sum_return", [ind.returns, ind.cumulative_sum_return], ["ret", "cum_sum_return"],
    f"ret, SUM(ret) OVER {_RUN} * 100 AS cum_sum_return")
reg("price_change", [lambda p, k=k: ind.price_change(p, k) for k in (1, 7, 30)],
    [c for k in (1, 7, 30) for c in (f"change_{k}", f"change_pct_{k}")],
    ", ".join(f"COALESCE(CASE WHEN n >= {k + 1} THEN close - LAG(close, {k}) OVER w END, 0.0) AS change_{k}, "
              f"COALESCE(CASE WHEN n >= {k + 1} THEN (close - LAG(close, {k}) OVER w) / "
              f"NULLIF(LAG(close, {k}) OVER w, 0) * 100 END, 0.0) AS change_pct_{k}" for k in (1, 7, 30)))
reg("forward_return", [lambda p, k=k: ind.forward_return(p, k) for k in (1, 7, 30)],
    [f"fwd_return_{k}" for k in (1, 7, 30)],
    ", ".join(f"LEAD(close, {k}) OVER w / NULLIF(close, 0) - 1 AS fwd_return_{k}" for k in (1, 7, 30)))
reg("forward_price_std", [ind.forward_price_std], ["fwd_price_std_30"],
    "CASE WHEN COUNT(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) = 30 THEN "
    "STDDEV_SAMP(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) END AS fwd_price_std_30")
_FD_CTE = f"v5 AS (SELECT symbol, rn, {fr('STDDEV_SAMP', 'ret', 5)} AS v FROM br {W})"
reg("forward_direction", [ind.forward_direction], ["fwd_direction", "fwd_volatility_5"],
    "CASE WHEN LEAD(close) OVER w > close THEN 1 ELSE 0 END AS fwd_direction, "
    "COALESCE((SELECT v FROM v5 WHERE v5.symbol = br.symbol AND v5.rn = br.rn + 1), 0.0) AS fwd_volatility_5",
    ctes=_FD_CTE, doubles=("fwd_volatility_5",))
query("forward_volatility5", Q(
    f"WITH {BASE}, {_FD_CTE}\nSELECT symbol, ts, COALESCE((SELECT v FROM v5 WHERE v5.symbol = br.symbol "
    "AND v5.rn = br.rn + 1), 0.0) AS fwd_volatility_5 FROM br", "bars", doubles=("fwd_volatility_5",)))(
    lambda spark, sf_dir: _run(spark, sf_dir, [ind.forward_direction], ["fwd_volatility_5"]))


@query("latest_row", Q(f"WITH {BASE}\nSELECT symbol, ts, open, high, low, close, volume FROM br WHERE rn = n - 1",
                       "bars", doubles=("open", "high", "low", "close", "volume")))
def q_latest_row(spark, sf_dir):
    """Last bar per symbol."""
    return rounded(ind.latest_row(fx.bars(spark, sf_dir)))


@query("tail_rows", Q(f"WITH {BASE}\nSELECT symbol, ts, open, high, low, close, volume FROM br WHERE rn >= n - 5",
                      "bars", doubles=("open", "high", "low", "close", "volume")))
def q_tail_rows(spark, sf_dir):
    """Last 5 bars per symbol."""
    return rounded(ind.tail_rows(fx.bars(spark, sf_dir), 5))


@query("sample_range", Q(f"WITH {BASE}\nSELECT symbol, ts, close FROM br WHERE rn >= 50 AND rn < n - 30",
                         "bars", doubles=("close",)))
def q_sample_range(spark, sf_dir):
    """Rows with index in [50, n - 30)."""
    return rounded(ind.sample_range(fx.bars(spark, sf_dir)).select("symbol", "ts", "close"))


@query("sample_range_200", Q(f"WITH {BASE}\nSELECT symbol, ts, close FROM br WHERE rn >= 200 AND rn < n - 30",
                             "bars", doubles=("close",)))
def q_sample_range_200(spark, sf_dir):
    """Rows with index in [200, n - 30)."""
    return rounded(ind.sample_range(fx.bars(spark, sf_dir), start=200).select("symbol", "ts", "close"))


@query("direction_hit_rate", Q(f"""WITH {BASE},
h AS (SELECT symbol, CASE WHEN COUNT(ret) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10
                             AND ret IS NOT NULL THEN
        CASE WHEN (CASE WHEN AVG(ret) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE -1 END)
                = (CASE WHEN ret > 0 THEN 1 ELSE -1 END) THEN 1 ELSE 0 END END AS hit FROM br {W})
SELECT symbol, COALESCE(AVG(hit) * 100, 50.0) AS hit_rate FROM h GROUP BY symbol""", "bars", doubles=("hit_rate",)))
def q_direction_hit_rate(spark, sf_dir):
    """% of correct direction calls from the mean of the previous 10 returns."""
    return rounded(ind.direction_hit_rate(fx.bars(spark, sf_dir)))


@query("monthly_targets", Q(f"""WITH {BASE},
t AS (SELECT symbol, ts, rn, n, LEAD(close, 29) OVER w / NULLIF(LAG(close, 1) OVER w, 0) - 1 AS target_return,
        CASE WHEN COUNT(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING) = 29 THEN
             STDDEV_SAMP(ret) OVER (w ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING) END AS target_volatility
      FROM br {W})
SELECT symbol, ts, target_return, target_volatility, CASE WHEN target_return > 0 THEN 1 ELSE 0 END AS target_trend
FROM t WHERE rn >= 60 AND rn < n - 30""", "bars", doubles=("target_return", "target_volatility")))
def q_monthly_targets(spark, sf_dir):
    """Monthly-horizon targets at rows 60 <= i < n - 30."""
    p = ind.monthly_targets(series.prepare(fx.bars(spark, sf_dir)))
    out = series.finish(p.filter(F.col("_keep")))
    return rounded(out.select("symbol", "ts", "target_return", "target_volatility", "target_trend"))
