"""Registered queries: monthly samples (W42, M9), crash score (A31), company
ratios (X18, X19), wide features (M2), blended forecasts (M16), key levels
(W30), insights (X16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.functions import fundamentals as fu
from tickframe.functions import signals as sg
from tickframe.operators import align
from tickframe.operators import indicators as ind
from tickframe.operators import monthly, series
from tickframe.operators import scores as scr
from tickframe.plans import catalog
from tickframe.plans import forecast as fc
from tickframe.plans import models as ml
from tickframe.plans.catalog import query
from tickframe.plans.q_indicators import _G, _L, BASE, W, fr
from tickframe.plans.q_misc import _linear_sql
from tickframe.plans.q_models import _DRIFT
from tickframe.plans.q_text import HEADLINE, s_polarity
from tickframe.plans.sqlkit import Q, rounded
from tickframe.sources import fixtures as fx

_MF = ("sma_20", "rsi", "macd", "volatility", "price_change_1d", "price_change_7d", "volume_ratio")


def _weighted(span: int) -> str:
    q = 1.0 - 2.0 / (span + 1)
    terms = " + ".join(f"LAG(close, {k}) OVER w * {q ** (k - 1)!r}" for k in range(1, 31))
    return f"({terms}) / {sum(q ** k for k in range(30))!r}"


@query("monthly_features", Q(f"""WITH {BASE},
d AS (SELECT *, COALESCE(GREATEST(close - LAG(close) OVER w, 0), 0) AS up, COALESCE(GREATEST(LAG(close) OVER w - close, 0), 0) AS down
      FROM br {W}),
m AS (SELECT symbol, ts, rn, n, AVG(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sma_20,
        AVG(up) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS u, AVG(down) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS dn,
        {_weighted(12)} - {_weighted(26)} AS macd, STDDEV_SAMP(ret) OVER (w ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING) AS volatility,
        LAG(close, 1) OVER w / LAG(close, 2) OVER w - 1 AS price_change_1d, LAG(close, 1) OVER w / LAG(close, 8) OVER w - 1 AS price_change_7d,
        LAG(volume, 1) OVER w / AVG(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS volume_ratio FROM d {W})
SELECT symbol, ts, sma_20, 0.0 AS sma_50, CASE WHEN dn = 0 THEN CASE WHEN u > 0 THEN 100.0 ELSE 0.0 END ELSE 100 - 100 / (1 + u / dn) END AS rsi,
  macd, volatility, price_change_1d, price_change_7d, 0.0 AS price_change_30d, volume_ratio
FROM m WHERE rn >= 60 AND rn < n - 30""", "bars", doubles=(*_MF, "sma_50", "price_change_30d")))
def q_monthly_features(spark, sf_dir):
    """Features of the 30 rows before each monthly sample."""
    p = monthly.monthly_features(series.prepare(fx.bars(spark, sf_dir)))
    out = series.finish(p.filter("_sample"))
    return rounded(out.select("symbol", "ts", *[c for c in monthly.MONTHLY_FEATURES if c not in ("sentiment_score", "news_count")]))


def _news_scores(spark, sf_dir):
    """(symbol, sentiment_score, news_count) of all articles of a symbol."""
    from tickframe.functions import text as tx
    from tickframe.plans.q_text import NEG, POS

    news = fx.news(spark, sf_dir).withColumn("_h", tx.headline_text(F.col("title"), F.col("summary")))
    return (tx.add_polarity(news, "_h", "score", POS, NEG).groupBy(F.col("symbol").cast("long").alias("symbol"))
            .agg(F.avg("score").alias("sentiment_score"), F.count(F.lit(1)).cast("int").alias("news_count")))


@query("crash_score", Q(f"""WITH br AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS rn, close / LAG(close) OVER (ORDER BY ts) - 1 AS ret FROM index_bars),
i AS (SELECT ts, close / LAG(close, 20) OVER w - 1 AS m, CASE WHEN COUNT(ret) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
        THEN STDDEV_SAMP(ret) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS v FROM br WINDOW w AS (ORDER BY ts)),
l AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(m, ts) FILTER (m IS NOT NULL) AS m, arg_max(v, ts) FILTER (v IS NOT NULL) AS v FROM i GROUP BY 1),
x AS (SELECT macro.ts AS month, COALESCE(v * 100, 20.0) AS vix, cpi / 40000 AS interest_rate, cpi / 1430 AS dollar_strength, m AS momentum_20
      FROM macro LEFT JOIN l ON l.month = macro.ts),
p AS (SELECT *, (vix > 30)::INT AS vix_signal, (interest_rate > 4)::INT AS interest_rate_signal, (dollar_strength > 105)::INT AS dollar_strength_signal FROM x),
c AS (SELECT *, GREATEST(0.0, LEAST(100.0, LEAST(25.0, GREATEST(0.0, 12.5 - COALESCE(momentum_20, 0) * 125)) + vix_signal * 30 + interest_rate_signal * 25
        + dollar_strength_signal * 20)) AS crash_probability FROM p)
SELECT *, CASE WHEN crash_probability > 70 THEN 'very_high' WHEN crash_probability > 50 THEN 'high' WHEN crash_probability > 30 THEN 'medium'
    WHEN crash_probability > 15 THEN 'low' ELSE 'very_low' END AS risk_level,
  CASE WHEN vix > 30 THEN 'high' WHEN vix > 20 THEN 'medium' ELSE 'low' END AS volatility_condition,
  CASE WHEN interest_rate > 4 THEN 'high' WHEN interest_rate > 2 THEN 'medium' ELSE 'low' END AS rate_condition,
  CASE WHEN crash_probability > 60 THEN 'Consider reducing equity exposure;Increase allocation to defensive assets;Implement stop-loss orders'
    WHEN crash_probability > 40 THEN 'Monitor market conditions closely;Consider hedging strategies'
    ELSE 'Market conditions appear stable;Continue with current strategy' END AS advice FROM c""", "index_bars", "macro",
    doubles=("vix", "interest_rate", "dollar_strength", "momentum_20", "crash_probability")))
def q_crash_score(spark, sf_dir):
    """Crash probability, level, conditions and advice per month."""
    out = scr.crash_score(fx.market_months(spark, sf_dir))
    return rounded(out.withColumn("advice", F.concat_ws(";", "advice")))


def _n(field: str, default: int = 0) -> str:
    return f'COALESCE("{field}", {default})'


def _sql_ratios() -> str:
    same = {"pe_ratio": "trailingPE", "forward_pe": "forwardPE", "peg_ratio": "pegRatio", "price_to_book": "priceToBook",
            "price_to_sales": "priceToSalesTrailing12Months", "price_to_cashflow": "priceToCashflow", "gross_margin": "grossMargins",
            "operating_margin": "operatingMargins", "profit_margin": "profitMargins", "return_on_equity": "returnOnEquity",
            "return_on_assets": "returnOnAssets", "return_on_invested_capital": "returnOnInvestedCapital", "current_ratio": "currentRatio",
            "quick_ratio": "quickRatio", "debt_to_equity": "debtToEquity", "revenue_growth": "revenueGrowth",
            "earnings_growth": "earningsGrowth", "dividend_yield": "dividendYield", "payout_ratio": "payoutRatio"}
    over = {"cash_ratio": ("totalCash", "totalCurrentLiabilities"), "debt_to_assets": ("totalDebt", "totalAssets"),
            "asset_turnover": ("revenue", "totalAssets"), "inventory_turnover": ("costOfRevenue", "inventory"),
            "receivables_turnover": ("revenue", "netReceivables")}
    cols = [f"{_n(f)} AS {r}" for r, f in same.items()]
    cols += [f"{_n(a)} / NULLIF({_n(b, 1)}, 0) AS {r}" for r, (a, b) in over.items()]
    cols += [f"{_n('operatingCashflow')} / GREATEST({_n('interestExpense', 1)}, 1) AS interest_coverage",
             f"{_n('bookValue')} / NULLIF({_n('bookValue', 1)}, 0) - 1 AS book_value_growth",
             f"{_n('dividendRate')} / GREATEST({_n('dividendRate', 1)}, 1) - 1 AS dividend_growth"]
    return ", ".join(cols)


@query("fundamental_ratios", Q(f"SELECT symbol, {_sql_ratios()} FROM company_info", "company_info", doubles=tuple(fu.fundamental_ratios_names())))
def q_fundamental_ratios(spark, sf_dir):
    """27 ratios per company."""
    return rounded(fx.company_info(spark, sf_dir).select("symbol", *[c.alias(n) for n, c in fu.fundamental_ratios().items()]))


_VIEW = {"valuation_metrics": "trailingPE forwardPE pegRatio priceToBook priceToSalesTrailing12Months enterpriseValue marketCap",
         "profitability_metrics": "grossMargins operatingMargins profitMargins returnOnEquity returnOnAssets",
         "growth_metrics": "revenueGrowth earningsGrowth quarterlyRevenueGrowth quarterlyEarningsGrowth",
         "financial_health": "debtToEquity currentRatio quickRatio totalCashPerShare",
         "dividend_info": "dividendYield dividendRate payoutRatio"}


@query("fundamental_view", Q("SELECT symbol, " + ", ".join(
    "concat_ws(',', " + ", ".join(f"CAST(FLOOR({_n(f)} * 8) AS BIGINT)" for f in fields.split()) + f") AS {g}"
    for g, fields in _VIEW.items()) + " FROM company_info", "company_info"))
def q_fundamental_view(spark, sf_dir):
    """The five groups of a company's view, each listed in eighths."""
    view = fx.company_info(spark, sf_dir).select("symbol", fu.fundamental_view().alias("v"))
    groups = view.schema["v"].dataType
    listed = lambda g: F.concat_ws(",", *[F.floor(F.col(f"v.{g.name}.{c}") * 8).cast("string") for c in g.dataType.names])
    return view.select("symbol", *[listed(g).alias(g.name) for g in groups])


_SCORED = Q(f"""SELECT b.symbol, b.ts, COALESCE(n.s, 50.0) AS sentiment_score, COALESCE(n.c, 0) AS news_count FROM bars b
LEFT JOIN (SELECT CAST(symbol AS BIGINT) AS symbol, AVG(score) AS s, CAST(COUNT(*) AS INTEGER) AS c
           FROM (SELECT *, {s_polarity(HEADLINE)} AS score FROM news) GROUP BY 1) n ON n.symbol = b.symbol""", "bars", "news", doubles=("sentiment_score",))


@query("attach_news_sentiment", _SCORED)
def q_attach_news_sentiment(spark, sf_dir):
    """The mean score of a symbol's articles on every bar."""
    return rounded(align.attach_sentiment(fx.bars(spark, sf_dir), _news_scores(spark, sf_dir)).select("symbol", "ts", "sentiment_score", "news_count"))


def _rsi_sql(*sizes: int) -> str:
    """Plain RSI of several lengths."""
    means = ", ".join(f"{fr('AVG', x, n)} AS {x}{n}" for n in sizes for x in "gl")
    value = ", ".join(f"CASE WHEN l{n} = 0 THEN (CASE WHEN g{n} > 0 THEN 100.0 END) ELSE 100.0 - 100.0 / (1.0 + g{n} / l{n}) END AS rsi_{n}" for n in sizes)
    return Q(f"WITH {BASE},\ngl AS (SELECT *, {_G} AS g, {_L} AS l FROM br),\nra AS (SELECT symbol, ts, {means} FROM gl {W})\nSELECT symbol, ts, {value} FROM ra",
             "bars", doubles=[f"rsi_{n}" for n in sizes])


def _wide_sql() -> str:
    """The oracles of the single indicators side by side, missing values 0."""
    one = catalog.ORACLE
    parts = [(Q("SELECT symbol, ts, open, high, low, close, volume FROM bars", "bars", doubles=("open", "high", "low", "close", "volume")),
              "open high low close volume"), (one["asof_ffill"], "cpi cpi_change"), (one["sma"], "sma_5 sma_10 sma_20 sma_50 sma_100 sma_200"),
             (one["ema_adjusted"], "ema_5 ema_10 ema_12 ema_20 ema_26 ema_50"), (one["macd"], "macd macd_signal macd_hist"),
             (_rsi_sql(7, 14, 21), "rsi_7 rsi_14 rsi_21"), (one["bollinger"], "bb_mid_20 bb_upper_20 bb_lower_20"), (one["bb_position"], "bb_position_20"),
             (one["bb_width"], "bb_width_20"), (one["stochastic"], "stoch_k_14 stoch_d_14"), (one["williams_r"], "williams_r_14"), (one["atr"], "atr_14"),
             (one["obv"], "obv"), (one["momentum"], "momentum_1 momentum_5 momentum_10 momentum_20"),
             (one["rolling_volatility"], "volatility_5 volatility_10 volatility_20"), (one["bar_shape"], "high_low_ratio close_open_ratio price_change volume_change"),
             (one["volume_sma"], "volume_sma_20 volume_ratio_20"), (one["forward_return"], "fwd_return_1"), (one["forward_direction"], "fwd_direction fwd_volatility_5"),
             (one["attach_fundamentals"], "trailing_pe profit_margin revenue_growth debt_to_equity current_ratio beta market_cap"),
             (_SCORED, "sentiment_score news_count")]
    ctes = ",\n".join(f"i{k} AS MATERIALIZED (SELECT symbol, ts, {', '.join(cols.split())} FROM (\n{sql}\n))" for k, (sql, cols) in enumerate(parts))
    cols = ", ".join(f"COALESCE({c}, 0) AS {c}" for _, names in parts for c in names.split())
    return f"WITH {ctes}\nSELECT symbol, ts, {cols} FROM i0 " + " ".join(f"JOIN i{k} USING (symbol, ts)" for k in range(1, len(parts)))


@query("wide_feature_table", _wide_sql())
def q_wide_feature_table(spark, sf_dir):
    """M2: indicators, fundamentals, news, macro and three targets per bar."""
    return rounded(ml.wide_feature_table(fx.bars(spark, sf_dir), fx.fundamentals(spark, sf_dir), _news_scores(spark, sf_dir), fx.macro(spark, sf_dir)))


_BLEND = f"""WITH short AS ({_linear_sql()}),
slow AS ({_linear_sql(decay=0.995)}),
drifts AS (WITH {_DRIFT} SELECT symbol, day, predicted FROM drift)
SELECT symbol, day, 0.4 * short.predicted + 0.3 * drifts.predicted + 0.3 * slow.predicted AS predicted
FROM short JOIN drifts USING (symbol, day) JOIN slow USING (symbol, day)"""


@query("forecast_blend", Q(_BLEND, "bars", doubles=("predicted",)))
def q_forecast_blend(spark, sf_dir):
    """M16 over given paths: the six-feature linear path with two decays and the drift."""
    bars = fx.bars(spark, sf_dir)
    moments = ml.linear_moments(bars)
    return rounded(ml.forecast_ensemble([(0.4, ml.forecast_linear(bars, 30, moments=moments)), (0.3, fc.forecast_drift(bars, 30)),
                                         (0.3, ml.forecast_linear(bars, 30, decay=0.995, moments=moments))]))


@query("forecast_ensemble")
def q_forecast_ensemble(spark, sf_dir):
    """0.4 short linear + 0.3 drift + 0.3 all-feature linear, 30 days."""
    bars = fx.bars(spark, sf_dir)
    moments = ml.linear_moments(bars)
    return ml.forecast_ensemble([(0.4, ml.forecast_linear(bars, 30, moments=moments)), (0.3, fc.forecast_drift(bars, 30)),
                                 (0.3, ml.forecast_linear(bars, 30, decay=0.995, features=ml.ALL_LINEAR_FEATURES, moments=moments))])


@query("key_levels", Q(f"""WITH {BASE},
e AS (SELECT *, rn > 0 AND rn < n - 1 AND close > COALESCE(MAX(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '-inf')
        AND close > COALESCE(MAX(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '-inf') AS top,
      rn > 0 AND rn < n - 1 AND close < COALESCE(MIN(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 'inf')
        AND close < COALESCE(MIN(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 'inf') AS bottom FROM br {W}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, top ORDER BY rn DESC) AS t, ROW_NUMBER() OVER (PARTITION BY symbol, bottom ORDER BY rn DESC) AS b FROM e)
SELECT symbol, COALESCE(string_agg(CAST(CAST(ROUND(close * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (top AND t <= 3), '') AS resistance_levels,
  COALESCE(string_agg(CAST(CAST(ROUND(close * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (bottom AND b <= 3), '') AS support_levels,
  arg_max(close, rn) AS current_price FROM r GROUP BY symbol""", "bars", doubles=("current_price",)))
def q_key_levels(spark, sf_dir):
    """Last three local maxima and minima per symbol, listed in cents."""
    out = ind.key_levels(fx.bars(spark, sf_dir))
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")))
    return rounded(out.withColumn("resistance_levels", listed(F.col("resistance_levels"))).withColumn("support_levels", listed(F.col("support_levels"))))


@query("key_insights", Q(f"""WITH {BASE},
l AS (SELECT symbol, arg_max(close / c30 - 1, rn) AS m, 50.0 + MAX(symbol % 5) * 12.5 AS risk, 20.0 + MAX(symbol % 7) * 10 AS mood
      FROM (SELECT *, LAG(close, 30) OVER w AS c30 FROM br {W}) GROUP BY symbol)
SELECT symbol, array_to_string(list_filter([CASE WHEN m > 0.02 THEN 'AI predicts bullish price movement for ' || symbol
    WHEN m < -0.02 THEN 'AI predicts bearish price movement for ' || symbol END,
  CASE WHEN m > 0.02 THEN 'Strong upward trend detected by AI models' WHEN m < -0.02 THEN 'Downward trend detected by AI models' END,
  CASE WHEN risk > 50 THEN 'High risk detected - consider position sizing' WHEN risk <= 30 THEN 'Low risk profile - suitable for conservative investors' END,
  CASE WHEN mood >= 60 THEN 'Positive market sentiment detected' WHEN mood < 40 THEN 'Negative market sentiment detected' END,
  'Analysis based on comprehensive AI models trained on market data', 'Recommendations should be combined with your own research'],
  lambda x: x IS NOT NULL)[1:5], ' | ') AS insights FROM l""", "bars"))
def q_key_insights(spark, sf_dir):
    """Insight sentences per symbol from its latest 30-row return and
    stand-in risk and sentiment scores."""
    p = ind.momentum(series.prepare(fx.bars(spark, sf_dir)), 30)
    last = series.finish(ind.latest_row(p))
    move = sg.price_direction("momentum_30")
    trend = F.when(F.col("momentum_30") > 0.02, F.lit("strong_uptrend")).when(F.col("momentum_30") < -0.02, F.lit("downtrend")).otherwise(F.lit("sideways"))
    risk = sg.risk_level(F.lit(50.0) + (F.col("symbol") % 5) * 12.5)
    mood = sg.sentiment_label(F.lit(20.0) + (F.col("symbol") % 7) * 10.0)
    said = last.select("symbol", move.alias("p"), trend.alias("t"), risk.alias("r"), mood.alias("s"))
    return said.select("symbol", F.concat_ws(" | ", sg.key_insights("symbol", "p", "t", "r", "s")).alias("insights"))
