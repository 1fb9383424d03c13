"""Scalar signal, label and formatting functions.

All are Column builders: they compose into whole-stage codegen, no UDFs.
Comparisons against null fall through to the last branch, like pandas NaN
comparisons in the reference (NaN > x is False).
Thresholds are the fixed values of SURVEY section 9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_d(v: float) -> Column:
    return F.lit(float(v))


def clamp(x, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Bound to [lo, hi]; null stays null."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(lit_d(lo), F.least(lit_d(hi), x.cast("double"))))


def ma_signal(close, sma20, sma50) -> Column:
    """X5 label: bullish if close > SMA20 > SMA50, bearish if close < SMA20 < SMA50."""
    c, a, b = _c(close), _c(sma20), _c(sma50)
    return (F.when((c > a) & (a > b), F.lit("bullish"))
            .when((c < a) & (a < b), F.lit("bearish"))
            .otherwise(F.lit("neutral")))


def ma_strength(close, sma20, sma50) -> Column:
    """X5 strength: min(100, |close - SMA50| / SMA50 * 1000) when not neutral."""
    c, b = _c(close), _c(sma50)
    s = F.least(lit_d(100), F.abs(c - b) / b * 1000.0)
    return F.when(ma_signal(close, sma20, sma50) != "neutral", s).otherwise(lit_d(0))


def macd_signal_label(line, signal) -> Column:
    """Bullish if line > signal, bearish if below, else neutral."""
    m, s = _c(line), _c(signal)
    return F.when(m > s, F.lit("bullish")).when(m < s, F.lit("bearish")).otherwise(F.lit("neutral"))


def macd_strength(line, signal) -> Column:
    m, s = _c(line), _c(signal)
    return F.when((m > s) | (m < s), F.least(lit_d(100), F.abs(m - s) * 1000.0)).otherwise(lit_d(0))


def rsi_signal(rsi) -> Column:
    """Overbought > 70, oversold < 30."""
    r = _c(rsi)
    return F.when(r > 70, F.lit("overbought")).when(r < 30, F.lit("oversold")).otherwise(F.lit("neutral"))


def rsi_strength(rsi) -> Column:
    r = _c(rsi)
    return (F.when(r > 70, F.least(lit_d(100), (r - 70) * 3.33))
            .when(r < 30, F.least(lit_d(100), (30 - r) * 3.33)).otherwise(lit_d(0)))


def bb_signal(close, upper, lower) -> Column:
    """Overbought above the upper band, oversold below the lower band."""
    c, u, lo = _c(close), _c(upper), _c(lower)
    return F.when(c > u, F.lit("overbought")).when(c < lo, F.lit("oversold")).otherwise(F.lit("neutral"))


def bb_strength(close, upper, lower) -> Column:
    c, u, lo = _c(close), _c(upper), _c(lower)
    return (F.when(c > u, F.least(lit_d(100), (c - u) / u * 1000.0))
            .when(c < lo, F.least(lit_d(100), (lo - c) / lo * 1000.0)).otherwise(lit_d(0)))


def trend_label(strength) -> Column:
    """A8 buckets: >5 strong_uptrend, >1 uptrend, <-5 strong_downtrend, <-1 downtrend."""
    s = _c(strength)
    return (F.when(s > 5, F.lit("strong_uptrend")).when(s > 1, F.lit("uptrend"))
            .when(s < -5, F.lit("strong_downtrend")).when(s < -1, F.lit("downtrend"))
            .otherwise(F.lit("sideways")))


def vote_signals(sma20, sma50, rsi, macd, macd_signal, bb_position, stoch_k, stoch_d) -> Column:
    """Five signals (SMA20 vs SMA50, RSI 70/30, MACD vs signal, BB
    position .8/.2, stochastic %K and %D both beyond 80/20) and a majority
    vote of bullish+oversold against bearish+overbought.
    Returns struct(ma, rsi, macd, bb, stoch, bullish, bearish, overall)."""
    a, b, r, m, s, p, k, d = (_c(x) for x in (sma20, sma50, rsi, macd, macd_signal, bb_position, stoch_k, stoch_d))
    neutral = F.lit("neutral")
    ma = F.when(a > b, F.lit("bullish")).when(a < b, F.lit("bearish")).otherwise(neutral)
    rs = F.when(r > 70, F.lit("overbought")).when(r < 30, F.lit("oversold")).otherwise(neutral)
    md = F.when(m > s, F.lit("bullish")).when(m < s, F.lit("bearish")).otherwise(neutral)
    bb = F.when(p > 0.8, F.lit("overbought")).when(p < 0.2, F.lit("oversold")).otherwise(neutral)
    st = (F.when((k > 80) & (d > 80), F.lit("overbought")).when((k < 20) & (d < 20), F.lit("oversold"))
          .otherwise(neutral))
    arr = F.array(ma, rs, md, bb, st)
    bull = F.size(F.filter(arr, lambda x: x.isin("bullish", "oversold")))
    bear = F.size(F.filter(arr, lambda x: x.isin("bearish", "overbought")))
    overall = F.when(bull > bear, F.lit("bullish")).when(bear > bull, F.lit("bearish")).otherwise(neutral)
    return F.struct(ma.alias("ma_signal"), rs.alias("rsi_signal"), md.alias("macd_signal"), bb.alias("bb_signal"),
                    st.alias("stoch_signal"), bull.alias("bullish"), bear.alias("bearish"),
                    overall.alias("overall_signal"))


def sentiment_label(score, strict: bool = False) -> Column:
    """70/60/40/30 bands (>=); the model variant uses strict >."""
    s = _c(score)
    ge = (lambda v: s > v) if strict else (lambda v: s >= v)
    return (F.when(ge(70), F.lit("very_positive")).when(ge(60), F.lit("positive"))
            .when(ge(40), F.lit("neutral")).when(ge(30), F.lit("negative"))
            .otherwise(F.lit("very_negative")))


def sentiment_trend_label(score) -> Column:
    """70/60/50/40 bands."""
    s = _c(score)
    return (F.when(s >= 70, F.lit("bullish")).when(s >= 60, F.lit("slightly_bullish"))
            .when(s >= 50, F.lit("neutral")).when(s >= 40, F.lit("slightly_bearish"))
            .otherwise(F.lit("bearish")))


def news_trend(score) -> Column:
    """±0.1 around 0 for a [-1, 1] polarity."""
    s = _c(score)
    return F.when(s > 0.1, F.lit("positive")).when(s < -0.1, F.lit("negative")).otherwise(F.lit("neutral"))


# Analyst grade -> score.
GRADE_SCORES = {
    "strong buy": 80.0, "buy": 80.0,
    "outperform": 70.0, "positive": 70.0,
    "hold": 50.0, "neutral": 50.0, "market perform": 50.0,
    "underperform": 30.0, "negative": 30.0,
    "sell": 20.0, "strong sell": 20.0,
}


def grade_to_score(grade) -> Column:
    """Lower-cased grade looked up in a literal map; other grades 50."""
    m = F.create_map(*[x for k, v in GRADE_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(F.trim(_c(grade)))), lit_d(50))


def consensus_label(score) -> Column:
    """>=70 Buy, >=60 Outperform, >=40 Hold, >=30 Underperform, else Sell."""
    s = _c(score)
    return (F.when(s >= 70, F.lit("Buy")).when(s >= 60, F.lit("Outperform"))
            .when(s >= 40, F.lit("Hold")).when(s >= 30, F.lit("Underperform")).otherwise(F.lit("Sell")))


def recommendation(score, model: bool = False) -> Column:
    """X11: 80/65/50/35 (model variant 85/70/55/40)."""
    s = _c(score)
    t = (85, 70, 55, 40) if model else (80, 65, 50, 35)
    return (F.when(s >= t[0], F.lit("Strong Buy")).when(s >= t[1], F.lit("Buy"))
            .when(s >= t[2], F.lit("Hold")).when(s >= t[3], F.lit("Sell")).otherwise(F.lit("Strong Sell")))


def _levels(x: Column, t) -> Column:
    return (F.when(x > t[0], F.lit("very_high")).when(x > t[1], F.lit("high")).when(x > t[2], F.lit("medium"))
            .when(x > t[3], F.lit("low")).otherwise(F.lit("very_low")))


def risk_level(score) -> Column:
    """70/50/30/15 on a 0..100 risk score (strict >)."""
    return _levels(_c(score), (70, 50, 30, 15))


def vol_risk(vol) -> Column:
    """Predicted volatility .4/.3/.2/.1."""
    return _levels(_c(vol), (0.4, 0.3, 0.2, 0.1))


def crash_risk(score) -> Column:
    """Crash probability 70/50/30/15."""
    return _levels(_c(score), (70, 50, 30, 15))


def letter_grade(score) -> Column:
    """A+ .. F above 80/70/60/50/40/30/20 (strict >)."""
    s = _c(score)
    return (F.when(s > 80, F.lit("A+")).when(s > 70, F.lit("A")).when(s > 60, F.lit("B+"))
            .when(s > 50, F.lit("B")).when(s > 40, F.lit("C+")).when(s > 30, F.lit("C"))
            .when(s > 20, F.lit("D")).otherwise(F.lit("F")))


def fundamental_points(expected_return) -> Column:
    """Fundamental score (ret + 0.2) * 250 clamped to 0..100."""
    return clamp((_c(expected_return) + 0.2) * 250.0)


def trend_bucket(prob) -> Column:
    """Trend label from an up-probability .7/.6 (up) and .3/.4 (down)."""
    p = _c(prob)
    return (F.when(p > 0.7, F.lit("strong_uptrend")).when(p > 0.6, F.lit("uptrend"))
            .when(p < 0.3, F.lit("strong_downtrend")).when(p < 0.4, F.lit("downtrend"))
            .otherwise(F.lit("sideways")))


def trend_bucket_strength(prob) -> Column:
    """P for up buckets, 1 - p for down buckets, 0.5 sideways."""
    p = _c(prob)
    return F.when(p > 0.6, p).when(p < 0.4, F.lit(1.0) - p).otherwise(F.lit(0.5))


def price_direction(ret, band: float = 0.02) -> Column:
    """Bullish / bearish beyond ±2 %, else neutral."""
    r = _c(ret)
    return F.when(r > band, F.lit("bullish")).when(r < -band, F.lit("bearish")).otherwise(F.lit("neutral"))


def prob_direction(prob) -> Column:
    """X14 regressor-probability variant: .6 / .4."""
    p = _c(prob)
    return F.when(p > 0.6, F.lit("bullish")).when(p < 0.4, F.lit("bearish")).otherwise(F.lit("neutral"))


def prob_confidence(prob) -> Column:
    """P above .6, 1 - p below .4, else .5."""
    return trend_bucket_strength(prob)


def confidence(x, k: float, center: float = 0.0) -> Column:
    """clamp(|x - center| * k + 0.5, .1, .95)."""
    return clamp(F.abs(_c(x) - center) * k + 0.5, 0.1, 0.95)


def insights(*conds_and_texts) -> Column:
    """Ordered list of the sentences whose condition holds, first 5."""
    parts = [F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in conds_and_texts]
    return F.slice(F.array_compact(F.array(*parts)), 1, 5)


# The sentences of X16.
INSIGHT_PRICE = {"bullish": "AI predicts bullish price movement for ", "bearish": "AI predicts bearish price movement for "}
INSIGHT_TREND = {"uptrend": "Strong upward trend detected by AI models", "downtrend": "Downward trend detected by AI models"}
INSIGHT_RISK = {"high": "High risk detected - consider position sizing",
                "low": "Low risk profile - suitable for conservative investors"}
INSIGHT_MOOD = {"positive": "Positive market sentiment detected", "negative": "Negative market sentiment detected"}
INSIGHT_GENERAL = ["Analysis based on comprehensive AI models trained on market data",
                   "Recommendations should be combined with your own research"]


def key_insights(symbol, price, trend, risk, sentiment) -> Column:
    """The sentences for a symbol's labels, then the general ones, first 5."""
    said = [(_c(price) == k, F.concat(F.lit(t), _c(symbol).cast("string"))) for k, t in INSIGHT_PRICE.items()]
    for label, prefixes, sentences in ((trend, ("", "strong_"), INSIGHT_TREND), (risk, ("", "very_"), INSIGHT_RISK),
                                       (sentiment, ("", "very_"), INSIGHT_MOOD)):
        said += [(_c(label).isin([p + k for p in prefixes]), F.lit(t)) for k, t in sentences.items()]
    return insights(*said, *[(F.lit(True), F.lit(t)) for t in INSIGHT_GENERAL])


def human_number(x) -> Column:
    """B / M / K formatting with one decimal from 1e9 / 1e6 / 1e3 on,
    two decimals below (so for every negative number)."""
    v = _c(x).cast("double")
    return (F.when(v >= 1e9, F.format_string("%.1fB", v / 1e9))
            .when(v >= 1e6, F.format_string("%.1fM", v / 1e6))
            .when(v >= 1e3, F.format_string("%.1fK", v / 1e3))
            .when(v.isNotNull(), F.format_string("%.2f", v)))


def forecast_date(last_ts, day) -> Column:
    """Last date + day calendar days, ISO text."""
    return F.date_format(F.date_add(_c(last_ts), _c(day)), "yyyy-MM-dd")


def horizon_price(price, ret, day) -> Column:
    """Price * (1 + ret * day / 30)."""
    return _c(price) * (F.lit(1.0) + _c(ret) * _c(day) / 30.0)


def horizon_confidence(conf, day) -> Column:
    """Confidence * (1 - day / 100)."""
    return _c(conf) * (F.lit(1.0) - _c(day) / 100.0)


def parse_date(text) -> Column:
    """YYYY-MM-DD text to DATE, null when unparsable."""
    return F.try_to_date(_c(text), "yyyy-MM-dd")
