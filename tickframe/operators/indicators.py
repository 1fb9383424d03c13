"""Window indicators over bar series.

Every function appends columns to a bar frame (symbol, ts, open, high, low,
close, volume).  Given a raw frame, it prepares the series layout, computes
and drops the helper columns; given a frame from ``series.prepare`` it just
appends, so a pipeline of indicators shares one layout and one exchange.

Null rules follow pandas (SURVEY section 8): ``rolling(n)`` is null until the
frame holds n values (Q2), divisions by zero give null (Q1), true range is
null on the first row (Q4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.ranking import top_n_per_key
from tickframe.operators.series import (BY, N, RN, TS, ewm, ewm_all, finish, full_rows, lag, lead, prepare, rolling_std, rows, running,
                                        running_all, series_op)


def _c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def div(a: Column, b: Column) -> Column:
    """a / b with null for a zero or null divisor (ANSI-safe)."""
    return F.try_divide(a, b)


def pct_change(x: Column, k: int = 1, by: str = BY) -> Column:
    return div(x, lag(x, k, by)) - F.lit(1.0)


# ------------------------------------------------------------------ moving averages
@series_op
def sma(df: DataFrame, n: int, col: str = "close", *, by: str = BY, name: str | None = None) -> DataFrame:
    """Rolling mean of ``col`` over n rows (null until n rows)."""
    x = _c(col)
    return df.withColumn(name or f"sma_{n}", full_rows(n, F.avg(x), x, by))


@series_op
def ema_adjusted(df: DataFrame, span: int, col: str = "close", *, by: str = BY,
                 name: str | None = None) -> DataFrame:
    """Pandas ``ewm(span).mean()`` (adjust=True)."""
    return ewm(df, _c(col), alpha=2.0 / (span + 1), adjust=True, name=name or f"ema_{span}", by=by)


@series_op
def ema_recursive(df: DataFrame, span: int, col: str = "close", *, by: str = BY,
                  name: str | None = None) -> DataFrame:
    """Recursive EMA (adjust=False), first span-1 rows null."""
    return ewm(df, _c(col), alpha=2.0 / (span + 1), adjust=False, min_periods=span,
               name=name or f"ema_rec_{span}", by=by)


@series_op
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, by: str = BY) -> DataFrame:
    """line = EMA(fast) - EMA(slow), signal = EMA(signal) of the line,
    histogram = line - signal; all adjusted EWMs from the first row."""
    close = F.col("close")
    out = ewm_all(df, [(close, 2.0 / (fast + 1), "_macd_f"), (close, 2.0 / (slow + 1), "_macd_s")], adjust=True, by=by)
    out = out.withColumn("macd", F.col("_macd_f") - F.col("_macd_s"))
    out = ewm(out, F.col("macd"), alpha=2.0 / (signal + 1), adjust=True, name="macd_signal", by=by)
    return (out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
            .drop("_macd_f", "_macd_s"))


@series_op
def macd_recursive(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *,
                   by: str = BY) -> DataFrame:
    """Recursive MACD.  ``macd_rec`` is the line, ``macd_rec_signal`` the
    recursive EMA(signal) of the line starting where the line starts (row
    slow-1), ``macd_rec_diff`` the histogram (the reference's 'MACD' column)."""
    close = F.col("close")
    out = ewm_all(df, [(close, 2.0 / (fast + 1), "_mr_f"), (close, 2.0 / (slow + 1), "_mr_s")], adjust=False,
                  min_periods=[fast, slow], by=by)
    out = out.withColumn("macd_rec", F.col("_mr_f") - F.col("_mr_s"))
    out = ewm(out, F.col("macd_rec"), alpha=2.0 / (signal + 1), adjust=False, start=slow - 1,
              min_periods=signal, name="macd_rec_signal", by=by)
    return (out.withColumn("macd_rec_diff", F.col("macd_rec") - F.col("macd_rec_signal"))
            .drop("_mr_f", "_mr_s"))


# ------------------------------------------------------------------ RSI
def _gain_loss(by: str):
    delta = F.col("close") - lag("close", 1, by)
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    return gain, loss


@series_op
def rsi_sma(df: DataFrame, n: int = 14, *, by: str = BY, name: str | None = None) -> DataFrame:
    """100 - 100/(1 + SMA(gain)/SMA(loss)); first Δ counts as 0 (Q3)."""
    gain, loss = _gain_loss(by)
    out = df.withColumn("_g", gain).withColumn("_l", loss)
    g = full_rows(n, F.avg("_g"), F.col("_g"), by)
    lo = full_rows(n, F.avg("_l"), F.col("_l"), by)
    out = out.withColumn("_ag", g).withColumn("_al", lo)
    rsi = (F.when(F.col("_al") == 0, F.when(F.col("_ag") > 0, F.lit(100.0)))
           .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + div(F.col("_ag"), F.col("_al")))))
    return out.withColumn(name or f"rsi_{n}", rsi).drop("_g", "_l", "_ag", "_al")


@series_op
def rsi_wilder(df: DataFrame, n: int = 14, *, by: str = BY, name: str | None = None) -> DataFrame:
    """Wilder RSI (recursive EWM, alpha = 1/n, min_periods n); 100 when the
    loss average is exactly 0."""
    gain, loss = _gain_loss(by)
    out = df.withColumn("_g", gain).withColumn("_l", loss)
    out = ewm_all(out, [(F.col("_g"), 1.0 / n, "_eg"), (F.col("_l"), 1.0 / n, "_el")], adjust=False, min_periods=n, by=by)
    rsi = (F.when(F.col("_el").isNull(), F.lit(None).cast("double"))
           .when(F.col("_el") == 0, F.lit(100.0))
           .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("_eg") / F.col("_el"))))
    return out.withColumn(name or f"rsi_wilder_{n}", rsi).drop("_g", "_l", "_eg", "_el")


# ------------------------------------------------------------------ bands and oscillators
def _bands(df: DataFrame, n: int, k: float, std_fn, prefix: str, by: str) -> DataFrame:
    x = F.col("close")
    mid = full_rows(n, F.avg(x), x, by)
    sd = full_rows(n, std_fn(x), x, by)
    out = df.withColumn(f"{prefix}_mid_{n}", mid).withColumn("_sd", sd)
    return (out.withColumn(f"{prefix}_upper_{n}", F.col(f"{prefix}_mid_{n}") + F.col("_sd") * k)
            .withColumn(f"{prefix}_lower_{n}", F.col(f"{prefix}_mid_{n}") - F.col("_sd") * k)
            .drop("_sd"))


@series_op
def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, *, by: str = BY) -> DataFrame:
    """SMA(n) ± k · sample std."""
    return _bands(df, n, k, F.stddev_samp, "bb", by)


@series_op
def bollinger_pop(df: DataFrame, n: int = 20, k: float = 2.0, *, by: str = BY) -> DataFrame:
    """SMA(n) ± k · population std (the `ta` bands)."""
    return _bands(df, n, k, F.stddev_pop, "bbp", by)


def bb_width(df: DataFrame, n: int = 20, prefix: str = "bb") -> DataFrame:
    """(upper - lower) / mid."""
    return df.withColumn(f"{prefix}_width_{n}",
                         div(F.col(f"{prefix}_upper_{n}") - F.col(f"{prefix}_lower_{n}"),
                             F.col(f"{prefix}_mid_{n}")))


def bb_position(df: DataFrame, n: int = 20, prefix: str = "bb") -> DataFrame:
    """(close - lower) / (upper - lower)."""
    return df.withColumn(f"{prefix}_position_{n}",
                         div(F.col("close") - F.col(f"{prefix}_lower_{n}"),
                             F.col(f"{prefix}_upper_{n}") - F.col(f"{prefix}_lower_{n}")))


@series_op
def stochastic(df: DataFrame, n: int = 14, d: int = 3, *, by: str = BY) -> DataFrame:
    """%K = 100 (close - Ln)/(Hn - Ln); %D = SMA(d) of %K."""
    lo = full_rows(n, F.min("low"), F.col("low"), by)
    hi = full_rows(n, F.max("high"), F.col("high"), by)
    out = df.withColumn("_lo", lo).withColumn("_hi", hi)
    out = out.withColumn(f"stoch_k_{n}",
                         F.lit(100.0) * div(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    k = F.col(f"stoch_k_{n}")
    return out.withColumn(f"stoch_d_{n}", full_rows(d, F.avg(k), k, by)).drop("_lo", "_hi")


@series_op
def williams_r(df: DataFrame, n: int = 14, *, by: str = BY) -> DataFrame:
    """-100 (Hn - close)/(Hn - Ln)."""
    lo = full_rows(n, F.min("low"), F.col("low"), by)
    hi = full_rows(n, F.max("high"), F.col("high"), by)
    return df.withColumn(f"williams_r_{n}",
                         F.lit(-100.0) * div(hi - F.col("close"), hi - lo))


@series_op
def atr(df: DataFrame, n: int = 14, *, by: str = BY) -> DataFrame:
    """Mean true range; the first row's true range is null (Q4)."""
    pc = lag("close", 1, by)
    tr = F.when(pc.isNotNull(),
                F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    out = df.withColumn("_tr", tr)
    return out.withColumn(f"atr_{n}", full_rows(n, F.avg("_tr"), F.col("_tr"), by)).drop("_tr")


@series_op
def volume_sma(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Rolling mean volume (current row included) and volume / that mean."""
    v = F.col("volume")
    out = df.withColumn(f"volume_sma_{n}", full_rows(n, F.avg(v), v, by))
    return out.withColumn(f"volume_ratio_{n}", div(v, F.col(f"volume_sma_{n}")))


@series_op
def volume_ratio_prior(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Volume / mean volume of the previous n rows."""
    w = rows(-n, -1, by)
    prior = F.when(F.count("volume").over(w) == n, F.avg("volume").over(w))
    return df.withColumn(f"volume_ratio_prior_{n}", div(F.col("volume"), prior))


@series_op
def obv(df: DataFrame, *, by: str = BY) -> DataFrame:
    """On-balance volume, cumulative volume · sign(Δclose); first row null."""
    d = F.col("close") - lag("close", 1, by)
    out = df.withColumn("_ov", F.col("volume") * F.signum(d))
    out = running(out, F.col("_ov"), "sum", "obv", by)
    return out.withColumn("obv", F.when(F.col(RN) > 0, F.col("obv"))).drop("_ov")


@series_op
def momentum(df: DataFrame, k: int = 1, col: str = "close", *, by: str = BY) -> DataFrame:
    """Close / close(k rows back) - 1."""
    return df.withColumn(f"momentum_{k}", pct_change(_c(col), k, by))


@series_op
def returns(df: DataFrame, *, by: str = BY, name: str = "ret") -> DataFrame:
    """1-row simple return, the base series of the volatility operators."""
    return df.withColumn(name, pct_change(F.col("close"), 1, by))


@series_op
def rolling_volatility(df: DataFrame, n=20, *, by: str = BY) -> DataFrame:
    """Sample std of 1-row returns over n rows (null until n returns);
    several lengths n share their moments."""
    out = df if "ret" in df.columns else df.withColumn("ret", pct_change(F.col("close"), 1, by))
    out = rolling_std(out, "ret", {k: f"volatility_{k}" for k in ([n] if isinstance(n, int) else n)}, by)
    return out if "ret" in df.columns else out.drop("ret")


@series_op
def price_std(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Sample std of the close level over n rows."""
    x = F.col("close")
    return df.withColumn(f"price_std_{n}", full_rows(n, F.stddev_samp(x), x, by))


@series_op
def price_std_prior(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Sample std of close over the previous n rows."""
    w = rows(-n, -1, by)
    return df.withColumn(f"price_std_prior_{n}",
                         F.when(F.count("close").over(w) == n, F.stddev_samp("close").over(w)))


@series_op
def support_resistance(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Rolling max high / min low and % distance of close to each."""
    res = full_rows(n, F.max("high"), F.col("high"), by)
    sup = full_rows(n, F.min("low"), F.col("low"), by)
    out = df.withColumn(f"resistance_{n}", res).withColumn(f"support_{n}", sup)
    return (out.withColumn(f"dist_support_{n}",
                           div(F.col("close") - F.col(f"support_{n}"), F.col(f"support_{n}")) * 100.0)
            .withColumn(f"dist_resistance_{n}",
                        div(F.col(f"resistance_{n}") - F.col("close"), F.col("close")) * 100.0))


@series_op
def trend_strength(df: DataFrame, n: int = 50, *, by: str = BY) -> DataFrame:
    """(close - SMA n) / SMA n."""
    s = full_rows(n, F.avg("close"), F.col("close"), by)
    return df.withColumn("trend_strength", div(F.col("close") - s, s))


@series_op
def trend_direction(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """+1 if close > SMA n else -1 (null SMA gives -1)."""
    s = full_rows(n, F.avg("close"), F.col("close"), by)
    return df.withColumn("trend_direction",
                         F.when(F.col("close") > s, F.lit(1)).otherwise(F.lit(-1)))


@series_op
def trend_zscore(df: DataFrame, n: int = 50, *, by: str = BY) -> DataFrame:
    """(close - mean n) / std n."""
    x = F.col("close")
    m = full_rows(n, F.avg(x), x, by)
    s = full_rows(n, F.stddev_samp(x), x, by)
    return df.withColumn(f"trend_zscore_{n}", div(x - m, s))


@series_op
def relative_volatility(df: DataFrame, n: int = 20, *, by: str = BY, prior: bool = False) -> DataFrame:
    """std(close)/mean(close) over n rows (or the previous n rows)."""
    x = F.col("close")
    if prior:
        w = rows(-n, -1, by)
        full = F.count(x).over(w) == n
        val = F.when(full, div(F.stddev_samp(x).over(w), F.avg(x).over(w)))
        return df.withColumn(f"relative_volatility_prior_{n}", val)
    return df.withColumn(f"relative_volatility_{n}",
                         div(full_rows(n, F.stddev_samp(x), x, by), full_rows(n, F.avg(x), x, by)))


@series_op
def lag_features(df: DataFrame, lags=(1, 2, 3, 5, 10), *, by: str = BY) -> DataFrame:
    """Close and volume k rows back."""
    out = df
    for k in lags:
        out = (out.withColumn(f"close_lag_{k}", lag("close", k, by))
               .withColumn(f"volume_lag_{k}", lag("volume", k, by)))
    return out


@series_op
def rolling_features(df: DataFrame, windows=(5, 10, 20), *, by: str = BY) -> DataFrame:
    """Close mean/std and volume mean over each window; price/ma20 and
    volume/volume_ma20."""
    out = df
    for n in windows:
        c, v = F.col("close"), F.col("volume")
        out = (out.withColumn(f"close_ma_{n}", full_rows(n, F.avg(c), c, by))
               .withColumn(f"close_std_{n}", full_rows(n, F.stddev_samp(c), c, by))
               .withColumn(f"volume_ma_{n}", full_rows(n, F.avg(v), v, by)))
    if 20 in windows:
        out = (out.withColumn("price_to_ma20", div(F.col("close"), F.col("close_ma_20")))
               .withColumn("volume_to_ma20", div(F.col("volume"), F.col("volume_ma_20"))))
    return out


@series_op
def bar_shape(df: DataFrame, *, by: str = BY) -> DataFrame:
    """high/low, close/open, 1-row price and volume change."""
    return (df.withColumn("high_low_ratio", div(F.col("high"), F.col("low")))
            .withColumn("close_open_ratio", div(F.col("close"), F.col("open")))
            .withColumn("price_change", pct_change(F.col("close"), 1, by))
            .withColumn("volume_change", pct_change(F.col("volume"), 1, by)))


@series_op
def ma_ratio(df: DataFrame, n: int = 20, *, by: str = BY) -> DataFrame:
    """Close / SMA n."""
    s = full_rows(n, F.avg("close"), F.col("close"), by)
    return df.withColumn(f"ma_ratio_{n}", div(F.col("close"), s))


@series_op
def sentiment_from_price(df: DataFrame, *, by: str = BY) -> DataFrame:
    """Per-row price sentiment 0..100 from the 7-row momentum, the volume
    ratio to the previous 20 rows and the relative volatility of the previous
    20 closes; 50 for the first 20 rows of a symbol."""
    m7 = pct_change(F.col("close"), 7, by)
    w = rows(-20, -1, by)
    full = F.count("close").over(w) == 20
    vr = F.when(full, div(F.col("volume"), F.avg("volume").over(w)))
    rv = F.when(full, div(F.stddev_samp("close").over(w), F.avg("close").over(w)))
    out = df.withColumn("_m7", m7).withColumn("_vr", vr).withColumn("_rv", rv)
    mom = F.tanh(F.col("_m7") * 10.0) * 50.0 + 50.0
    vol = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("_vr") - 1.0) * 50.0 + 50.0))
    stab = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("_rv") * 100.0)
    raw = mom * 0.5 + vol * 0.3 + stab * 0.2
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    val = F.when(F.col(RN) < 20, F.lit(50.0)).otherwise(F.coalesce(score, F.lit(50.0)))
    return out.withColumn("price_sentiment", val).drop("_m7", "_vr", "_rv")


@series_op
def local_extrema(df: DataFrame, order: int = 5, *, by: str = BY) -> DataFrame:
    """Strict local max/min of close within ±order rows (edges clipped:
    the first and last row of a symbol never qualify)."""
    before = rows(-order, -1, by)
    after = rows(1, order, by)
    c = F.col("close")
    inner = (F.col(RN) > 0) & (F.col(RN) < F.col(N) - 1)
    is_max = inner & (c > F.coalesce(F.max(c).over(before), F.lit(float("-inf")))) & \
        (c > F.coalesce(F.max(c).over(after), F.lit(float("-inf"))))
    is_min = inner & (c < F.coalesce(F.min(c).over(before), F.lit(float("inf")))) & \
        (c < F.coalesce(F.min(c).over(after), F.lit(float("inf"))))
    return df.withColumn("is_local_max", is_max).withColumn("is_local_min", is_min)


@series_op
def drawdown_series(df: DataFrame, col: str = "close", *, by: str = BY) -> DataFrame:
    """(p - running max p) / running max p."""
    out = running(df, _c(col), "max", "_runmax", by)
    return out.withColumn("drawdown", div(_c(col) - F.col("_runmax"), F.col("_runmax"))).drop("_runmax")


@series_op
def cumulative_return(df: DataFrame, col: str = "ret", *, by: str = BY) -> DataFrame:
    """prod(1 + r) - 1 over the rows so far (null returns skipped).

    Computed as exp(sum(log|1+r|)) with the sign from the count of negative
    factors and a zero when any factor is 0; all three are running sums.
    """
    r = _c(col)
    f = F.lit(1.0) + r
    out = running_all(df, [(F.when(f != 0, F.log(F.abs(f))), "sum", "_lg"),
                           (F.when(f < 0, F.lit(1)).otherwise(F.lit(0)), "sum", "_neg"),
                           (F.when(f == 0, F.lit(1)).otherwise(F.lit(0)), "sum", "_zero")], by)
    sign = F.when(F.col("_neg") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    val = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(sign * F.exp(F.coalesce(F.col("_lg"), F.lit(0.0))))
    return out.withColumn("cum_return", val - 1.0).drop("_lg", "_neg", "_zero")


@series_op
def cumulative_sum_return(df: DataFrame, col: str = "ret", *, by: str = BY) -> DataFrame:
    """Running arithmetic sum of returns × 100."""
    out = running(df, _c(col), "sum", "cum_sum_return", by)
    return out.withColumn("cum_sum_return", F.col("cum_sum_return") * 100.0)


@series_op
def direction_hit(df: DataFrame, n: int = 10, *, by: str = BY) -> DataFrame:
    """W34 (row part): sign of the mean of the previous n returns vs the sign
    of the return (<= 0 counts as down); null for the first n return rows."""
    out = df if "ret" in df.columns else df.withColumn("ret", pct_change(F.col("close"), 1, by))
    w = rows(-n, -1, by)
    pred = F.when(F.avg("ret").over(w) > 0, F.lit(1)).otherwise(F.lit(-1))
    act = F.when(F.col("ret") > 0, F.lit(1)).otherwise(F.lit(-1))
    ok = F.when((F.count("ret").over(w) == n) & F.col("ret").isNotNull(),
                F.when(pred == act, F.lit(1)).otherwise(F.lit(0)))
    out = out.withColumn("direction_hit", ok)
    return out if "ret" in df.columns else out.drop("ret")


def direction_hit_rate(df: DataFrame, n: int = 10, *, by: str = BY, ts="ts") -> DataFrame:
    """% of correct direction calls per symbol; 50 when none."""
    hits = direction_hit(df, n, by=by, ts=ts)
    return hits.groupBy(by).agg(F.coalesce(F.avg("direction_hit") * 100.0, F.lit(50.0)).alias("hit_rate"))


@series_op
def price_change(df: DataFrame, k: int = 1, *, by: str = BY) -> DataFrame:
    """Absolute and % change over k rows; 0 when the symbol is too short."""
    prev = lag("close", k, by)
    ch = F.when(F.col(N) >= k + 1, F.col("close") - prev)
    pc = F.when(F.col(N) >= k + 1, div(F.col("close") - prev, prev) * 100.0)
    return (df.withColumn(f"change_{k}", F.coalesce(ch, F.lit(0.0)))
            .withColumn(f"change_pct_{k}", F.coalesce(pc, F.lit(0.0))))


@series_op
def forward_return(df: DataFrame, k: int = 1, *, by: str = BY) -> DataFrame:
    """close(k rows ahead) / close - 1."""
    return df.withColumn(f"fwd_return_{k}", div(lead("close", k, by), F.col("close")) - 1.0)


@series_op
def forward_price_std(df: DataFrame, n: int = 30, *, by: str = BY) -> DataFrame:
    """Sample std of close over rows +1..+n (needs all n rows)."""
    w = rows(1, n, by)
    return df.withColumn(f"fwd_price_std_{n}",
                         F.when(F.count("close").over(w) == n, F.stddev_samp("close").over(w)))


@series_op
def forward_direction(df: DataFrame, *, by: str = BY) -> DataFrame:
    """1 if the next close is above this close else 0; and the next row's
    5-row return volatility (0 when missing)."""
    nxt = lead("close", 1, by)
    out = df.withColumn("fwd_direction", F.when(nxt > F.col("close"), F.lit(1)).otherwise(F.lit(0)))
    r = pct_change(F.col("close"), 1, by)
    out = out.withColumn("_r", r)
    out = out.withColumn("_v5", full_rows(5, F.stddev_samp("_r"), F.col("_r"), by))
    return (out.withColumn("fwd_volatility_5", F.coalesce(lead("_v5", 1, by), F.lit(0.0)))
            .drop("_r", "_v5"))


@series_op
def sample_range(df: DataFrame, start: int = 50, tail: int = 30, *, by: str = BY) -> DataFrame:
    """Keep rows with index in [start, n - tail)."""
    return df.filter((F.col(RN) >= start) & (F.col(RN) < F.col(N) - tail))


@series_op
def monthly_targets(df: DataFrame, *, by: str = BY, warmup: int = 60, horizon: int = 30) -> DataFrame:
    """Samples at rows 60 <= i < n-30: return from close(i-1) to
    close(i+29), std of the 29 one-row returns inside rows i+1..i+29, and
    trend = 1 if the return is positive."""
    r = pct_change(F.col("close"), 1, by)
    out = df.withColumn("_r1", r)
    fw = rows(1, horizon - 1, by)
    tgt_ret = div(lead("close", horizon - 1, by), lag("close", 1, by)) - 1.0
    out = (out.withColumn("target_return", tgt_ret)
           .withColumn("target_volatility",
                       F.when(F.count("_r1").over(fw) == horizon - 1, F.stddev_samp("_r1").over(fw)))
           .withColumn("target_trend", F.when(F.col("target_return") > 0, F.lit(1)).otherwise(F.lit(0)))
           .drop("_r1"))
    return out.withColumn("_keep", (F.col(RN) >= warmup) & (F.col(RN) < F.col(N) - horizon))


def key_levels(df: DataFrame, order: int = 5, last: int = 3, *, by: str = BY, ts=TS) -> DataFrame:
    """W30 levels: the last ``last`` local maxima (resistance) and minima
    (support) of each symbol in time order, and its last close."""
    p = finish(local_extrema(prepare(df, by, ts), order, by=by), keep_index=True).select(by, RN, "close", "is_local_max", "is_local_min")
    levels = p.filter("is_local_max OR is_local_min").withColumn("_kind", F.concat_ws("/", F.col(by).cast("string"), F.col("is_local_max").cast("string")))
    kept = top_n_per_key(levels, "_kind", [F.col(RN).desc()], last)
    listed = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(RN, "close")))), lambda x: x["close"])
    found = kept.groupBy(by).agg(listed(F.col("is_local_max")).alias("resistance_levels"), listed(F.col("is_local_min")).alias("support_levels"))
    none = F.array().cast("array<double>")
    return (p.groupBy(by).agg(F.max_by("close", RN).alias("current_price")).join(found, by, "left")
            .select(by, F.coalesce("resistance_levels", none).alias("resistance_levels"),
                    F.coalesce("support_levels", none).alias("support_levels"), "current_price"))


# ------------------------------------------------------------------ per-symbol rows
@series_op
def latest_row(df: DataFrame, *, by: str = BY) -> DataFrame:
    """The last bar of each symbol (no extra shuffle: uses _rn = _n - 1)."""
    return df.filter(F.col(RN) == F.col(N) - 1)


@series_op
def tail_rows(df: DataFrame, n: int = 5, *, by: str = BY) -> DataFrame:
    """The last n bars of each symbol."""
    return df.filter(F.col(RN) >= F.col(N) - n)


def history_cap(df: DataFrame, n: int = 100, *, by: str = BY, ts: str = "timestamp") -> DataFrame:
    """Keep the newest n entries per key."""
    return top_n_per_key(df, by, [F.col(ts).desc()], n)
