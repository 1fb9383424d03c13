"""Risk and return aggregates per symbol.

Row-level inputs (returns, drawdowns, rolling vols) come from the series
layout; the per-symbol results are ``groupBy(symbol).agg`` with algebraic
aggregates (sum/avg/stddev/covar/corr/regr_*), which Spark combines map-side,
so a hot symbol costs one partial buffer per task, not one task.
Exact percentiles (A4, A10) are selected by rank over a histogram (``ordered``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import align, ordered, series
from tickframe.operators import indicators as ind
from tickframe.operators.series import BY, N, RN

SQRT252 = math.sqrt(252.0)


def with_returns(bars: DataFrame, *, by: str = BY, ts="ts", extra=()) -> DataFrame:
    """Bars plus ``ret`` (1-row return), ``_rn`` and ``_n``; halo rows removed.

    ``extra`` is a list of indicator callables applied on the prepared frame.
    """
    p = series.prepare(bars, by, ts)
    p = ind.returns(p, by=by)
    for f in extra:
        p = f(p)
    return series.finish(p, keep_index=True)


def compare_symbols(bars: DataFrame, fundamentals: DataFrame | None = None,
                    sectors: DataFrame | None = None, *, by: str = BY) -> DataFrame:
    """A1: latest close, high/low, mean volume, annualised vol, Sharpe
    (mean*252/vol, 0 when vol is not > 0), market cap, P/E, sector."""
    r = with_returns(bars, by=by)
    vol = F.stddev_samp("ret") * SQRT252
    out = (r.groupBy(by).agg(
        F.max_by("close", RN).alias("current_price"),
        F.max("high").alias("year_high"), F.min("low").alias("year_low"),
        F.avg("volume").alias("avg_volume"),
        vol.alias("volatility"), (F.avg("ret") * 252.0).alias("_mu")))
    out = (out.withColumn("sharpe_ratio", F.when(F.col("volatility") > 0,
                                                 F.col("_mu") / F.col("volatility")).otherwise(F.lit(0.0)))
           .drop("_mu"))
    if fundamentals is not None:
        f = fundamentals.select(by, "market_cap", "trailing_pe")
        out = (out.join(f, by, "left")
               .withColumn("market_cap", F.coalesce("market_cap", F.lit(0.0)))
               .withColumn("pe_ratio", F.coalesce("trailing_pe", F.lit(0.0))).drop("trailing_pe"))
    if sectors is not None:
        out = (out.join(sectors.select(by, "sector"), by, "left")
               .withColumn("sector", F.coalesce("sector", F.lit("Unknown"))))
    return out


def volatility_summary(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """A2: daily and annualised (×√252) sample std of returns."""
    r = with_returns(bars, by=by)
    return r.groupBy(by).agg(F.stddev_samp("ret").alias("daily_volatility"),
                             (F.stddev_samp("ret") * SQRT252).alias("annualized_volatility"))


def max_drawdown(bars: DataFrame, *, by: str = BY, signed: bool = False, col: str = "close") -> DataFrame:
    """A3: min of the drawdown series; absolute by default (risk path), signed
    for the portfolio path (Q29)."""
    d = ind.drawdown_series(bars, col, by=by)
    m = F.min("drawdown")
    return d.groupBy(by).agg((m if signed else F.abs(m)).alias("max_drawdown"))


def value_at_risk(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """A4: 5th and 1st percentile of returns, linear interpolation (numpy)."""
    r = with_returns(bars, by=by)
    return ordered.exact_percentiles(r, by, "ret", {"var_95": 0.05, "var_99": 0.01})


def _aligned_returns(bars: DataFrame, index: DataFrame, *, by: str) -> DataFrame:
    """J1 + returns after alignment (Q11): both series are restricted to the
    common dates, then returns are taken over consecutive common dates."""
    j = bars.select(by, "ts", "close").join(index.select("ts", F.col("close").alias("m_close")), "ts", "inner")
    p = series.prepare(j, by, "ts")
    w = series.win(by)
    p = (p.withColumn("r_s", ind.div(F.col("close"), F.lag("close", 1).over(w)) - 1.0)
         .withColumn("r_m", ind.div(F.col("m_close"), F.lag("m_close", 1).over(w)) - 1.0))
    return series.finish(p)


def _returns_per_index(bars: DataFrame, indices: DataFrame, *, by: str, **layout) -> DataFrame:
    """``_aligned_returns`` with every series of ``indices`` (index_name, ts, close).

    A bar travels once, with its date's index values as one array, and is dealt
    to the indices inside its block.  Within a block an index's rows follow one
    another; the first follows the last of the blocks before, so no halo is needed.
    """
    at = align.packed(bars.select(by, "ts", "close"), indices.select("ts", "index_name", F.col("close").alias("m_close")), "_at", on="ts")
    p = series.prepare(at.filter("_at is not null"), by, "ts", halo_back=0, halo_fwd=0, **layout)
    here = align.unpacked(p.filter(F.col(series.CORE)), "_at").withColumn("_is", F.struct("close", "m_close"))
    ends = (here.filter(F.col(series.BLK) > 0).groupBy(F.col(by).alias("_eby"), F.col("index_name").alias("_ename"), F.col(series.BLK).alias("_eblk"))
            .agg(F.max_by("_is", RN).alias("_end")))  # one row per index and block of a symbol with several
    before = Window.partitionBy("_eby", "_ename").orderBy("_eblk")
    ends = ends.withColumn("_end", F.lag("_end", 1).over(before)).filter("_end is not null")
    same = F.col(by).eqNullSafe(F.col("_eby")) & F.col("index_name").eqNullSafe(F.col("_ename")) & (F.col(series.BLK) == F.col("_eblk"))
    w = Window.partitionBy(by, series.BLK, "index_name").orderBy(RN)
    out = here.join(F.broadcast(ends), same, "left")
    out = out.withColumn("_was", F.coalesce(F.lag("_is", 1).over(w), F.col("_end")))
    return out.select(by, "ts", "index_name", "close", "m_close",
                      (ind.div(F.col("close"), F.col("_was.close")) - 1.0).alias("r_s"),
                      (ind.div(F.col("m_close"), F.col("_was.m_close")) - 1.0).alias("r_m"))


def beta(bars: DataFrame, index: DataFrame, *, by: str = BY, min_dates: int = 30) -> DataFrame:
    """A5: sample covariance / population variance of the market on common
    dates (Q10); 1.0 (correlation 0.0) with < 30 common dates or zero variance."""
    a = _aligned_returns(bars, index, by=by)
    g = a.groupBy(by).agg(F.count("ts").alias("common_dates"),
                          F.covar_samp("r_s", "r_m").alias("_cov"), F.var_pop("r_m").alias("_var"),
                          F.corr("r_s", "r_m").alias("_corr"))
    ok = F.col("common_dates") >= min_dates
    return (g.select(by, "common_dates",
                     F.when(ok & (F.col("_var") > 0), F.col("_cov") / F.col("_var"))
                      .otherwise(F.lit(1.0)).alias("beta"),
                     F.when(ok, F.coalesce(F.col("_corr"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("correlation")))


def index_correlation(bars: DataFrame, indices: DataFrame, *, by: str = BY, min_dates: int = 30) -> DataFrame:
    """Correlation of returns with each index (index_name, ts, close) on
    more than ``min_dates`` common dates; one row per (symbol, index)."""
    a = _returns_per_index(bars, indices, by=by)
    g = a.groupBy(by, "index_name").agg(F.count("ts").alias("common_dates"),
                                        F.corr("r_s", "r_m").alias("_corr"))
    return g.select(by, "index_name", "common_dates",
                    F.when(F.col("common_dates") > min_dates, F.coalesce("_corr", F.lit(0.0)))
                     .otherwise(F.lit(0.0)).alias("correlation"))


def trend_regression(bars: DataFrame, *, by: str = BY, min_bars: int = 50) -> DataFrame:
    """OLS slope of close on the row number; strength = slope / first
    close * 100 * n, bucketed; 'insufficient_data' below 50 bars."""
    from tickframe.functions.signals import trend_label
    r = with_returns(bars, by=by)
    return trend_from_rows(r, by=by, min_bars=min_bars, label_fn=trend_label)


def trend_from_rows(rows_df: DataFrame, *, by: str = BY, min_bars: int = 50, label_fn=None) -> DataFrame:
    from tickframe.functions.signals import trend_label
    label_fn = label_fn or trend_label
    g = rows_df.groupBy(by).agg(F.regr_slope("close", RN).alias("slope"), F.count("close").alias("n"),
                                F.min_by("close", RN).alias("first_close"))
    raw = ind.div(F.col("slope"), F.col("first_close")) * 100.0 * F.col("n")
    enough = F.col("n") >= min_bars
    return g.select(by, F.when(enough, F.col("slope")).alias("slope"),
                    F.when(enough, label_fn(raw)).otherwise(F.lit("insufficient_data")).alias("trend"),
                    F.when(enough, F.abs(raw)).otherwise(F.lit(0.0)).alias("trend_strength"))


def _tail_std(k: int | None) -> Column:
    if k is None:
        return F.stddev_samp("ret")
    # the last k returns are the rows with _rn >= _n - k (the first row has no return)
    return F.stddev_samp(F.when(F.col(RN) >= F.col(N) - k, F.col("ret")))


def vol_term_structure(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Annualised std of the last 21, 63, 126 and all returns (one pass)."""
    r = with_returns(bars, by=by)
    return r.groupBy(by).agg((_tail_std(21) * SQRT252).alias("vol_1m"), (_tail_std(63) * SQRT252).alias("vol_3m"),
                             (_tail_std(126) * SQRT252).alias("vol_6m"), (_tail_std(None) * SQRT252).alias("vol_1y"))


def vol_percentiles(bars: DataFrame, *, by: str = BY, n: int = 252) -> DataFrame:
    """A10: 25/50/75/90th percentile of the rolling n-row return vol ×√252,
    plus the current (whole-sample) annualised vol."""
    p = series.prepare(bars, by, "ts")
    p = ind.returns(p, by=by)
    p = series.rolling_std(p, "ret", {n: "_rv"}, by)
    p = p.withColumn("_rv", F.col("_rv") * SQRT252)
    rows = series.finish(p, keep_index=True)
    now = rows.groupBy(F.col(by).alias("_by")).agg((F.stddev_samp("ret") * SQRT252).alias("current"))
    tails = ordered.exact_percentiles(rows, by, "_rv", {f"percentile_{q}": q / 100 for q in (25, 50, 75, 90)})
    return now.join(tails, F.col("_by").eqNullSafe(F.col(by))).select(by, "current", *tails.columns[1:])


def vol_forecast_simple(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Std * (1 + 0.1 (std of last 20 - std of last 40)), trend label."""
    r = with_returns(bars, by=by)
    g = r.groupBy(by).agg(F.stddev_samp("ret").alias("current_vol"),
                          (_tail_std(20) - _tail_std(40)).alias("vol_trend"))
    return g.select(by, "current_vol", "vol_trend",
                    (F.col("current_vol") * (F.lit(1.0) + F.col("vol_trend") * 0.1)).alias("predicted_vol"),
                    F.when(F.col("vol_trend") > 0, F.lit("increasing")).otherwise(F.lit("decreasing")).alias("trend"))


def sector_rollup(bars: DataFrame, sectors: DataFrame, *, by: str = BY) -> DataFrame:
    """Per symbol the sum of daily returns (not compounded, Q12), return
    vol and mean volume; per sector their means, the population std of the
    performances and the member count."""
    r = with_returns(bars, by=by)
    per = r.groupBy(by).agg(F.sum("ret").alias("performance"), F.stddev_samp("ret").alias("volatility"),
                            F.avg("volume").alias("avg_volume"))
    j = per.join(sectors.select(by, "sector"), by)
    return j.groupBy("sector").agg(
        F.avg("performance").alias("avg_performance"), F.avg("volatility").alias("avg_volatility"),
        F.avg("avg_volume").alias("avg_volume"), F.stddev_pop("performance").alias("performance_spread"),
        F.count(by).alias("symbols"))


def market_snapshot(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Last close, change and % change vs the previous bar, last volume."""
    p = series.prepare(bars, by, "ts")
    prev = series.lag("close", 1, by)
    p = p.withColumn("_prev", prev)
    last = series.finish(ind.latest_row(p, by=by))
    return last.select(by, F.col("ts").alias("last_date"), F.col("close").alias("price"),
                       (F.col("close") - F.col("_prev")).alias("change"),
                       (ind.div(F.col("close") - F.col("_prev"), F.col("_prev")) * 100.0).alias("change_percent"),
                       "volume")


def market_summary(series_df: DataFrame, *, by: str = BY) -> DataFrame:
    """Last value, 1/5/20-row % change and annualised vol per series."""
    p = series.prepare(series_df, by, "ts")
    for k in (1, 5, 20):
        p = ind.momentum(p, k, by=by)
    p = ind.returns(p, by=by)
    rows = series.finish(p, keep_index=True)
    return rows.groupBy(by).agg(
        F.max_by("close", RN).alias("last_value"),
        F.max_by("momentum_1", RN).alias("change_1"), F.max_by("momentum_5", RN).alias("change_5"),
        F.max_by("momentum_20", RN).alias("change_20"),
        (F.stddev_samp("ret") * SQRT252).alias("volatility"))


def prediction_risk(paths: DataFrame, bars: DataFrame, *, by: str = BY, col: str = "predicted") -> DataFrame:
    """Population std / mean of the forecast path vs the return std:
    high above 1.5x, medium above 1.2x, else low."""
    vol = with_returns(bars, by=by).groupBy(by).agg(F.stddev_samp("ret").alias("_hist"))
    pv = paths.groupBy(by).agg((F.stddev_pop(col) / F.avg(col)).alias("path_volatility"))
    j = pv.join(vol, by)
    return j.select(by, "path_volatility",
                    F.when(F.col("path_volatility") > F.col("_hist") * 1.5, F.lit("high"))
                     .when(F.col("path_volatility") > F.col("_hist") * 1.2, F.lit("medium"))
                     .otherwise(F.lit("low")).alias("prediction_risk"))


def path_direction(paths: DataFrame, *, by: str = BY, col: str = "predicted", day: str = "day") -> DataFrame:
    """% change from the first to the last forecast step: >5 strong up,
    >1 up, <-5 strong down, <-1 down, else sideways; a path of one step is neutral."""
    g = paths.groupBy(by).agg(F.min_by(col, day).alias("_first"), F.max_by(col, day).alias("_last"),
                              F.count(col).alias("_steps"))
    pct = (F.col("_last") - F.col("_first")) / F.col("_first") * 100.0
    return g.select(by, pct.alias("path_change_pct"),
                    F.when(F.col("_steps") < 2, F.lit("neutral"))
                     .when(pct > 5, F.lit("strong_uptrend")).when(pct > 1, F.lit("uptrend"))
                     .when(pct < -5, F.lit("strong_downtrend")).when(pct < -1, F.lit("downtrend"))
                     .otherwise(F.lit("sideways")).alias("path_direction"))


def trend_adjusted_strength(probs: DataFrame, bars: DataFrame, *, by: str = BY, conf: str = "confidence") -> DataFrame:
    """confidence*100 - min(20, 1000 * std of the last 20 returns), clamped 0..100."""
    from tickframe.functions.signals import clamp
    r = with_returns(bars, by=by).groupBy(by).agg(_tail_std(20).alias("_s20"))
    j = probs.join(r, by)
    return j.select(by, clamp(F.col(conf) * 100.0 - F.least(F.lit(20.0), F.col("_s20") * 1000.0)).alias("trend_strength"))


def volume_profile(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Last volume / mean volume: >2 high (strength min(100,(r-1)*50)),
    <.5 low (min(100,(1-r)*100)), else normal."""
    g = bars.groupBy(by).agg(F.max_by("volume", "ts").alias("current_volume"), F.avg("volume").alias("avg_volume"))
    ratio = F.when(F.col("avg_volume") > 0, F.col("current_volume") / F.col("avg_volume")).otherwise(F.lit(1.0))
    g = g.withColumn("volume_ratio", ratio)
    r = F.col("volume_ratio")
    return g.select(by, "current_volume", "avg_volume", "volume_ratio",
                    F.when(r > 2, F.lit("high_volume")).when(r < 0.5, F.lit("low_volume"))
                     .otherwise(F.lit("normal_volume")).alias("volume_signal"),
                    F.when(r > 2, F.least(F.lit(100.0), (r - 1) * 50.0))
                     .when(r < 0.5, F.least(F.lit(100.0), (F.lit(1.0) - r) * 100.0))
                     .otherwise(F.lit(0.0)).alias("volume_strength"))


def regression_metrics(pred: DataFrame, *, label: str = "label", prediction: str = "prediction",
                       by: str | None = None) -> DataFrame:
    """MSE, MAE and R² (one pass of sums; grouped when ``by`` is given)."""
    e = F.col(label) - F.col(prediction)
    aggs = [F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            (F.lit(1.0) - F.sum(e * e) / (F.var_pop(label) * F.count(label))).alias("r2")]
    return pred.groupBy(by).agg(*aggs) if by else pred.agg(*aggs)
