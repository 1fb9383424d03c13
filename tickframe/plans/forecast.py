"""Forecasts, backtest and volatility models without MLlib
(SURVEY 2.10 M15, M17; 2.11 G2, G5, G6; J9, X20, X21).

Per-symbol fits are algebraic aggregates (regr_slope, stddev_pop, ...), so
they combine map-side; forecast paths are the fitted closed forms exploded
over the horizon (J9), never a Python loop.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import signals as sg
from tickframe.operators import align
from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.operators.series import BY, CORE, RN


def forecast_drift(bars: DataFrame, days: int = 30, *, by: str = BY) -> DataFrame:
    """path_k = last close + k * (slope + 0.1 * seasonal_last), with the
    OLS slope of close on the row number and seasonal_last =
    sin(2 pi (n - 1) / 252) * std_pop(close) * 0.1; the reference's random
    noise term is omitted (Q21).  One row per (symbol, day)."""
    p = series.prepare(bars, by, "ts").filter(F.col(CORE))
    g = p.groupBy(by).agg(F.regr_slope("close", RN).alias("slope"), F.count("close").alias("n"),
                          F.stddev_pop("close").alias("sd"), F.max_by("close", RN).alias("last_close"),
                          F.max("ts").alias("last_date"))
    seasonal = F.sin(F.lit(2 * math.pi) * (F.col("n") - 1) / 252.0) * F.col("sd") * 0.1
    g = g.withColumn("step", F.coalesce(F.col("slope"), F.lit(0.0)) + seasonal * 0.1)
    h = align.horizon_cross(g, n=days)
    return h.select(by, "day", sg.forecast_date("last_date", "day").alias("forecast_date"),
                    (F.col("last_close") + F.col("day") * F.col("step")).alias("predicted"))


def return_std(bars: DataFrame, *, by: str = BY) -> DataFrame:
    p = series.prepare(bars, by, "ts")
    p = ind.returns(p, by=by)
    return series.finish(p).groupBy(by).agg(F.stddev_samp("ret").alias("ret_std"))


def forecast_interval(paths: DataFrame, bars: DataFrame, *, by: str = BY, col: str = "predicted") -> DataFrame:
    """Path * (1 -/+ 1.96 * std of daily returns)."""
    j = paths.join(return_std(bars, by=by), by)
    return j.select(by, "day", col, (F.col(col) * (F.lit(1.0) - F.col("ret_std") * 1.96)).alias("lower"),
                    (F.col(col) * (F.lit(1.0) + F.col("ret_std") * 1.96)).alias("upper"))


def horizon_prices(bars: DataFrame, days=(7, 14, 21, 30), *, by: str = BY, k: int = 30) -> DataFrame:
    """J9 + X20 + X21: latest close x forecast days; expected return from the
    k-row momentum, price * (1 + ret * day / 30), confidence X15 decayed by
    (1 - day / 100), forecast date = last date + day."""
    p = series.prepare(bars, by, "ts")
    p = ind.momentum(p, k, by=by)
    last = series.finish(ind.latest_row(p, by=by))
    last = last.withColumn("expected_return", F.coalesce(F.col(f"momentum_{k}"), F.lit(0.0)))
    last = last.withColumn("confidence", sg.confidence("expected_return", 10.0))
    h = align.horizon_cross(last, days)
    price = sg.horizon_price("close", "expected_return", "day")
    return h.select(by, "day", sg.forecast_date("ts", "day").alias("forecast_date"), price.alias("predicted_price"),
                    (price - F.col("close")).alias("change"),
                    ((price - F.col("close")) / F.col("close") * 100.0).alias("change_percent"),
                    sg.horizon_confidence("confidence", "day").alias("confidence"),
                    sg.price_direction("expected_return").alias("direction"))


def ewma_volatility(bars: DataFrame, lam: float = 0.94, *, by: str = BY) -> DataFrame:
    """Recursive variance of returns s2_t = lam s2_(t-1) + (1 - lam) r_t^2,
    seeded with the first squared return; per bar, plus its square root."""
    p = series.prepare(bars, by, "ts")
    p = ind.returns(p, by=by)
    p = series.ewm(p, F.col("ret") * F.col("ret"), alpha=1.0 - lam, adjust=False, start=1, name="ewma_var", by=by)
    p = p.withColumn("ewma_vol", F.sqrt("ewma_var"))
    return series.finish(p).select(by, "ts", "ret", "ewma_var", "ewma_vol")


def ar1_fit(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Lag-1 autoregression of returns per symbol (OLS slope and
    intercept of r_t on r_(t-1)) and the one-step forecast from the last return."""
    p = series.prepare(bars, by, "ts")
    p = ind.returns(p, by=by)
    p = p.withColumn("_lr", series.lag("ret", 1, by))
    rows = series.finish(p, keep_index=True)
    g = rows.groupBy(by).agg(F.regr_slope("ret", "_lr").alias("phi"), F.regr_intercept("ret", "_lr").alias("c"),
                             F.regr_count("ret", "_lr").alias("pairs"), F.max_by("ret", RN).alias("last_ret"))
    return g.withColumn("next_return", F.col("c") + F.col("phi") * F.col("last_ret"))


def signal_backtest(bars: DataFrame, *, by: str = BY) -> DataFrame:
    """Position from the X5 moving-average signal (bullish +1, bearish -1,
    neutral 0) taken at the close and held over the next bar.  Per symbol:
    trades (position changes), win rate over bars in the market, mean
    strategy return, annualised Sharpe, max drawdown and total return of the
    compounded strategy value."""
    p = series.prepare(bars, by, "ts")
    p = ind.sma(p, 20, by=by)
    p = ind.sma(p, 50, by=by)
    p = ind.returns(p, by=by)
    sig = sg.ma_signal("close", "sma_20", "sma_50")
    p = p.withColumn("position", F.when(sig == "bullish", F.lit(1)).when(sig == "bearish", F.lit(-1))
                     .otherwise(F.lit(0)))
    w = series.win(by)
    p = (p.withColumn("_held", F.lag("position", 1).over(w))
         .withColumn("strategy_ret", F.col("_held") * F.col("ret"))
         .withColumn("_chg", F.when(F.col("position") != F.coalesce(F.lag("position", 1).over(w), F.lit(0)),
                                    F.lit(1)).otherwise(F.lit(0))))
    p = ind.cumulative_return(p, "strategy_ret", by=by)
    p = series.running(p, F.col("cum_return") + 1.0, "max", "_peak", by)
    p = p.withColumn("_dd", F.try_divide(F.col("cum_return") + 1.0 - F.col("_peak"), F.col("_peak")))
    rows = series.finish(p, keep_index=True)
    g = rows.groupBy(by).agg(
        F.sum("_chg").alias("trades"),
        (F.avg(F.when(F.col("_held") != 0, F.when(F.col("strategy_ret") > 0, 1.0).otherwise(0.0))) * 100.0)
        .alias("win_rate"),
        F.avg("strategy_ret").alias("mean_return"), F.stddev_samp("strategy_ret").alias("_sd"),
        F.min("_dd").alias("max_drawdown"), F.max_by("cum_return", RN).alias("total_return"))
    return g.select(by, "trades", "win_rate", "mean_return",
                    F.when(F.col("_sd") > 0, F.col("mean_return") / F.col("_sd") * math.sqrt(252.0))
                     .otherwise(F.lit(0.0)).alias("sharpe_ratio"), "max_drawdown", "total_return")



