"""Composed analyses: the technical snapshot per symbol.

bars -> one series layout -> SMA20/50, recursive MACD, Wilder RSI,
population Bollinger, support/resistance, 1/7/30-row changes -> one
aggregation per symbol (latest row via max_by, OLS trend, mean volume) ->
signals (X5/X6), volume profile (A35), technical score (A20).

The aggregation is partial (map-side), and in the single layout it reuses the
exchange of the indicator windows, so the whole snapshot costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions import scores as sc
from tickframe.functions import signals as sg
from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.operators.series import BY, CORE, RN

_LAST = ["ts", "close", "volume", "sma_20", "sma_50", "macd_rec", "macd_rec_signal", "rsi_wilder_14",
         "bbp_upper_20", "bbp_mid_20", "bbp_lower_20", "support_20", "resistance_20",
         "change_1", "change_pct_1", "change_7", "change_pct_7", "change_30", "change_pct_30"]


def technical_frame(bars: DataFrame, *, by: str = BY, ts="ts") -> DataFrame:
    """Per-row analysis-path indicators on one prepared layout (not finished)."""
    p = series.prepare(bars, by, ts)
    p = ind.sma(p, 20, by=by)
    p = ind.sma(p, 50, by=by)
    p = ind.macd_recursive(p, by=by)
    p = ind.rsi_wilder(p, 14, by=by)
    p = ind.bollinger_pop(p, 20, by=by)
    p = ind.support_resistance(p, 20, by=by)
    for k in (1, 7, 30):
        p = ind.price_change(p, k, by=by)
    return p


def technical_snapshot(bars: DataFrame, *, by: str = BY, ts="ts") -> DataFrame:
    """One row per symbol: latest indicators, signals, trend, volume and the
    technical score."""
    p = technical_frame(bars, by=by, ts=ts).filter(F.col(CORE))
    g = p.groupBy(by).agg(
        F.max_by(F.struct(*_LAST), RN).alias("l"),
        F.regr_slope("close", RN).alias("slope"), F.count("close").alias("n"),
        F.min_by("close", RN).alias("first_close"), F.avg("volume").alias("avg_volume"))
    raw = ind.div(F.col("slope"), F.col("first_close")) * 100.0 * F.col("n")
    enough = F.col("n") >= 50
    l = lambda c: F.col(f"l.{c}")
    vr = F.when(F.col("avg_volume") > 0, l("volume") / F.col("avg_volume")).otherwise(F.lit(1.0))
    out = g.select(
        by, l("ts").alias("last_date"), l("close").alias("close"),
        *[l(c).alias(c) for c in ("change_1", "change_pct_1", "change_7", "change_pct_7",
                                  "change_30", "change_pct_30", "sma_20", "sma_50")],
        l("macd_rec").alias("macd_line"), l("macd_rec_signal").alias("macd_signal_line"),
        l("rsi_wilder_14").alias("rsi"),
        l("bbp_upper_20").alias("bb_upper"), l("bbp_mid_20").alias("bb_middle"), l("bbp_lower_20").alias("bb_lower"),
        l("support_20").alias("support"), l("resistance_20").alias("resistance"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, sg.trend_label(raw)).otherwise(F.lit("insufficient_data")).alias("trend"),
        F.when(enough, F.abs(raw)).otherwise(F.lit(0.0)).alias("trend_strength"),
        vr.alias("volume_ratio"))
    out = out.select(
        "*",
        sg.ma_signal("close", "sma_20", "sma_50").alias("ma_signal"),
        sg.ma_strength("close", "sma_20", "sma_50").alias("ma_strength"),
        sg.macd_signal_label("macd_line", "macd_signal_line").alias("macd_signal"),
        sg.macd_strength("macd_line", "macd_signal_line").alias("macd_strength"),
        sg.rsi_signal("rsi").alias("rsi_signal"), sg.rsi_strength("rsi").alias("rsi_strength"),
        sg.bb_signal("close", "bb_upper", "bb_lower").alias("bb_signal"),
        sg.bb_strength("close", "bb_upper", "bb_lower").alias("bb_strength"),
        (ind.div(F.col("close") - F.col("support"), F.col("support")) * 100.0).alias("distance_to_support"),
        (ind.div(F.col("resistance") - F.col("close"), F.col("close")) * 100.0).alias("distance_to_resistance"),
        F.when(F.col("volume_ratio") > 2, F.lit("high_volume")).when(F.col("volume_ratio") < 0.5, F.lit("low_volume"))
         .otherwise(F.lit("normal_volume")).alias("volume_signal"))
    return out.withColumn("technical_score",
                          sc.technical_score("ma_signal", "macd_signal", "rsi_signal", "trend"))


def rank_symbols(scored: DataFrame, *, score: str = "technical_score", by: str = BY,
                 n: int | None = 10) -> DataFrame:
    """Rank by score descending (missing = 0), ties by symbol.

    With ``n`` (the top-k report) the plan is a TakeOrderedAndProject: each
    partition keeps its best n rows and only those are merged, so the rank
    window runs over n rows.  Without ``n`` the result is a distributed range
    sort (no rank column: a dense global rank over all symbols would need a
    single-partition window).
    """
    s = F.coalesce(F.col(score), F.lit(0.0))
    ranked = scored.withColumn("_s", s)
    order = [F.col("_s").desc(), F.col(by).asc()]
    if n is None:
        return ranked.orderBy(*order).drop("_s")
    top = ranked.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_s")
