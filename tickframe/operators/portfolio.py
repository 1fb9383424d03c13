"""Portfolio operators.

The portfolio is a (symbol, weight) table joined by key.  Portfolio return
series are ``groupBy(ts)`` sums of weight * return over the rows that exist
(a missing return counts 0, no dense grid).  Covariances are pairwise
complete sums over dates for the portfolio's members, whose number is checked.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import align, ordered
from tickframe.operators import stats as st
from tickframe.operators.series import BY

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

SQRT252 = math.sqrt(252.0)


def member_returns(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """Daily returns of the portfolio members (first row of each symbol dropped)."""
    members = bars.join(weights.select(by), by, "left_semi")
    r = st.with_returns(members, by=by)
    return r.filter(F.col("ret").isNotNull()).select(by, "ts", "ret")


def portfolio_returns(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """A26 (+J2, J10): sum of weight * return per date over the union of
    member dates; a member without a return that day contributes 0."""
    r = align.attach_weights(member_returns(bars, weights, by=by), weights, on=by)
    return r.groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("portfolio_return"))


def portfolio_metrics(port: DataFrame, *, col: str = "portfolio_return") -> DataFrame:
    """Mean, std, daily Sharpe; expected annual return / volatility and
    their Sharpe; 'return_improvement' = annual Sharpe - daily Sharpe (as the
    reference computes it, Q17) and the annual-vs-annual difference."""
    g = port.agg(F.avg(col).alias("mean_return"), F.stddev_samp(col).alias("std_return"))
    hist = F.when(F.col("std_return") > 0, F.col("mean_return") / F.col("std_return")).otherwise(F.lit(0.0))
    ann_r = F.col("mean_return") * 252.0
    ann_v = F.col("std_return") * SQRT252
    pred = F.when(ann_v > 0, ann_r / ann_v).otherwise(F.lit(0.0))
    return g.select("mean_return", "std_return", hist.alias("historical_sharpe_ratio"),
                    ann_r.alias("expected_annual_return"), ann_v.alias("expected_volatility"),
                    pred.alias("predicted_sharpe_ratio"), ann_v.alias("historical_volatility"),
                    (pred - hist).alias("return_improvement"),
                    (pred - hist * SQRT252).alias("annual_sharpe_difference"))


def portfolio_risk(port: DataFrame, *, col: str = "portfolio_return") -> DataFrame:
    """VaR 95/99 of the portfolio returns, signed max drawdown of the
    compounded value, risk score = |max drawdown| * 100.

    Running product and running maximum are prefix scans over ranges of dates.
    """
    lit = F.lit(0).alias("_all")
    f = F.lit(1.0) + F.col(col)
    v = ordered.prefix(ordered.spread(port, "ts"), ["ts"], [
        (F.log(F.abs(f)), "sum", "_lg"), (F.when(f < 0, 1).otherwise(0), "sum", "_neg"), (F.when(f == 0, 1).otherwise(0), "sum", "_zero")])
    cum = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(
        F.when(F.col("_neg") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.exp("_lg"))
    v = ordered.prefix(v.withColumn("_cum", cum), ["ts"], [(F.col("_cum"), "max", "_peak")])
    low = v.agg(F.min(F.try_divide(F.col("_cum") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"), F.lit(0).alias("_all"))
    tails = ordered.exact_percentiles(port.select(lit, col), "_all", col, {"var_95": 0.05, "var_99": 0.01})
    g = low.join(tails, "_all", "left").select("var_95", "var_99", "max_drawdown")
    return g.withColumn("risk_score", F.abs("max_drawdown") * 100.0)


def _pair_moments(k: int):
    """Sums over a task's dates for every pair of members that share one: number
    of dates, both sums and the sum of products."""
    def run(batches):
        import numpy
        import pyarrow

        n, sums, products = (numpy.zeros((k, k)) for _ in range(3))
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            row = numpy.repeat(numpy.arange(len(members)), numpy.diff(members.offsets.to_numpy()))
            place = flat.field("place").to_numpy()
            x, there = numpy.zeros((len(members), k)), numpy.zeros((len(members), k))
            x[row, place], there[row, place] = flat.field("x").to_numpy(zero_copy_only=False), 1.0
            n += there.T @ there
            sums += x.T @ there
            products += x.T @ x
        i, j = numpy.nonzero(numpy.triu(n))
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array(c) for c in (i, j, n[i, j], sums[i, j], sums[j, i], products[i, j])],
                                              ["a", "b", "n", "sum_a", "sum_b", "sum_ab"])
    return run


def covariance_matrix(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """A7 (+J11): annualised pairwise-complete covariance of member returns,
    long form (sym_a, sym_b, cov) with both (a, b) and (b, a).

    A date's returns, less each member's mean, make one row of a dates x members
    matrix; tasks add up its products, so what they send does not grow with
    the dates.  A member has one return a date; pairs with one common date have a
    null covariance, pairs with none no row."""
    r = member_returns(bars, weights, by=by).filter(F.col("ret").isNotNull()).select("ts", by, "ret")
    members = weights.select(by).distinct()
    k = members.count()
    if k > align.MAX_PAIR_UNIVERSE:
        raise ValueError(f"universe of {k} symbols exceeds {align.MAX_PAIR_UNIVERSE}")
    places = members.select(by, (F.row_number().over(Window.orderBy(by)) - 1).alias("place"))  # at most MAX_PAIR_UNIVERSE rows
    means = r.groupBy(by).agg(F.avg("ret").alias("_m")).join(places, by)
    dates = (r.join(means, by).groupBy("ts")
             .agg(F.collect_list(F.struct("place", (F.col("ret") - F.col("_m")).alias("x"))).alias("members")).select("members"))
    m = (dates.mapInArrow(_pair_moments(k), "a long, b long, n double, sum_a double, sum_b double, sum_ab double")
         .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sum_a", "sum_b", "sum_ab")]))
    cov = F.when(F.col("n") > 1, (F.col("sum_ab") - F.col("sum_a") * F.col("sum_b") / F.col("n")) / (F.col("n") - 1) * 252.0)
    half = (m.join(places.select(F.col("place").alias("a"), F.col(by).alias("sym_a")), "a")
            .join(places.select(F.col("place").alias("b"), F.col(by).alias("sym_b")), "b").select("sym_a", "sym_b", cov.alias("cov")))
    pair = F.struct("sym_a", "sym_b")
    both = F.when(F.col("sym_a") == F.col("sym_b"), F.array(pair)).otherwise(
        F.array(pair, F.struct(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b"))))
    return half.select(F.explode(both).alias("p"), "cov").select("p.sym_a", "p.sym_b", "cov")


def expected_returns(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """Annualised mean return per member."""
    r = member_returns(bars, weights, by=by)
    return r.groupBy(by).agg((F.avg("ret") * 252.0).alias("expected_return"))


def portfolio_weighted_stats(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """Expected return w'mu, volatility sqrt(w' Sigma w), Sharpe."""
    mu = expected_returns(bars, weights, by=by).join(weights, by)
    cov = covariance_matrix(bars, weights, by=by)
    wa = weights.select(F.col(by).alias("sym_a"), F.col("weight").alias("w_a"))
    wb = weights.select(F.col(by).alias("sym_b"), F.col("weight").alias("w_b"))
    var = cov.join(wa, "sym_a").join(wb, "sym_b").agg(F.sum(F.col("w_a") * F.col("w_b") * F.col("cov")).alias("_v"))
    ret = mu.agg(F.sum(F.col("weight") * F.col("expected_return")).alias("expected_return"))
    j = ret.withColumn("_k", F.lit(1)).join(var.withColumn("_k", F.lit(1)), "_k")
    vol = F.sqrt("_v")
    return j.select("expected_return", vol.alias("volatility"),
                    F.when(vol > 0, F.col("expected_return") / vol).otherwise(F.lit(0.0)).alias("sharpe_ratio"))


def portfolio_suggestions(bars: DataFrame, weights: DataFrame, *, by: str = BY) -> DataFrame:
    """Best / worst member by daily Sharpe (best > 1.5 * worst ->
    rebalance lines), diversify below 5 members, warn when sum(std * w) > 0.3."""
    r = member_returns(bars, weights, by=by)
    per = (r.groupBy(by).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
           .withColumn("_sh", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).otherwise(F.lit(0.0)))
           .join(weights, by))
    # ties broken by the smaller symbol (Q19)
    g = per.agg(F.max_by(by, F.struct("_sh", (-F.col(by)).alias("k"))).alias("best"), F.max("_sh").alias("best_sharpe"),
                F.min_by(by, F.struct("_sh", F.col(by))).alias("worst"),
                F.min("_sh").alias("worst_sharpe"), F.count(by).alias("assets"),
                F.sum(F.col("_s") * F.col("weight")).alias("weighted_vol"))
    rebal = F.col("best_sharpe") > F.col("worst_sharpe") * 1.5
    lines = F.array_compact(F.array(
        F.when(rebal, F.concat(F.lit("Consider increasing allocation to "), F.col("best").cast("string"))),
        F.when(rebal, F.concat(F.lit("Consider reducing allocation to "), F.col("worst").cast("string"))),
        F.when(F.col("assets") < 5, F.lit("Consider adding more assets for better diversification")),
        F.when(F.col("weighted_vol") > 0.3,
               F.lit("Portfolio volatility is high, consider risk management strategies"))))
    return g.select("best", "worst", "best_sharpe", "worst_sharpe", "assets", "weighted_vol",
                    lines.alias("suggestions"))


def weight_grid(weights: DataFrame, k: int = 10, *, by: str = BY) -> DataFrame:
    """G1 candidates: all long-only weight vectors on the grid {0, 1/k, ..}
    summing to 1 over the universe, as (cand, weights) rows; ``weights`` is
    in the order of the members.

    Built by extending partial vectors one member at a time (explode of the
    remaining units), so only vectors that can still sum to 1 are kept; the
    candidate count is C(k + m - 1, m - 1) for m members, checked up front.
    """
    m = weights.select(by).distinct().count()
    if m > align.MAX_PAIR_UNIVERSE:
        raise ValueError(f"universe of {m} symbols is too large for a weight grid")
    n_cand = math.comb(k + m - 1, m - 1) if m else 0
    if n_cand > 5_000_000:
        raise ValueError(f"{n_cand} candidates: reduce k or the universe")
    spark = weights.sparkSession
    cur = spark.range(1).select(F.array().cast("array<int>").alias("units"), F.lit(0).alias("used"))
    for i in range(m):
        rest = F.lit(k) - F.col("used")
        pick = F.explode(F.sequence(F.lit(0), rest)) if i < m - 1 else rest
        cur = cur.select("units", "used", pick.alias("_u")).select(
            F.concat("units", F.array("_u")).alias("units"), (F.col("used") + F.col("_u")).alias("used"))
        if i == 1:
            cur = cur.repartition("units")  # the first two members' vectors are extended in many tasks
    cand = F.concat_ws(",", F.col("units").cast("array<string>"))
    return cur.filter(F.col("used") == k).select(
        cand.alias("cand"), F.transform("units", lambda u: u / F.lit(float(k))).alias("weights"))


VOL_CAPS = {"low": 0.10, "medium": 0.15, "high": 0.25, "unconstrained": None}


def portfolio_weight_search(bars: DataFrame, weights: DataFrame, k: int = 10, *, by: str = BY) -> DataFrame:
    """G1: score every grid candidate by expected return, volatility and
    Sharpe (annualised); per risk tolerance the best-Sharpe candidate whose
    volatility is within the cap (.10 / .15 / .25)."""
    weights = weights.join(bars.select(by).distinct(), by, "left_semi")  # J8: members with data
    grid = weight_grid(weights, k, by=by)
    # one row: members, expected returns and covariances by member; what is not there counts 0
    listed = lambda c, v, name: F.map_from_entries(F.collect_list(F.struct(c, v))).alias(name)
    known = weights.agg(F.array_sort(F.collect_set(by)).alias("members"), F.lit(1).alias("_k"))
    mu = expected_returns(bars, weights, by=by).agg(listed(by, "expected_return", "mu"), F.lit(1).alias("_k"))
    sigma = (covariance_matrix(bars, weights, by=by).filter("cov IS NOT NULL").groupBy("sym_a").agg(listed("sym_b", "cov", "row"))
             .agg(listed("sym_a", "row", "sigma"), F.lit(1).alias("_k")))
    member = lambda f: F.transform("members", f)
    known = known.join(mu, "_k").join(sigma, "_k").select(
        "_k", member(lambda a: F.try_element_at("mu", a)).alias("mu"),
        member(lambda a: member(lambda b: F.try_element_at(F.try_element_at("sigma", a), b))).alias("sigma"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda acc, z: acc + z)
    scored = (grid.withColumn("_k", F.lit(1)).join(F.broadcast(known), "_k")  # one row of members x members values, at most 8 MB
              .select("cand", dot(F.col("weights"), F.col("mu")).alias("ret"),
                      dot(F.col("weights"), F.transform("sigma", lambda row: dot(F.col("weights"), row))).alias("var")))
    scored = scored.withColumn("vol", F.sqrt(F.greatest(F.col("var"), F.lit(0.0))))
    scored = scored.withColumn("sharpe", F.when(F.col("vol") > 0, F.col("ret") / F.col("vol")).otherwise(F.lit(0.0)))
    # the reference computes a cap per tolerance but its solver never applies
    # it; "unconstrained" (null cap) reproduces that, the others apply the cap
    caps = F.array(*[F.struct(F.lit(t).alias("risk_tolerance"), F.lit(c).cast("double").alias("vol_cap"))
                     for t, c in VOL_CAPS.items()])
    ok = (scored.withColumn("_cap", F.explode(caps)).select("*", "_cap.*")
          .filter(F.col("vol_cap").isNull() | (F.col("vol") <= F.col("vol_cap"))))
    # best Sharpe; ties by lower volatility, higher return, then allocation text
    key = F.struct((-F.col("sharpe")).alias("a"), F.col("vol").alias("b"), (-F.col("ret")).alias("c"),
                   F.col("cand").alias("d"))
    best = ok.groupBy("risk_tolerance", "vol_cap").agg(F.min_by(F.struct("cand", "ret", "vol", "sharpe"), key)
                                                        .alias("b"))
    return best.select("risk_tolerance", "vol_cap", F.col("b.cand").alias("allocation"),
                       F.col("b.ret").alias("expected_return"), F.col("b.vol").alias("volatility"),
                       F.col("b.sharpe").alias("sharpe_ratio"))


def portfolio_outlook(port: DataFrame, days: int = 30, *, col: str = "portfolio_return") -> DataFrame:
    """Closed-form outlook over ``days``: expected total return mean*h,
    its volatility std*sqrt(h), annual return and volatility."""
    g = port.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    return g.select((F.col("m") * days).alias("expected_total_return"),
                    (F.col("s") * math.sqrt(days)).alias("expected_total_volatility"),
                    (F.col("m") * 252.0).alias("expected_annual_return"),
                    (F.col("s") * SQRT252).alias("expected_volatility"))
