"""Registered queries: portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickframe.operators import align, clean
from tickframe.operators import portfolio as pf
from tickframe.plans.catalog import query
from tickframe.plans.sqlkit import Q, rounded
from tickframe.sources import fixtures as fx

MR = """mr AS (SELECT symbol, ts, ret FROM (
         SELECT symbol, ts, close / LAG(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret
         FROM bars WHERE symbol IN (SELECT symbol FROM portfolio)) WHERE ret IS NOT NULL),
pr AS (SELECT ts, SUM(weight * ret) AS portfolio_return FROM mr JOIN portfolio USING (symbol) GROUP BY ts)"""
FX = ("bars", "portfolio")


def _port(spark, sf_dir):
    return pf.portfolio_returns(fx.bars(spark, sf_dir), fx.portfolio(spark))


@query("portfolio_returns", Q(f"WITH {MR}\nSELECT * FROM pr", *FX, doubles=("portfolio_return",)))
def q_portfolio_returns(spark, sf_dir):
    """Weighted portfolio return per date (missing member return = 0)."""
    return rounded(_port(spark, sf_dir))


@query("portfolio_metrics", Q(f"""WITH {MR},
g AS (SELECT AVG(portfolio_return) AS mean_return, STDDEV_SAMP(portfolio_return) AS std_return FROM pr),
h AS (SELECT *, CASE WHEN std_return > 0 THEN mean_return / std_return ELSE 0.0 END AS hs,
             mean_return * 252.0 AS ar, std_return * SQRT(252.0) AS av FROM g),
p AS (SELECT *, CASE WHEN av > 0 THEN ar / av ELSE 0.0 END AS ps FROM h)
SELECT mean_return, std_return, hs AS historical_sharpe_ratio, ar AS expected_annual_return,
       av AS expected_volatility, ps AS predicted_sharpe_ratio, av AS historical_volatility,
       ps - hs AS return_improvement, ps - hs * SQRT(252.0) AS annual_sharpe_difference FROM p""", *FX,
    doubles=("mean_return", "std_return", "historical_sharpe_ratio", "expected_annual_return", "expected_volatility",
             "predicted_sharpe_ratio", "historical_volatility", "return_improvement", "annual_sharpe_difference")))
def q_portfolio_metrics(spark, sf_dir):
    """Portfolio mean/std, Sharpe ratios, annualised figures."""
    return rounded(pf.portfolio_metrics(_port(spark, sf_dir)))


@query("portfolio_risk", Q(f"""WITH {MR},
c AS (SELECT ts, portfolio_return,
        SUM(LN(ABS(1 + portfolio_return))) OVER w AS lg,
        SUM(CASE WHEN 1 + portfolio_return < 0 THEN 1 ELSE 0 END) OVER w AS neg,
        SUM(CASE WHEN 1 + portfolio_return = 0 THEN 1 ELSE 0 END) OVER w AS zero
      FROM pr WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN zero > 0 THEN 0.0 ELSE (CASE WHEN neg % 2 = 1 THEN -1.0 ELSE 1.0 END) * EXP(lg) END AS cum
      FROM c),
d AS (SELECT *, (cum - MAX(cum) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
               / NULLIF(MAX(cum) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dd FROM v)
SELECT quantile_cont(portfolio_return, 0.05) AS var_95, quantile_cont(portfolio_return, 0.01) AS var_99,
       MIN(dd) AS max_drawdown, ABS(MIN(dd)) * 100 AS risk_score FROM d""", *FX,
    doubles=("var_95", "var_99", "max_drawdown", "risk_score")))
def q_portfolio_risk(spark, sf_dir):
    """Portfolio VaR 95/99, signed max drawdown, risk score."""
    return rounded(pf.portfolio_risk(_port(spark, sf_dir)))


COV = """pairs AS (SELECT a.ts, a.symbol AS sym_a, b.symbol AS sym_b, a.ret AS ret_a, b.ret AS ret_b
          FROM mr a JOIN mr b ON a.ts = b.ts AND a.symbol <= b.symbol),
half AS (SELECT sym_a, sym_b, COVAR_SAMP(ret_a, ret_b) * 252.0 AS cov FROM pairs GROUP BY sym_a, sym_b),
cov AS (SELECT * FROM half UNION ALL SELECT sym_b AS sym_a, sym_a AS sym_b, cov FROM half WHERE sym_a <> sym_b),
mu AS (SELECT symbol, AVG(ret) * 252.0 AS expected_return FROM mr GROUP BY symbol)"""


@query("covariance_matrix", Q(f"WITH {MR}, {COV}\nSELECT * FROM cov", *FX, doubles=("cov",)))
def q_covariance_matrix(spark, sf_dir):
    """A7 (+J11): annualised pairwise-complete covariance, long form."""
    return rounded(pf.covariance_matrix(fx.bars(spark, sf_dir), fx.portfolio(spark)))


@query("pairwise_series", Q(f"WITH {MR}, {COV}\nSELECT ts, sym_a, sym_b, ret_a, ret_b FROM pairs", *FX,
                            doubles=("ret_a", "ret_b")))
def q_pairwise_series(spark, sf_dir):
    """Same-date return pairs (a <= b) within the portfolio universe."""
    p = fx.portfolio(spark)
    return rounded(align.pairwise_series(pf.member_returns(fx.bars(spark, sf_dir), p), p))


@query("portfolio_weighted_stats", Q(f"""WITH {MR}, {COV},
r AS (SELECT SUM(weight * expected_return) AS expected_return FROM mu JOIN portfolio USING (symbol)),
v AS (SELECT SUM(pa.weight * pb.weight * cov) AS var FROM cov JOIN portfolio pa ON pa.symbol = cov.sym_a
      JOIN portfolio pb ON pb.symbol = cov.sym_b)
SELECT expected_return, SQRT(var) AS volatility,
       CASE WHEN SQRT(var) > 0 THEN expected_return / SQRT(var) ELSE 0.0 END AS sharpe_ratio FROM r, v""", *FX,
    doubles=("expected_return", "volatility", "sharpe_ratio")))
def q_portfolio_weighted_stats(spark, sf_dir):
    """w'mu, sqrt(w'Sigma w) and Sharpe for the given weights."""
    return rounded(pf.portfolio_weighted_stats(fx.bars(spark, sf_dir), fx.portfolio(spark)))


@query("portfolio_suggestions", Q(f"""WITH {MR},
per AS (SELECT symbol, AVG(ret) AS m, STDDEV_SAMP(ret) AS s FROM mr GROUP BY symbol),
sh AS (SELECT per.*, weight, CASE WHEN s > 0 THEN m / s ELSE 0.0 END AS sh FROM per JOIN portfolio USING (symbol)),
g AS (SELECT FIRST(symbol ORDER BY sh DESC, symbol ASC) AS best, MAX(sh) AS best_sharpe,
             FIRST(symbol ORDER BY sh ASC, symbol ASC) AS worst, MIN(sh) AS worst_sharpe, COUNT(symbol) AS assets,
             SUM(s * weight) AS weighted_vol FROM sh)
SELECT best, worst, best_sharpe, worst_sharpe, assets, weighted_vol,
  list_filter([CASE WHEN best_sharpe > worst_sharpe * 1.5 THEN 'Consider increasing allocation to ' || CAST(best AS VARCHAR) END,
               CASE WHEN best_sharpe > worst_sharpe * 1.5 THEN 'Consider reducing allocation to ' || CAST(worst AS VARCHAR) END,
               CASE WHEN assets < 5 THEN 'Consider adding more assets for better diversification' END,
               CASE WHEN weighted_vol > 0.3 THEN 'Portfolio volatility is high, consider risk management strategies' END],
              lambda x: x IS NOT NULL) AS suggestions FROM g""", *FX,
    doubles=("best_sharpe", "worst_sharpe", "weighted_vol")))
def q_portfolio_suggestions(spark, sf_dir):
    """Rebalancing, diversification and volatility suggestions."""
    return rounded(pf.portfolio_suggestions(fx.bars(spark, sf_dir), fx.portfolio(spark)))


@query("portfolio_weight_search", Q(f"""WITH RECURSIVE {MR}, {COV},
mem AS (SELECT symbol, CAST(ROW_NUMBER() OVER (ORDER BY symbol) AS INTEGER) AS i FROM portfolio
        WHERE symbol IN (SELECT DISTINCT symbol FROM bars)),
g(i, units, used) AS (SELECT 0, CAST([] AS INTEGER[]), 0
    UNION ALL SELECT g.i + 1, list_append(g.units, CAST(r.u AS INTEGER)), g.used + CAST(r.u AS INTEGER)
    FROM g, range(0, 11) r(u) WHERE g.i < (SELECT COUNT(*) FROM mem) AND g.used + r.u <= 10),
cand AS (SELECT array_to_string(units, ',') AS cand, units FROM g WHERE i = (SELECT COUNT(*) FROM mem) AND used = 10),
gw AS (SELECT cand, mem.symbol, units[mem.i] / 10.0 AS weight FROM cand JOIN mem ON TRUE),
ret AS (SELECT cand, SUM(weight * expected_return) AS ret FROM gw JOIN mu USING (symbol) GROUP BY cand),
var AS (SELECT a.cand, SUM(a.weight * b.weight * cov) AS var FROM gw a JOIN cov ON cov.sym_a = a.symbol
        JOIN gw b ON b.cand = a.cand AND b.symbol = cov.sym_b GROUP BY a.cand),
sc AS (SELECT ret.cand, ret, SQRT(GREATEST(var, 0.0)) AS vol FROM ret JOIN var USING (cand)),
sh AS (SELECT *, CASE WHEN vol > 0 THEN ret / vol ELSE 0.0 END AS sharpe FROM sc),
caps AS (SELECT * FROM (VALUES ('low', 0.10), ('medium', 0.15), ('high', 0.25), ('unconstrained', NULL))
         t(risk_tolerance, vol_cap))
SELECT risk_tolerance, CAST(vol_cap AS DOUBLE) AS vol_cap,
       FIRST(cand ORDER BY sharpe DESC, vol ASC, ret DESC, cand ASC) AS allocation,
       FIRST(ret ORDER BY sharpe DESC, vol ASC, ret DESC, cand ASC) AS expected_return,
       FIRST(vol ORDER BY sharpe DESC, vol ASC, ret DESC, cand ASC) AS volatility,
       FIRST(sharpe ORDER BY sharpe DESC, vol ASC, ret DESC, cand ASC) AS sharpe_ratio
FROM sh JOIN caps ON caps.vol_cap IS NULL OR sh.vol <= caps.vol_cap GROUP BY risk_tolerance, vol_cap""", *FX,
    doubles=("vol_cap", "expected_return", "volatility", "sharpe_ratio")))
def q_portfolio_weight_search(spark, sf_dir):
    """G1: best-Sharpe long-only weights on a 1/10 grid per volatility cap."""
    return rounded(pf.portfolio_weight_search(fx.bars(spark, sf_dir), fx.portfolio(spark), 10))


@query("portfolio_outlook", Q(f"""WITH {MR}
SELECT AVG(portfolio_return) * 30 AS expected_total_return, STDDEV_SAMP(portfolio_return) * SQRT(30.0)
       AS expected_total_volatility, AVG(portfolio_return) * 252.0 AS expected_annual_return,
       STDDEV_SAMP(portfolio_return) * SQRT(252.0) AS expected_volatility FROM pr""", *FX,
    doubles=("expected_total_return", "expected_total_volatility", "expected_annual_return", "expected_volatility")))
def q_portfolio_outlook(spark, sf_dir):
    """Closed-form 30-day outlook from the portfolio return series."""
    return rounded(pf.portfolio_outlook(_port(spark, sf_dir), 30))


_HOLDINGS = """(SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 9 = 0 THEN -0.5 WHEN s_suppkey % 10 = 0 THEN 1.5
  ELSE CAST(s_acctbal AS DOUBLE) / 200000 END AS weight FROM supplier)"""


@query("validate_weights", Q(f"""SELECT symbol, weight, CASE WHEN weight <= 0 OR weight > 1 THEN 'weight out of range'
  WHEN SUM(weight) OVER (ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 1 + 1e-9
  THEN 'total above 100%' END AS reason FROM {_HOLDINGS}""", doubles=("weight",)))
def q_validate_weights(spark, sf_dir):
    """Weights checked for range and running total (valid rows have a
    null reason); the holdings stand in for a user's portfolio."""
    k = F.col("s_suppkey")
    weight = F.when(k % 9 == 0, -0.5).when(k % 10 == 0, 1.5).otherwise(F.col("s_acctbal").cast("double") / 200000)
    ok, bad = clean.validate_weights(fx.table(spark, sf_dir, "supplier").select(k.alias("symbol"), weight.alias("weight")))
    return rounded(ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad))


@query("symbols_without_data", Q("""SELECT symbol, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = p.symbol) AS has_data
FROM portfolio p""", "portfolio", "bars"))
def q_symbols_without_data(spark, sf_dir):
    """Portfolio members kept (semi join) or reported (anti join)."""
    kept, missing = align.symbols_without_data(fx.portfolio(spark), fx.bars(spark, sf_dir))
    return (kept.select("symbol", F.lit(True).alias("has_data"))
            .unionByName(missing.select("symbol", F.lit(False).alias("has_data"))))


@query("attach_weights", Q(f"WITH {MR}\nSELECT symbol, ts, ret, weight FROM mr JOIN portfolio USING (symbol)", *FX,
                           doubles=("ret", "weight")))
def q_attach_weights(spark, sf_dir):
    """Weights joined by key onto member returns."""
    p = fx.portfolio(spark)
    return rounded(align.attach_weights(pf.member_returns(fx.bars(spark, sf_dir), p), p))


_GRID = """grid AS (SELECT ts, symbol, ret FROM (SELECT DISTINCT ts FROM mr) CROSS JOIN (SELECT DISTINCT symbol FROM mr)
         LEFT JOIN mr USING (ts, symbol))"""


@query("align_outer", Q(f"WITH {MR},\n{_GRID}\nSELECT * FROM grid", *FX, doubles=("ret",)))
def q_align_outer(spark, sf_dir):
    """Member returns on the union of their dates, missing ones null."""
    return rounded(align.align_outer(pf.member_returns(fx.bars(spark, sf_dir), fx.portfolio(spark))))


@query("align_outer_zero", Q(f"WITH {MR},\n{_GRID}\nSELECT ts, symbol, COALESCE(ret, 0.0) AS ret FROM grid", *FX, doubles=("ret",)))
def q_align_outer_zero(spark, sf_dir):
    """Member returns on the union of their dates, missing ones 0."""
    return rounded(align.align_outer(pf.member_returns(fx.bars(spark, sf_dir), fx.portfolio(spark)), fill=0.0))


@query("union_dates", Q("SELECT DISTINCT ts FROM bars", "bars"))
def q_union_dates(spark, sf_dir):
    """Every date any symbol trades."""
    return align.union_dates(fx.bars(spark, sf_dir))


@query("common_dates", Q("""SELECT a.symbol, COUNT(*) AS shared FROM (SELECT DISTINCT symbol, ts FROM bars) a
JOIN (SELECT DISTINCT ts FROM market_index) m USING (ts) GROUP BY a.symbol""", "bars", "market_index"))
def q_common_dates(spark, sf_dir):
    """Dates that each symbol's bars share with the market index, counted."""
    bars = fx.bars(spark, sf_dir)
    shared = align.common_dates(bars, fx.market_index(spark, sf_dir, bars))
    return bars.select("symbol", "ts").distinct().join(shared, "ts").groupBy("symbol").agg(F.count(F.lit(1)).alias("shared"))


@query("missing_dates", Q("""WITH span AS (SELECT symbol, MIN(ts) AS lo, MAX(ts) AS hi FROM bars GROUP BY symbol),
cal AS (SELECT DISTINCT ts FROM bars)
SELECT s.symbol, c.ts FROM span s JOIN cal c ON c.ts BETWEEN s.lo AND s.hi
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.ts = c.ts)""", "bars"))
def q_missing_dates(spark, sf_dir):
    """Market trading days inside each symbol's span that it lacks."""
    bars = fx.bars(spark, sf_dir)
    return align.missing_dates(align.union_dates(bars), bars)
