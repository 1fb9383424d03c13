"""Covariances from moments and the weight search against numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tickframe.operators import portfolio as pf


@pytest.fixture
def bars(spark):
    """Members with gaps, one with a single bar, one that shares no date, one outside the portfolio."""
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=60).date
    rows = [(s, d, float(1e6 + rng.normal(0, 50))) for s in (1, 2, 3, 9) for d in days[:40] if rng.random() < 0.9]
    rows += [(4, days[3], 10.0)] + [(5, d, float(rng.uniform(5, 6))) for d in days[45:]]
    return spark.createDataFrame(rows, "symbol long, ts date, close double")


@pytest.fixture
def weights(spark):
    return spark.createDataFrame([(s, 0.2) for s in (1, 2, 3, 4, 5, 6)], "symbol long, weight double")


def _wanted(bars):
    table = bars.toPandas().sort_values("ts")
    table["ret"] = table.groupby("symbol")["close"].pct_change(fill_method=None)
    wide = table[table.symbol != 9].pivot(index="ts", columns="symbol", values="ret")
    return wide.mean() * 252, wide.cov(min_periods=2) * 252


def test_covariances(spark, bars, weights):
    got = {(r.sym_a, r.sym_b): r["cov"] for r in pf.covariance_matrix(bars, weights).collect()}
    cov = _wanted(bars)[1]
    want = {(a, b): cov.loc[a, b] for a in cov for b in cov if not np.isnan(cov.loc[a, b])}
    assert {k for k, v in got.items() if v is not None} == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    assert pf.covariance_matrix(bars.limit(0), weights).count() == 0
    assert pf.covariance_matrix(bars, weights.limit(0)).count() == 0


def test_weight_search(spark, bars, weights):
    mu, cov = (x.reindex([1, 2, 3, 4, 5]) for x in _wanted(bars))
    mu, cov = mu.fillna(0).to_numpy(), cov.reindex(columns=[1, 2, 3, 4, 5]).fillna(0).to_numpy()
    best = {}
    for units in itertools.product(range(5), repeat=5):
        if sum(units) == 4:
            w = np.array(units) / 4
            ret, vol = w @ mu, np.sqrt(max(w @ cov @ w, 0))
            for name, cap in pf.VOL_CAPS.items():
                if cap is None or vol <= cap:
                    best[name] = max(best.get(name, -np.inf), ret / vol if vol > 0 else 0.0)
    got = {r.risk_tolerance: r.sharpe_ratio for r in pf.portfolio_weight_search(bars, weights, 4).collect()}
    assert got == pytest.approx(best, rel=1e-9)
