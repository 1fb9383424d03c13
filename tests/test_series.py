"""Series layout and EWM: pandas cross-checks, many blocks == one block, windows beyond a block."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from tickframe.operators import indicators as ind
from tickframe.operators import series
from tickframe.sources import fixtures as fx


def test_ewm_and_rsi_match_pandas(spark):
    p = series.prepare(fx.bars(spark, SF001))
    p = ind.ema_adjusted(p, 12)
    p = ind.macd(p)
    p = ind.rsi_wilder(p)
    p = ind.ema_recursive(p, 26)
    out = series.finish(p, keep_index=True).toPandas().sort_values(["symbol", "_rn"])
    for _, g in out.groupby("symbol"):
        c = g.close.reset_index(drop=True)
        e12 = c.ewm(span=12).mean()
        m = e12 - c.ewm(span=26).mean()
        np.testing.assert_allclose(g.ema_12.values, e12.values, rtol=1e-12)
        np.testing.assert_allclose(g.macd_signal.values, m.ewm(span=9).mean().values, rtol=1e-9, atol=1e-7)
        np.testing.assert_allclose(g.ema_rec_26.astype(float).values,
                                   c.ewm(span=26, min_periods=26, adjust=False).mean().values, rtol=1e-12)
        d = c.diff()
        up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        dn = (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        ref = pd.Series(np.where(dn == 0, 100, 100 - 100 / (1 + up / dn)))
        np.testing.assert_allclose(g.rsi_wilder_14.astype(float).values, ref.values, rtol=1e-12)


def _run(spark, tb, **kw):
    p = series.prepare(tb, ts=["ts", "event_id"], **kw)
    p = ind.sma(p, 20)
    p = ind.macd(p)
    p = ind.obv(p)
    p = ind.forward_return(p, 30)
    p = ind.drawdown_series(p)
    return series.finish(p, keep_index=True).toPandas().sort_values(["symbol", "_rn"]).reset_index(drop=True)


def test_many_blocks_equal_one(spark):
    tb = fx.tick_bars(spark, SF01)
    a = _run(spark, tb)
    for block_rows in (1800, 300):  # halos within a block, and over several blocks
        b = _run(spark, tb, block_rows=block_rows, halo_back=2000, halo_fwd=64)
        assert len(a) == len(b) == 10000
        for c in ["_rn", "_n", "sma_20", "obv", "fwd_return_30", "drawdown"]:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12, equal_nan=True)
        np.testing.assert_allclose(a["macd"], b["macd"], rtol=1e-9, atol=1e-9)


def test_windows_larger_than_block_and_halo(spark):
    """On a raw frame the halo is what the operator looks back and ahead; on a
    prepared one a window that does not fit is refused, never cut."""
    tb = fx.tick_bars(spark, SF01)
    ops = [(lambda d: ind.forward_return(d, 100), "fwd_return_100"), (lambda d: ind.forward_price_std(d, 100), "fwd_price_std_100"),
           (lambda d: ind.sma(d, 450), "sma_450"), (lambda d: ind.momentum(d, 450), "momentum_450")]
    whole = series.prepare(tb, ts=["ts", "event_id"])
    small = series.prepare(tb, ts=["ts", "event_id"], block_rows=500, halo_back=400, halo_fwd=64)
    fits = series.prepare(tb, ts=["ts", "event_id"], block_rows=500, halo_back=450, halo_fwd=100)
    for op, name in ops:
        want = series.finish(op(whole)).filter(F.col(name).isNotNull()).count()
        assert want == 10000 - 5 * (100 if "fwd" in name else 449 if "sma" in name else 450)
        assert series.finish(op(fits)).filter(F.col(name).isNotNull()).count() == want
        with pytest.raises(series.HaloTooSmall):
            op(small)


def test_pipeline_adds_up_what_it_looks_back(spark):
    tb = fx.tick_bars(spark, SF01)
    p = series.prepare(tb, ts=["ts", "event_id"], block_rows=1024, halo_back=50)
    p = ind.sma(ind.sma(p, 20), 20, "sma_20", name="again")
    assert series.layout_of(p)["used_back"] == 38
    with pytest.raises(series.HaloTooSmall):
        ind.sma(p, 20, "again", name="third")
    with pytest.raises(series.HaloTooSmall):
        ind.ema_adjusted(series.prepare(tb, ts=["ts", "event_id"], halo_back=200), 26)


def test_blocks_split_a_hot_symbol(spark):
    tb = fx.tick_bars(spark, SF01)
    p = series.prepare(tb, ts=["ts", "event_id"], block_rows=700, halo_back=600)
    blocks = p.filter("_core").groupBy("symbol").agg({"_blk": "max"}).collect()
    assert all(r[1] >= 2 for r in blocks)  # each ~2000-row symbol spans three 700-row blocks


def test_long_rolling_std_reads_no_frame_anew(spark, capsys):
    """Lengths over SHORT_ROWS are merged from moments of powers of two: equal to
    the sliding frames in many blocks, with nulls, and exactly 0 for equal values."""
    rng = np.random.default_rng(7)
    x = 100.0 + rng.normal(size=1200)
    x[600:900] = 0.1
    rows = [(1, i, None if i % 401 == 400 else float(v)) for i, v in enumerate(x)] + [(None, i, float(i % 5)) for i in range(40)]
    given = spark.createDataFrame(rows, "symbol bigint, ts int, x double").withColumn("ts", F.timestamp_seconds(F.col("ts") * 60))
    lengths = (2, 5, 33, 50, 252)
    for block_rows in (1 << 18, 300):
        p = series.prepare(given, block_rows=block_rows, halo_back=300)
        for n in lengths:
            p = p.withColumn(f"was_{n}", series.full_rows(n, F.stddev_samp("x"), F.col("x")))
        got = series.finish(series.rolling_std(p, "x", {n: f"is_{n}" for n in lengths}))
        assert got.columns == ["symbol", "ts", "x", *[f"was_{n}" for n in lengths], *[f"is_{n}" for n in lengths]]
        got = got.toPandas()
        assert len(got) == len(rows)
        for n in lengths:
            np.testing.assert_allclose(got[f"is_{n}"].astype(float), got[f"was_{n}"].astype(float), rtol=1e-12, atol=1e-14)
        assert (got.is_50 == 0).sum() == 152 + 49  # rows 600 to 800 and 802 to 899
    capsys.readouterr()
    ind.rolling_volatility(series.prepare(fx.bars(spark, SF001)), (5, 252)).explain()
    assert "-251" not in capsys.readouterr().out
