"""The one-exchange layout: shared sorts, carries and joins that don't widen or repeat what travels."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tickframe.operators import indicators as ind
from tickframe.operators import scores, series, stats
from tickframe.plans import analysis
from tickframe.plans import models as ml
from tickframe.plans.catalog import QUERIES, load_all
from tickframe.sources import fixtures as fx

DAY = dt.date(1995, 1, 1)


def _bars(spark, symbols=2, days=90, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        for d in range(days):
            c = float(r.uniform(50, 150))
            rows.append((s, DAY + dt.timedelta(days=d), c, c + 1, c - 1, c, float(r.integers(1, 50))))
    return spark.createDataFrame(rows, "symbol bigint, ts date, open double, high double, low double, close double, volume double")


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _chain(plan):
    """The operators from the result down to the join with the block table."""
    lines = [re.search(r"[A-Z]\w+", x).group() for x in plan.splitlines()[1:] if re.search(r"[A-Z]\w+", x)]
    cut = lines.index("Exchange") + 1
    return lines[:cut]


def test_windows_share_their_sorts(spark, capsys):
    chain = _chain(_plan(series.finish(analysis.technical_frame(_bars(spark))), capsys))  # five smoothing constants
    assert chain.count("Window") > 10 and chain.count("Sort") == 2


def test_long_spans_share_one_more_sort(spark, capsys):
    p = series.prepare(_bars(spark))
    for span in (5, 9, 12, 26, 50, 100, 200):
        p = ind.ema_adjusted(p, span)
    assert _chain(_plan(series.finish(p), capsys)).count("Sort") == 3


def test_ewm_of_every_span_over_many_runs(spark):
    r = np.random.default_rng(1)
    x = r.uniform(1, 1000, 9000)
    days = spark.createDataFrame([(0, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "symbol bigint, ts date, close double")
    for kw in ({}, {"block_rows": 2500, "halo_back": 30000}):
        p = series.prepare(days, **kw)
        for span in (2, 5, 50, 200):
            p = ind.ema_adjusted(p, span)
        got = series.finish(p).orderBy("ts").toPandas()
        for span in (2, 5, 50, 200):
            np.testing.assert_allclose(got[f"ema_{span}"], got.close.ewm(span=span).mean(), rtol=1e-11)


def test_ewm_with_nulls_where_a_run_begins(spark):
    back = series.ewm_block_rows(1 - 2 / 13)
    x = [None if i in (0, 1, 50, back, back + 1, 2 * back + 3) else float(i % 17) for i in range(3 * back)]
    df = spark.createDataFrame([(0, DAY + dt.timedelta(days=i), v) for i, v in enumerate(x)], "symbol bigint, ts date, close double")
    got = [r.ema_12 for r in ind.ema_adjusted(df, 12).orderBy("ts").collect()]
    assert [i for i, v in enumerate(got) if v is None] == [0, 1, back, back + 1]
    q, y = 1 - 2 / 13, 0.0
    for i, v in enumerate(x):
        y = y * q + (v or 0.0)
        assert got[i] is None or got[i] == pytest.approx(y * (1 - q) / (1 - q ** (i + 1)), rel=1e-11)


def test_nulls_in_key_and_time_stay(spark):
    rows = [(None, DAY, 1.0), (None, None, 2.0), (1, None, 3.0), (1, DAY, 4.0), (1, DAY + dt.timedelta(days=400), 5.0)]
    df = spark.createDataFrame(rows, "symbol bigint, ts date, close double")
    for size in (100, 1):
        got = series.finish(series.prepare(df, block_rows=size), keep_index=True).collect()
        assert sorted((r.symbol or 0, r._rn, r._n, r.close) for r in got) == [(0, 0, 2, 2.0), (0, 1, 2, 1.0), (1, 0, 3, 3.0), (1, 1, 3, 4.0), (1, 2, 3, 5.0)]


def test_dimension_keys_that_repeat_don_t_repeat_bars_in_windows(spark):
    b = _bars(spark)
    f = spark.createDataFrame([(0, 1.5, 2.0), (0, None, 3.0), (7, 1.0, 1.0)], "symbol bigint, beta double, pe double")
    n = spark.createDataFrame([(0, 61.0, 4), (0, 62.0, 5)], "symbol bigint, sentiment_score double, news_count int")
    m = spark.createDataFrame([(DAY, 10.0), (DAY + dt.timedelta(days=40), 11.0)], "ts date, cpi double")
    wide = ml.wide_feature_table(b, f, n, m)
    assert wide.filter("symbol = 0").count() == 90 * 4 and wide.filter("symbol = 1").count() == 90
    want = {(r.symbol, r.ts): r.sma_20 or 0.0 for r in ind.sma(b, 20).collect()}
    for r in wide.collect():
        assert r.sma_20 == pytest.approx(want[r.symbol, r.ts])
        assert (r.beta, r.pe, r.sentiment_score, r.news_count) in ((1.0, 0.0, 50.0, 0), *((x, y, s, c) for x, y in ((1.5, 2.0), (1.0, 3.0)) for s, c in ((61.0, 4), (62.0, 5))))


def test_wide_table_shuffles_narrow_rows_only(spark, capsys):
    b = _bars(spark)
    f = spark.createDataFrame([(0, 1.5)], "symbol bigint, beta double")
    n = spark.createDataFrame([(0, 61.0, 4)], "symbol bigint, sentiment_score double, news_count int")
    m = spark.createDataFrame([(DAY, 10.0)], "ts date, cpi double")
    chain = _chain(_plan(ml.wide_feature_table(b, f, n, m), capsys))
    assert chain.count("Window") > 10 and chain.count("Sort") == 2 and "SortMergeJoin" not in chain


def test_linear_forecast_from_one_reading(spark, capsys):
    b = _bars(spark, symbols=3, days=140)
    b = b.withColumns({c: F.col(c) + 1e6 for c in ("open", "high", "low", "close")})
    whole = {(r.symbol, r.day): r.predicted for r in ml.forecast_linear(b, 5).collect()}
    rows = ml.linear_features(b).toPandas().sort_values(["symbol", "_rn"])
    for s, g in rows.groupby("symbol"):
        x = g[ml.LINEAR_FEATURES].to_numpy(float)
        mean = x.mean(0)
        w = np.linalg.lstsq(x - mean, g.close - g.close.mean(), rcond=1e-12)[0]
        for k in range(1, 6):
            want = g.close.mean() - w @ mean + 0.99 ** (k - 1) * (w @ x[-1])
            assert whole[s, k] == pytest.approx(want, rel=1e-6)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = {(r.symbol, r.day): r.predicted for r in ml.forecast_linear(b, 5, moments=ml.linear_moments(b)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert cut == pytest.approx(whole, rel=1e-9)
    plan = _plan(ml.forecast_linear(b, 5), capsys)
    assert "SortMergeJoin" not in plan[:plan.index("Window")]  # no second reading for the means


def test_ratings_join_in_a_fixed_number_of_tasks(spark):
    """Few shuffled bytes make no reason to join, sort and hash the rows in few tasks."""
    from tests.conftest import SF001
    from tickframe.sources import fixtures as fx

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        got = fx.ratings(spark, SF001)
        assert got.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got.count() == got.distinct().count() > 0


def test_bars_travel_once_for_all_indices(spark, capsys):
    """Bars are dealt to the indices after their exchange, and an index's first row
    of a block follows its last of an earlier one, also over a block without any."""
    kept = _bars(spark, symbols=3, days=200).filter("(dayofyear(ts) + symbol) % 7 != 0")
    r = np.random.default_rng(5)
    gaps = {"A": lambda d: True, "B": lambda d: d % 3 != 0, "C": lambda d: d < 40 or d > 150, None: lambda d: d % 2 == 0}
    rows = [(name, DAY + dt.timedelta(days=d), float(r.uniform(90, 110))) for name, on in gaps.items() for d in range(-5, 210) if on(d)]
    indices = spark.createDataFrame(rows, "index_name string, ts date, close double")
    j = kept.toPandas().merge(indices.toPandas().rename(columns={"close": "m_close"}), on="ts").sort_values(["symbol", "ts"])
    j["index_name"] = j["index_name"].fillna("none")
    for c, name in (("close", "r_s"), ("m_close", "r_m")):
        j[name] = j[c] / j.groupby(["symbol", "index_name"])[c].shift() - 1
    want = j.sort_values(["symbol", "index_name", "ts"])
    for layout in ({}, {"block_rows": 20}):
        got = stats._returns_per_index(kept, indices, by="symbol", **layout).fillna("none", ["index_name"]).toPandas()
        got = got.sort_values(["symbol", "index_name", "ts"])
        assert len(got) == len(want) and (got.ts.values == want.ts.values).all()
        for name in ("r_s", "r_m"):
            np.testing.assert_allclose(got[name].astype(float), want[name], rtol=1e-12)
    found = {(x.symbol, x.index_name or "none"): x for x in stats.index_correlation(kept, indices).collect()}
    assert len(found) == 12
    for key, g in want.groupby(["symbol", "index_name"]):
        assert found[key].common_dates == len(g) and abs(found[key].correlation - g.r_s.corr(g.r_m)) < 1e-9
    lines = _plan(stats.index_correlation(kept, indices), capsys).splitlines()
    dealt = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert any("Window [lag" in x for x in lines[:dealt]) and not any("hashpartitioning(symbol" in x and "index_name" not in x for x in lines[:dealt])


def test_indices_from_one_reading_of_the_bars(spark, capsys):
    """A symbol with several sector rows counts once for the market, and a sector
    of the market's name stays an index of its own."""
    bars = _bars(spark, symbols=3, days=2)
    sectors = [(0, "X"), (0, "X"), (1, "MARKET"), (1, None), (None, "Y")]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fx, "sector_members", lambda *_: spark.createDataFrame(sectors, "symbol bigint, sector string"))
        got = fx.index_series(spark, "", bars)
        assert _plan(got, capsys).count("Scan ExistingRDD[symbol") == 2  # the bars and the sectors
        rows = got.collect()
    b = bars.toPandas()
    want = []
    for name, of in (("MARKET", b), ("X", b[b.symbol == 0]), ("MARKET", b[b.symbol == 1]), ("none", b[b.symbol == 1])):
        for ts, g in of.groupby("ts"):
            want += [(name, ts, round((g.close * g.volume).sum() / g.volume.sum(), 6), g.volume.sum() * (2 if name == "X" else 1))]
    assert sorted((x.index_name or "none", x.ts, round(x.close, 6), x.volume) for x in rows) == sorted(want)


def test_market_overview_from_one_reading(spark, capsys):
    rows = [(80.0, "uptrend", "low"), (90.0, "strong_uptrend", None), (None, "sideways", None), (70.0, None, "low"), (60.0, "uptrend", "high")]
    given = spark.createDataFrame(rows, "overall_score double, trend string, risk_level string")
    found = scores.market_overview(given)
    assert _plan(found, capsys).count("Scan ExistingRDD") == 1
    assert [tuple(r) for r in found.collect()] == [(75.0, 5, "bullish", None, "increase exposure")]  # ties: no level comes first
    assert [tuple(r) for r in scores.market_overview(given.limit(0)).collect()] == [(None, 0, "bearish", None, "reduce exposure")]


def test_overall_score_reads_line_items_once_for_its_bars(spark, capsys):
    load_all()
    plan = _plan(QUERIES["overall_score"](spark, SF001), capsys)
    assert plan.count("l_shipdate") == 0  # the bars are stored
