"""Registered queries against their DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as ent
from tests.conftest import SF001

NAMES = ["technical_snapshot", "rsi_sma", "bollinger", "beta", "value_at_risk", "news_sentiment",
         "portfolio_metrics", "asof_ffill", "signal_backtest", "reward_rollup", "sector_top3", "ema_adjusted",
         "ema_recursive", "macd", "obv", "cumulative_return", "monthly_targets", "path_direction", "validate_weights", "common_dates",
         "latest_rewards", "model_status", "sample_range_200"]
NAMES += sorted(n for n, q in ent.queries().items()
                if n in ent.oracle_sql() and q.__module__.rpartition(".")[2] in ("q_operators", "q_extra", "q_misc", "q_training"))


#: A 200-row mean of cents is a rounding tie in the fourth decimal as often as not.
TIED = {"sma_200"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in "region nation supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = ent.queries()[name](spark, SF001)
    cols = df.columns
    srows = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=str)
    res = con.execute(ent.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    perm = [ocols.index(c) for c in cols]
    orows = sorted((tuple(_norm(r[i]) for i in perm) for r in res.fetchall()), key=str)
    assert len(srows) == len(orows)
    ties = 0
    for a, b in zip(srows, orows):
        for col, x, y in zip(cols, a, b):
            if isinstance(x, float) and isinstance(y, float) and x != y:
                assert abs(x - y) <= 1.5e-4
                ties += col not in TIED
            else:
                assert x == y
    assert ties <= len(srows) // 200  # a mean on a rounding tie, summed in another order


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert "technical_score" in df.columns


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())


def test_reward_rules_by_hand(spark):
    """Values worked out from the rules: base 100, tier, bonus, clamp."""
    from pyspark.sql import functions as F

    from tickframe.functions import rewards as rw

    row = spark.range(1).select(*[f(F.lit(e), F.lit(a)).alias(f"c{i}") for i, (f, e, a) in enumerate([
        (rw.reward_price, 0.005, 0.1), (rw.reward_price, 0.05, 0.1), (rw.reward_price, 0.3, 0.0), (rw.reward_trend, 0.05, 1.0),
        (rw.reward_trend, 0.9, 0.0), (rw.reward_risk, 0.05, 0.2), (rw.reward_sentiment, 0.05, 50.0), (rw.reward_fundamental, 0.05, 0.1)])]).first()
    assert list(row) == [800.0, 150.0, -200.0, 500.0, -100.0, 150.0, 300.0, 150.0]


def test_human_number(spark):
    from pyspark.sql import functions as F

    from tickframe.functions.signals import human_number

    got = spark.createDataFrame([(12.345,), (-5e6,), (1234.0,), (2.5e9,), (None,)], "x double").select(human_number(F.col("x"))).collect()
    assert [r[0] for r in got] == ["12.35", "-5000000.00", "1.2K", "2.5B", None]


def test_latest_rewards_and_status(spark):
    from tickframe.operators import scores

    runs = spark.createDataFrame([("a", 1, 500.0, 3), ("a", 2, 200.0, 4), ("a", 2, 100.0, 9), ("b", None, 50.0, 1), ("c", 7, None, None)],
                                 "symbol string, trained_at int, total_reward double, training_samples long")
    got = {r.symbol: tuple(r)[1:] for r in scores.latest_rewards(runs).collect()}
    assert got == {"a": (2, 200.0, 4, 3, 0.02), "b": (None, 50.0, 1, 1, 0.005), "c": (7, None, None, 1, None)}
    assert scores.latest_rewards(runs.limit(0)).count() == 0
    rewards = spark.createDataFrame([("a", 1.0, -1.0, 0.0, None, 3.0), ("a", 3.0, 0.0, 0.0, None, None)], "symbol string, " + ", ".join(
        f"reward_{m} double" for m in scores.MODELS))
    got = {r.model: (r.weight, r.status) for r in scores.model_status(rewards).collect()}
    assert got == {"price": (2.0, "Good"), "trend": (-0.5, "Needs Training"), "risk": (0.0, "Needs Training"),
                   "sentiment": (0.0, "Needs Training"), "fundamental": (3.0, "Good")}
