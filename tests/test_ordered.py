"""Exact percentiles, global prefix scans and date gaps."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import align, clean, ordered

Q = {"a": 0.01, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0, "f": 0.0}


@pytest.mark.parametrize("scales", [(256,), (1, 16, 1024)])
def test_percentiles_equal_numpy(spark, scales):
    rng = np.random.default_rng(3)
    data = {"hot": rng.normal(0, 0.02, 4000).tolist(), "ties": [0.0] * 900 + [-1.5] * 70 + [2.5] * 31, "one": [7.25], "two": [1.0, 3.0],
            "wide": (rng.normal(size=333) * 10.0 ** rng.integers(-300, 300, 333)).tolist(), None: [1.0, 2.0, 4.0]}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("none", None), ("hot", None)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: r for r in ordered.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), "k", "x", Q, scales=scales).collect()}
    assert set(got) == {*data, "none"}
    assert all(got["none"][c] is None for c in Q)
    for k, v in data.items():
        for c, q in Q.items():
            assert got[k][c] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-300), (k, c)


def test_percentiles_special_values(spark):
    rows = [("i", x) for x in (float("-inf"), -1.0, 0.0, -0.0, 5e-324, float("inf"), float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    got = ordered.exact_percentiles(df, "k", "x", {f"p{i}": i / 6 for i in range(7)}).first()
    assert [str(got[f"p{i}"] + 0.0) for i in range(7)] == ["-inf", "-1.0", "0.0", "0.0", "5e-324", "inf", "nan"]
    assert ordered.exact_percentiles(df.filter("x > 9e9 and x < 1"), "k", "x", {"p": 0.5}).count() == 0


def test_code_never_falls(spark):
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-320, 308, 2000), rng.normal(size=2000), [0.0]]))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    code = [r[0] for r in df.sort("x").select(ordered._code(F.col("x"), 256)).collect()]
    assert code == sorted(code)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_prefix_over_a_global_order(spark, n):
    rng = random.Random(n)
    rows = [(f"k{i:05d}", None if rng.random() < 0.1 else float(rng.randrange(-50, 50))) for i in range(n)]
    shuffled = rng.sample(rows, n)
    df = spark.createDataFrame(shuffled, "k string, x double")
    got = ordered.prefix(ordered.spread(df, "k", ranges=13), ["k"], [(F.col("x"), "sum", "s"), (F.col("x"), "max", "m")])
    total, top, want = None, None, []
    for k, x in rows:
        if x is not None:
            total, top = (total or 0.0) + x, x if top is None else max(top, x)
        want.append((k, x, total, top))
    assert sorted((r["k"], r["x"], r["s"], r["m"]) for r in got.collect()) == want
    assert "Window" not in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines()
                                   if line.strip(" :+-").startswith("Window") and ordered.RANGE not in line)


def test_validate_weights_running_total(spark):
    df = spark.createDataFrame([("d", 0.5), ("a", 0.4), ("c", 0.6), ("b", -0.1), ("e", 0.1)], "symbol string, weight double")
    ok, bad = clean.validate_weights(df)
    assert sorted(r["symbol"] for r in ok.collect()) == ["a", "c"]
    assert sorted((r["symbol"], r["reason"]) for r in bad.collect()) == [
        ("b", "weight out of range"), ("d", "total above 100%"), ("e", "total above 100%")]


def test_outer_alignment_and_gaps(spark):
    rng = random.Random(8)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60) if k % 7 < 5]
    have = {(s, d): rng.random() for s in "abc" for d in days if rng.random() < {"a": 0.9, "b": 0.1, "c": 0.5}[s]}
    union = sorted({d for _, d in have})
    df = spark.createDataFrame([(s, d, v) for (s, d), v in have.items()], "symbol string, ts date, ret double")
    for fill in (None, 0.0):
        got = sorted((r["symbol"], r["ts"], r["ret"]) for r in align.align_outer(df, fill=fill).collect())
        assert got == [(s, d, have.get((s, d), fill)) for s in "abc" for d in union]
    gaps = align.date_gaps(df, df)
    holes = sum(1 for s in "abc" for i, d in enumerate(union) if (s, d) not in have and (i == 0 or (s, union[i - 1]) in have))
    assert gaps.count() == holes
    missing = sorted(tuple(r) for r in align.missing_dates(df.select("ts"), df).collect())
    span = {s: (min(d for t, d in have if t == s), max(d for t, d in have if t == s)) for s in "abc"}
    assert missing == [(s, d) for s in "abc" for d in union if span[s][0] <= d <= span[s][1] and (s, d) not in have]
    assert align.align_outer(df.limit(0)).count() == 0
