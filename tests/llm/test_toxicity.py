"""Toxicity: maximal segments against their definition, calibration, held-out ranking."""

import numpy as np
import pytest

from tests.conftest import SF01
from tickframe.llm import queries
from tickframe.llm import toxicity as T


def by_definition(x):
    """All maximal-scoring segments: take the best segment (of the shortest),
    then the same on its left and right."""
    best = None
    for a in range(len(x)):
        for b in range(a + 1, len(x) + 1):
            s = x[a:b].sum()
            if s > 1e-12 and (best is None or s > best[2] + 1e-12 or abs(s - best[2]) <= 1e-12 and b - a < best[1] - best[0]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return by_definition(x[:a]) + [best] + [(i + b, j + b, t) for i, j, t in by_definition(x[b:])]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(1)
    for n in range(1, 26):
        for _ in range(12):
            x = rng.normal(-0.2, 1, n)
            got, want = T.segments(x), by_definition(x)
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert T.segments(np.zeros(0)) == [] and T.segments(np.array([-1.0, 0.0])) == []


def test_log_odds_and_lambda():
    w = T.log_odds(np.array([100.0, 0, 0]), np.array([0.0, 0, 10]))
    assert w[2] > 2 and w[0] < 0 and w[1] == pytest.approx(0)
    assert (T.log_odds(np.ones(4), np.zeros(4)) == 0).all()
    lam = T.solve_lambda(np.array([1.0, -1.0]), np.array([0.25, 0.75]))
    assert lam == pytest.approx(np.log(3))
    assert T.solve_lambda(np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_ranking(spark):
    got = queries.QUERIES["op3_toxicity"](spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").collect()
    one, zero = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + (a == b) / 2 for a in one for b in zero]) > 0.8
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert got.count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def sample(spark):
    rows = [(k, f"the day was {'vile rotten scum' if k % 4 == 0 else 'long and calm here'} in town {k % 7}", k) for k in range(400)]
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    odd = [(900, None, 1), (901, "", 2), (902, "x" * 80000, 3), (903, "vile " * 9000, 4), (0, rows[0][1], 5), (None, "vile rotten scum", 6)]
    return (spark.createDataFrame(rows + odd, "doc_id long, text string, score long"),
            spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))


def test_odd_rows(spark):
    docs, labels = sample(spark)
    model = T.fit(docs, labels)
    got = T.score(docs, model).select("row.doc_id", "row.text", "score", "passages").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.score >= 0.3) == (r.doc_id % 4 == 0)
            for p in r.passages:
                assert "vile" in r.text[p.start:p.end] or "scum" in r.text[p.start:p.end] or "rotten" in r.text[p.start:p.end]
    lowest = min(r.score for r in got)
    assert [r.score for r in got if r.doc_id in (900, 901)] == [lowest, lowest]
    kept = T.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901, 1, 2, 3}


def test_no_labels_and_no_rows(spark):
    docs, labels = sample(spark)
    none = T.score(docs, T.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert len(none) == 1 and none[0].score < 0.3
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0
