"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tickframe.llm import multi_index as M
from tickframe.llm import queries
from tickframe.llm import segment_topk as S
from tickframe.llm import vectors


def load(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, float) for r in rows}


def best(v, own, k, score):
    got = sorted(((-score(v[own], x), i) for i, x in v.items() if i != own))
    return [(own, n + 1, i, -s) for n, (s, i) in enumerate(got[:k])]


def cosine(a, b):
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


def product(a, b):
    return sum(int(x) * int(y) for x, y in zip(np.floor(64 * a), np.floor(64 * b)))


def test_exact_query(spark):
    v = load(spark, SF01)
    want = [r for q in sorted(v) if q % 20 == 0 for r in best(v, q, 20, product)]
    assert sorted(map(tuple, queries.QUERIES["op5_segment_topk"](spark, SF01).collect())) == want


def test_recall_and_scores(spark):
    v = load(spark, SF01)
    got = queries.QUERIES["op4_multi_index"](spark, SF01).collect()
    want = {(q, r[2]) for q in v if q % 50 == 0 for r in best(v, q, 5, cosine)}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    for r in got:
        assert r.score == pytest.approx(cosine(v[r.query_id], v[r.vec_id]), abs=1e-14)
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def odd(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], "x") for i in range(300)]
    rows += [(i, [1.0, -0.5, 0.25, 0.0, -0.0, 2.0], "same") for i in range(300, 400)]
    rows += [(400, None, "a"), (401, [], "b"), (402, [1.0, None], "c"), (403, [float("nan")] * 6, "d"), (404, [float("inf")] * 6, "e"),
             (405, [0.0] * 6, "f"), (406, [1.0, 2.0], "short"), (None, [1.0] * 6, "g"), (20, rows[20][1], "again"), (-20, [0.3] * 6, "neg")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v + [0.0] * (6 - len(v)))
    return out


def test_odd_rows_exact(spark, monkeypatch):
    rows, df = odd(spark)
    monkeypatch.setattr(S, "BLOCK_ROWS", 64)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 8)
    v = usable(rows, True)
    want = sorted(r for q in v if q % 20 == 0 for r in best(v, q, 20, product))
    assert sorted(map(tuple, S.top_k(df, F.col("vec_id") % 20 == 0).collect())) == want
    assert S.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_odd_rows_nearest(spark, monkeypatch):
    rows, df = odd(spark)
    monkeypatch.setattr(M, "BLOCK_ROWS", 64)
    monkeypatch.setattr(M, "BLOCK_QUERIES", 8)
    v = usable(rows, False)
    want = sorted(r[:3] for q in v if q % 20 == 0 for r in best(v, q, 5, cosine))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in M.nearest(df, F.col("vec_id") % 20 == 0, share=1.0).collect())
    assert got == want
    assert M.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = M.nearest(df.filter("vec_id IN (20, 21, 22)"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in few] == [1, 2]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    x = np.floor(64 * rng.normal(size=(500, 64)) * np.linspace(0.1, 2, 64))
    q = x[0] + np.floor(rng.normal(size=64) * 3)
    rows = vectors.Distinct(x, np.arange(500), 5)
    levels, asked = [S.statistics(rows.vectors, s) for s in S.LEVELS], [S.statistics(q[None], s)[0] for s in S.LEVELS]
    true = rows.vectors @ q
    last = None
    for level, own in zip(levels, asked):
        bound = level @ own
        assert (bound >= true - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound
    (found,), computed = S.best_of(rows, levels, q[None], np.array([-1]), 5)
    assert found[1].tolist() == sorted(true.astype(int).tolist(), reverse=True)[:5] and computed < 500


def test_large_components():
    big = np.array([[2.0 ** 40, 2.0 ** 40], [1.0, -(2.0 ** 40)]])
    assert S.exact_scores(big, big[[0, 0]]).tolist() == [(1 << 63) - 1, 2 ** 40 - 2 ** 80 if 2 ** 40 - 2 ** 80 > -(1 << 63) else -((1 << 63) - 1)]


def test_walk_goes_by_summed_distance():
    first, second = np.array([0.5, 0.1, 0.9]), np.array([0.3, 0.2])
    counts = np.ones((3, 2), int)
    assert M.walk(first, second, counts, 3) == {1: 0b11, 0: 0b10}
    assert M.walk(first, second, counts, 99) == {0: 3, 1: 3, 2: 3}


def test_tiny_and_huge_vectors_take_part(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    scale = 10.0 ** np.array([-170, 170, 300, -300, 0, 3, -3, 1] * 5)
    rows = [(k, (base[k % 20] * s).tolist()) for k, s in enumerate(scale)]
    got = M.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, k=5, share=1.0).collect()
    assert len(got) == 10 * 5 and all(-1.0000001 < r["score"] < 1.0000001 for r in got)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    for r in got:
        assert abs(r["score"] - unit[r["query_id"] % 20] @ unit[r["vec_id"] % 20]) < 1e-9
    assert {r["query_id"]: r["vec_id"] for r in got if r["rank"] == 1} == {q: (q + 20) % 40 for q in range(0, 40, 4)}


def several(spark, k):
    """Ids with different, parallel and repeated vectors, queries among them."""
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.integers(0, 60, 400)]
    rows += [(20, [float(x)] * 4) for x in (1, 2, 4, 8)] + [(40, [1.0, 1.0, 1.0, 1.0])] * 3 + [(i, [3.0, 3.0, 3.0, 3.0]) for i in (7, 8, 8, 9)]
    rows = [(i, v) for i, v in rows if any(v)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def ranks(rows, k, score):
    """All different rows but those of the query's id; a query id asks with its smallest vector."""
    rows = {(i, tuple(x + 0.0 for x in v)) for i, v in rows}
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        own = np.array(min(v for i, v in rows if i == q))
        found = sorted((-score(own, np.array(v)), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("k", [3, 20])
def test_different_vectors_under_one_id(spark, monkeypatch, k):
    rows, df = several(spark, k)
    is_query = F.col("vec_id") % 20 == 0
    assert sorted(map(tuple, S.top_k(df, is_query, k=k).collect())) == ranks(rows, k, product)
    got = sorted(map(tuple, M.nearest(df, is_query, k=k, share=1.0).collect()))
    want = ranks(rows, k, lambda a, b: round(cosine(a, b), 9))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-8)
    assert {(q, v) for q, _, v, _ in got} <= {(q, i) for q in {r[0] for r in got} for i, _ in rows if i != q}
    for block, size in (("BLOCK_ROWS", 32), ("BLOCK_QUERIES", 1)):
        monkeypatch.setattr(S, block, size)
    assert sorted(map(tuple, S.top_k(df, is_query, k=k).collect())) == ranks(rows, k, product)
