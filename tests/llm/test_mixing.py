"""Mixing against weights solved in plain Python, and budgets per source."""

import math
from collections import defaultdict

import pytest

from tests.conftest import SF001
from tickframe.llm import mixing as M
from tickframe.llm import queries


def solve(tokens, max_repeats, cover):
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def repeats(a):
        e = {s: v ** (a - 1) for s, v in p.items()}
        z = min(e.values()) if cover else sum(v ** a for v in p.values())
        return {s: v / z for s, v in e.items()}
    low, high = 0.0, 1.0
    if max(repeats(0.0).values()) <= max_repeats:
        return repeats(0.0)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if max(repeats(mid).values()) <= max_repeats else (mid, high)
    return repeats(high)


@pytest.mark.parametrize("cover", [False, True])
def test_given_documents(spark, cover):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = docs.collect()
    size = {r.doc_id: len((r.text or "").split()) for r in rows}
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += size[r.doc_id]
    want = solve({s: t for s, t in tokens.items() if t}, 2.0, cover)
    out = M.mix(docs, cover=cover).collect()
    given, seen = defaultdict(int), defaultdict(list)
    for r in out:
        assert r.tokens == size[r.doc_id]
        given[r.source] += r.tokens
        seen[r.doc_id].append(r.epoch)
    for s, e in want.items():
        budget = round(e * tokens[s])
        most = max(size[r.doc_id] for r in rows if r.source == s)
        assert budget - most - 1 <= given[s] <= budget + 1
    for epochs in seen.values():
        assert sorted(epochs) == list(range(len(epochs)))
    if cover:
        assert set(seen) == {d for d in size if tokens[next(r.source for r in rows if r.doc_id == d)]}


def test_entropy_target(spark):
    counts = spark.createDataFrame([(1, "a", 800), (2, "b", 150), (3, "c", 50)], "doc_id long, source string, tokens long")
    for target in (0.7, 0.9, 1.0):
        w = [r.weight for r in M.weights(counts, max_repeats=None, entropy=target).collect()]
        assert sum(w) == pytest.approx(1)
        assert -sum(x * math.log(x) for x in w) == pytest.approx(target * math.log(3), abs=1e-6)


def test_progress_and_odd_rows(spark):
    rows = [(k, f"w {k} " * (k % 5), "x" if k % 3 else "y", k) for k in range(60)]
    rows += [(90, None, None, 1), (91, "one two", None, 1), (92, "", "empty", 1), (5, "twice", "x", 0), (5, "twice", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight long")
    out = M.mix(docs).collect()
    assert all(0 <= r.progress <= 1 for r in out)
    assert M.mix(docs.limit(0)).count() == 0
    again = M.repeated(docs)
    assert again.columns == docs.columns
    assert {r.doc_id for r in again.collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_a_long_document_does_not_end_its_source(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_TOKENS", block)
    rows = [(0, "a", 400), *((k, "a", 10) for k in range(1, 61)), *((k, "b", 7) for k in range(100, 150)), (200, "b", 0)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    for seed in range(3):
        for repeats in (0.55, 1.3):
            weighted = spark.createDataFrame([("a", 1000, 1.0, 0.5, repeats), ("b", 350, 1.0, 0.5, repeats)],
                                             "source string, source_tokens long, exponent double, weight double, repeats double")
            out = M.realise(counts, weighted, seed=seed).collect()
            given = defaultdict(int)
            for r in out:
                given[r.source] += r.tokens
                assert 0 <= r.progress <= 1
            for s, total, least in (("a", 1000, 10), ("b", 350, 7)):
                assert round(total * repeats) - least < given[s] <= round(total * repeats)
            assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
            assert all(r.realised == pytest.approx(given[r.source] / sum(given.values())) for r in out)


def test_query_runs(spark):
    assert queries.QUERIES["op10_mixing"](spark, SF001).count() > 0
