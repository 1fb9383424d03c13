"""Jaccard components against a brute-force join."""

import random
import re

import numpy as np
import pytest

from tests.conftest import SF01
from tickframe.llm import ngram_join as J


def brute(rows):
    sets = []
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    where = {}
    for k, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(k)
    pairs = {(a, b) for m in where.values() for x, a in enumerate(m) for b in m[x + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in J.jaccard_components(df).collect())


def test_small_cases(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(5, base), (3, base.upper()), (9, base + " extra"), (7, None), (8, ""), (11, " \t\n"), (12, "one two"),
            (13, "ONE  two"), (14, "one two three"), (20, "x" * 50000), (21, "x" * 50000), (5, base)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_chains_and_common_passages(spark):
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for f in range(30):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(4, 60))]
        for c in range(rng.randrange(1, 8)):
            if rng.random() < 0.5:
                words = list(words)
                words[rng.randrange(len(words))] = f"e{rng.randrange(99)}"
            rows.append((len(rows) * 3 + 1, " ".join(words + (passage if rng.random() < 0.6 else []))))
    rows += [(1000 + k, " ".join(passage + [f"z{k}"] * (k % 4))) for k in range(40)]
    assert run(spark, rows) == brute(rows)


def test_common_shingles_travel_apart(spark, monkeypatch):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(25)]
    rows = [(k, " ".join([f"a{rng.randrange(50)}" for _ in range(k % 9)] + passage)) for k in range(700)]
    monkeypatch.setattr(J, "BLOCK", 64)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100, 101])
def test_prefix_and_need(n):
    for b in range(1, 2 * n):
        least = next((k for k in range(min(n, b) + 1) if 100 * k >= 75 * (n + b - k)), None)
        if least is not None:
            assert J.needed(n, b) == least
            assert n - least + 1 <= J.prefix_length(n)


def test_tree_bound_finds_all(spark):
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, J.GROUPS))
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, J.GROUPS)), 0)
    size = points.sum(1)
    found = {(int(a), int(b)) for q, e in J.CountTree(points, size).search(points, size) for a, b in zip(q, e)}
    want = {(a, b) for a in range(300) for b in range(300)
            if np.minimum(points[a], points[b]).sum() >= J.needed(size[a], size[b])}
    assert want <= found


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_one_of_each_keeps_different_texts(spark):
    base = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(30))
    schema = "doc_id int, text string, key string, text_hash int, row string, n long"
    rows = [(7, base, "a", 1, "r", 1), (7, other, "b", 2, "r", 2), (7, base, "c", 3, "r", 3), (3, base + " more", "d", 4, "r", 4),
            (9, "", "e", 5, None, 5), (9, " ", "f", 6, None, 6), (9, None, "g", 7, None, 7), (None, base, "h", 8, "r", 8), (None, base, "h", 8, "r", 8)]
    got = J.one_of_each(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "key", "text_hash", "row", "n"]
    assert [f.dataType for f in got.schema] == [f.dataType for f in spark.createDataFrame(rows, schema).schema]
    got = [tuple(r) for r in got.collect()]
    assert sorted(r[4 - 1] for r in got if r[0] in (3, 7)) == [2, 4]
    assert sum(r[0] == 9 for r in got) == 1 and sum(r[0] is None for r in got) == 2


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, key int, root string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (2, 2, 1)]
