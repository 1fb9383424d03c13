"""Repeated passages against a comparison of all windows."""

import random
import re

import numpy as np
import pytest

from tests.conftest import SF01
from tickframe.llm import suffix_dedup as D


def brute(rows, size=D.MIN_WORDS):
    texts = {}
    for i, t in rows:
        if i is not None:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            texts.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", low))
    where = {}
    for i, many in texts.items():
        for w in many:
            for k in range(len(w) - size + 1):
                where.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for i, many in texts.items():
        starts = sorted({k for w in many for k in range(len(w) - size + 1) if len(where[tuple(w[k:k + size])]) > 1})
        spans = []
        for k in starts:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + size
            else:
                spans.append([k, k + size])
        out += [(i, n + 1, a, b, b - a) for n, (a, b) in enumerate(spans)]
    return sorted(out)


def run(spark, rows, n=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    return sorted(tuple(r) for r in D.repeated_passages(df).collect())


@pytest.mark.parametrize("flush", [200, 1_500_000])
def test_planted_passages(spark, monkeypatch, flush):
    monkeypatch.setattr(D, "FLUSH", flush)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 130, 400)]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 5)
            w += p[a:] + [word() for _ in range(rng.randrange(0, 40))]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    rows += [(100, " ".join(["same"] * 200)), (101, " ".join(["same"] * 60)), (102, " ".join(["lone", "pair"] * 90)),
             (103, None), (104, ""), (105, "x" * 9000), (None, rows[0][1]), (7, rows[7][1])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_minimisers_are_content_selected():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    start, at, seed, window = D.minimisers(h, np.array([300, 40, 160]))
    assert set(start) == set(range(251)) | set(range(340, 451))
    grams = D.rolling(h, D.GRAM)
    for s, a in zip(start, at):
        inside = grams[s:s + D.MIN_WORDS - D.GRAM + 1]
        assert a == s + int(inside.argmin())
    again = D.minimisers(np.concatenate([h[:7], h[100:200]]), np.array([107]))
    assert set(window[100:151].tolist()) <= set(again[3].tolist())


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)
