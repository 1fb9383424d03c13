"""Collocations: summaries that lose nothing frequent, exact counts, brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import SF001
from tickframe.llm import collocations as C
from tickframe.llm import queries


def brute(rows, min_count, max_words=4, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i:i + n])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    inside = {}
    for (lang, w), v in f.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[lang, w[i:i + n]] = max(inside.get((lang, w[i:i + n]), 0), v)
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside.get((lang, w), 0) < 80 * a:
            cuts = [(C.SCALE * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
                  for lang, best in out.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]))


def got(df):
    return sorted(map(tuple, df.collect()))


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    for seed in range(4):
        keys = np.concatenate([rng.integers(0, 1 << 20, 200_000), rng.zipf(1.3, 100_000) % (1 << 20), np.repeat(rng.integers(0, 1 << 20, 50), 30)])
        rng.shuffle(keys)
        true = Counter(keys.tolist())
        mg = C.MisraGries(len(keys) // 30 + 1, 30)
        mg_small = C.MisraGries(10, 30)  # far too small: it grows instead of losing a key
        for part in np.array_split(keys, 37):
            k, n = C.summarise(part.astype(np.uint64))
            for s in (mg, mg_small):
                s.add(k.astype(np.uint32), n.astype(np.uint32))
                s.merge()
        assert mg.capacity == len(keys) // 30 + 1 and len(mg.keys) <= mg.capacity and 0 < mg.taken < 30
        for s in (mg, mg_small):
            left = dict(zip(s.keys.tolist(), s.counts.tolist()))
            assert all(left.get(k, 0) <= n <= left.get(k, 0) + s.taken for k, n in true.items())
            assert {k for k, n in true.items() if n >= 30} <= set(s.survivors().tolist())


ROWS = [("New York, new york. New York is in New York state; the State of New York!", "en"), ("the state of new york is big " * 40, "en"),
        (None, None), ("", "en"), ("...", None), ("a b c d a b c d a b c d", None), ("a  b\tc \t d\r\nb c", None), ("Ünï cödé Ünï cödé\x0bÜnï", "x"),
        ("same row here", "en"), ("same row here", "en"), ("x" * 3000 + " y " + "z " * 50, "und"), ("a b " * 100 + "." + "a b c " * 30, "und")]


@pytest.mark.parametrize("min_count,section", [(2, 4 << 20), (3, 64), (30, 4 << 20), (1000, 4 << 20)])
def test_odd_rows(spark, monkeypatch, min_count, section):
    monkeypatch.setattr(C, "SECTION", section)
    docs = spark.createDataFrame([(i, *r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, f long")
    assert got(C.collocations(docs.repartition(3), min_count=min_count)) == brute(ROWS, min_count)
    assert C.collocations(docs.limit(0)).count() == 0


def test_counting_in_several_turns(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 5)
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    assert got(C.collocations(docs, min_count=2, top=7)) == brute(ROWS, 2, top=7)
    assert got(C.collocations(docs, min_count=2, max_words=2, top=None)) == brute(ROWS, 2, 2)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text", "lang").collect()]
    found = got(queries.QUERIES["op13_collocations"](spark, SF001))
    assert found == brute(rows, 30) and len(found) > 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    assert sorted(con.execute(queries.ORACLE["op13_collocations"]).fetchall()) == found
