"""Language id: the forward sums against all segmentations, and held-out accuracy."""

import itertools

import numpy as np
import pytest

from tests.conftest import SF01
from tickframe.llm import language_id as L
from tickframe.llm import queries


def sums(word: bytes, prob: dict):
    total, uses = 0.0, {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        p = np.prod([prob.get(x, 0.0) for x in parts])
        total += p
        for x in parts:
            uses[x] = uses.get(x, 0.0) + p
    return total, {x: v / total for x, v in uses.items() if v}


def test_forward_and_expected_uses_are_exact():
    found = [bytes([b]) for b in b" abc"] + [b" a", b"ab", b"bc", b"abc", b" ab", b"ca"]
    table = L.Pieces(found)
    rng = np.random.default_rng(4)
    prob = np.append(rng.random(len(found)), 0)[:, None]
    prob /= prob.sum()
    known = {p: prob[i, 0] for i, p in enumerate(found)}
    texts = [b"abc", b"a", b"cabcab", b"bbbb", b"abcabcabc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    got = L.log_likelihood(table, prob, data, off[:-1], off[1:])[:, 0]
    count = np.array([1.0, 2, 3, 4, 5])
    uses = L.expected(table, prob, data, off[:-1], off[1:], count)
    want = np.zeros(len(found))
    for t, lp, n in zip(texts, got, count):
        total, each = sums(b" " + t, known)
        assert lp == pytest.approx(np.log(total))
        for x, v in each.items():
            want[found.index(x)] += n * v
    assert uses == pytest.approx(want)


def test_long_words_keep_their_scale():
    table = L.Pieces([b" ", b"a", b"aa"])
    prob = np.array([[1e-12], [1e-12], [1e-13], [0]])
    data = np.full(60, 97, np.uint8)
    got = L.log_likelihood(table, prob, data, np.array([0]), np.array([60]))
    assert np.isfinite(got).all() and got[0, 0] < -700


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert got.count() == docs.count()


def test_odd_rows(spark):
    rows = [(k, "the cat and the dog sat on mats" if k % 2 else "der hund und die katze auf matten", "en" if k % 2 else "de", 0.5)
            for k in range(40)]
    rows += [(90, None, "en", 0.0), (91, "", "de", 0.0), (92, "123 --- !!", None, 0.0), (93, "x" * 70000, None, 0.0),
             (94, "die katze", None, 0.0), (94, "die katze", None, 0.0), (None, "the dog", None, 0.0), (95, "ª", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit(docs)
    got = [(r.row.doc_id, r.lang_pred, r.score) for r in L.predict(docs, model).collect()]
    by = dict((a, b) for a, b, _ in got)
    assert (by[90], by[91], by[92], by[94], by[None]) == ("und", "und", "und", "de", "en")
    assert by[93] in ("de", "en") and by[95] in ("de", "en") and all(0 <= s <= 1 for *_, s in got) and len(got) == len(rows)
    assert L.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.fit(docs.limit(0))).collect()} == {"und"}
