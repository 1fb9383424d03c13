"""Packing: ids against the tokenizer, pieces against the texts, bins without gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.conftest import SF001
from tickframe.llm import packing as P
from tickframe.llm import queries


def check(rows, out, capacity=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(P.cut(len(ids), capacity))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(want, key=key) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(r.length for r in out)


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)]
    assert P.cut(2049) == [(0, 1), (1, 2048)] and P.cut(4096) == [(0, 2048), (2048, 2048)]


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(0, 60)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * j for s in sums for j in range(c + 1)}
        used = P.fullest(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


def test_plan_uses_everything_and_wastes_little():
    rng = random.Random(3)
    counts = {}
    for _ in range(20000):
        k = min(2048, max(1, int(rng.lognormvariate(6, 1))))
        counts[k] = counts.get(k, 0) + 1
    used, bins = {}, 0
    for combo, times in P.plan(counts):
        assert sum(k * m for k, m in combo.items()) <= 2048
        bins += times
        for k, m in combo.items():
            used[k] = used.get(k, 0) + m * times
    assert used == counts
    assert bins <= -(-sum(k * v for k, v in counts.items()) // 2048) + 2


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "<|endoftext|> x", 7), (4, "naïve  “quoted” 漢字 \x85 ''s ́", 8),
            (5, "a" * 30000, 9), (6, "same", 1), (6, "same", 1), (None, "no id", 2), (7, " \n\n  x\t\ty  ", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    check([r[:2] for r in rows], P.packed(docs).collect())
    assert P.packed(docs.limit(0)).count() == 0
    ids = P.packed(docs, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in ids)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    bins, total = check(rows, queries.QUERIES["op8_packing"](spark, SF001).collect())
    assert bins <= -(-total // 2048) + 1  # the bound itself need not be feasible
