"""Ball trees: bounds that hold and prune, exact ranks against brute force and SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF01, SF001
from tickframe.llm import ball_tree as B
from tickframe.llm import queries

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    rows = [(doc_id, len(t), Counter(t)) for doc_id, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, total = len(rows), sum(n for _, n, _ in rows)
    df = Counter(t for _, _, c in rows for t in c)
    own = {}
    for i, x in items:
        own.setdefault(i, set()).update(terms(x))
    out = []
    for i, ts in own.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts if t in df}
        scores = []
        for doc_id, n, c in rows:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(w[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


class Shared:
    def __init__(self, value):
        self.value = value


def tree_of(docs, items, block=1 << 20):
    own = [sorted(set(terms(x))) for _, x in items]
    names = sorted({t for o in own for t in o})
    number = {t: i for i, t in enumerate(names)}
    rows = pa.table({"doc_id": [d for d, _ in docs], "text": [x for _, x in docs]})
    v = pa.Table.from_batches(list(B._vectors(Shared(B.Vocabulary(names)))(rows.to_batches())))
    n_docs, length = v.num_rows, int(v.column("n").to_numpy().sum())
    df = np.zeros(len(names), np.int64)
    for b in B._frequencies(len(names))(v.to_batches()):
        df[b.column("term").to_numpy()] = b.column("df").to_numpy()
    w = B.weights(df, n_docs)
    blobs = [x for b in B._trees(Shared(w), n_docs, length, block)(v.to_batches()) for x in b.column("tree").to_pylist()]
    return [B.Tree.load(x, w) for x in blobs], [np.array([number[t] for t in o], np.int64) for o in own]


def test_bounds_hold_and_prune(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text").limit(6000).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
    (tree,), asked = tree_of(docs, items)
    share = []
    for q in asked:
        mask = np.zeros(len(tree.weight), bool)
        mask[q] = True
        scores, bound = tree.score(0, len(tree.ids), mask), tree.bounds(q)
        most = np.array([scores[a:b].max() for a, b in tree.span])
        assert (bound >= most).all()
        kth = B.Best(50)
        full = tree.search(q, kth)
        order = np.lexsort((tree.ids, -scores))[:50]
        assert (kth.scores == scores[order][scores[order] > 0]).all() and (kth.ids == tree.ids[order][scores[order] > 0]).all()
        share.append(full / len(tree.ids))
    assert np.mean(share) < 0.4


DOCS = [(5, None), (6, ""), (7, "  ,.;"), (1, "alpha beta Gamma"), (2, "ALPHA alpha alpha delta"), (2, "ALPHA alpha alpha delta"), (None, "beta beta été"),
        (3, "Été ÉTÉ x1 x2"), (-4, "filler " * 20000 + "alpha"), (8, "beta gamma delta"), (9, "delta-beta_gamma"), (10, "naïve\u00a0word"), (11, "漢字 alpha")]
ITEMS = [(1, "alpha, beta"), (2, "ÉTÉ"), (3, None), (4, "unknown words"), (None, "gamma delta alpha"), (1, "delta"), (7, "alpha"), (7, "alpha"), (8, "naïve\u00a0word 漢字")]


@pytest.mark.parametrize("options", [{}, {"k": 2, "block": 3}, {"group_terms": 3, "k": 3}])
def test_odd_rows(spark, options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS + [(i, "alpha beta" * (i % 3) + " delta") for i in range(100, 180)]], "doc_id long, text string, score long, item_id string")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id long")
    want = brute([r[:2] for r in docs.collect()], ITEMS, options.get("k", 50))
    assert got(B.search(docs.repartition(3), items, **options)) == want
    assert B.search(docs.limit(0), items).count() == 0 and B.search(docs, items.limit(0)).count() == 0


def test_given_documents(spark):
    load = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{SF001}/{t}.parquet").select(i, "text").collect()]
    found = got(queries.QUERIES["op12_ball_tree"](spark, SF001))
    assert found == brute(load("documents", "doc_id"), load("benchmark", "item_id"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    assert sorted(con.execute(queries.ORACLE["op12_ball_tree"]).fetchall(), key=str) == found
