"""Ranked lexical search: exact inner products in sparse ball trees.

A document is the sparse vector x of w(t) * saturated tf(t) over the queries'
terms, an item the set of its terms, the score their integer inner product.
Weights and lengths use statistics of all documents.

Documents come in blocks; each block is a ball tree, split by the distances to
two far documents.  A node has a centroid c (sparse; a term outside its support
occurs in none of its documents) and radii: r over all terms, r_b over each band
of weights, since few heavy terms would else stretch the ball, and e_t, the
largest excess over c in each term.  For a query q cut to the support of c, no
document of the node scores more than q.c + the sum over the bands of the lesser
of |q_b| r_b and the sum of q's e_t there, nor more than q.c + |q| r.  Bounds are
raised by more than their rounding errors.  A search takes nodes best-first from
a heap and ends at the first bound below the k-th best score known, so subtrees
are left out whole; leaves are scored in integers.  The result is exact.

The trees are stored.  A first round scores the most promising leaves of every
block, and each item's k-th best score over all blocks starts the second round,
so a block without good documents ends at its first nodes.

Items are taken in groups of bounded vocabulary, each against all documents.
Terms are matched by a 64-bit hash, each different match of a batch is compared
by its bytes.

Null and empty texts have no term and take no part.  Every row is a document, so
repeated rows rank one after the other; ties go to the smaller doc_id, null
last.  Rows with the same item_id are one item with the terms of all of them.
Empty tables give no row; other columns are ignored.  Long texts are read whole.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import lean, slices, small_batches, staged
from tickframe.llm.words import LOWER, PUNCT, hashes, spans, text_bytes

TOP = 50
#: Documents of a tree and of a leaf; leaves scored per block in the first round; query terms of a group of items.
BLOCK, LEAF, PROBE, GROUP_TERMS = 2048, 8, 4, 200_000
#: Trees written to one file.
FILE_TREES = 2
#: Upper ends of the bands of term weights but the last.
BANDS = (500, 1500, 3000, 5000, 7000)


def _terms(column):
    """(bytes, start, end, text) of every term."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, of = spans(PUNCT[data], offsets)
    return data, start, end, of


def _item_terms(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            data, start, end, of = _terms(part.column("text"))
            raw = data.tobytes()
            ids = part.column("item_id").to_pylist()
            rows = sorted({(i, raw[a:b]) for i, a, b in zip(of.tolist(), start.tolist(), end.tolist())})
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in rows], pa.int64()), pa.array([t.decode() for _, t in rows], pa.string())],
                                             ["item_id", "term"])


class Vocabulary:
    """Terms by hash: ``find`` gives the number of each span's term, or -1."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(t) for t in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
        h = hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends)[:-1], ends) if raw else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.raw, self.number = h[order], [raw[i] for i in order], order
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of one hash")

    def __len__(self):
        return len(self.hash)

    def find(self, data, start, end):
        got = hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.hash, got), max(len(self) - 1, 0))
        hit = self.hash[at] == got if len(self) else np.zeros(len(got), bool)
        if hit.any():
            place, first = np.unique(at[hit], return_index=True)
            spot = np.flatnonzero(hit)[first]
            for p, a, b in zip(place.tolist(), start[spot].tolist(), end[spot].tolist()):
                if data[a:b].tobytes() != self.raw[p]:  # another term of this hash: compare one by one
                    same = np.flatnonzero(hit & (at == p))
                    hit[[i for i in same if data[start[i]:end[i]].tobytes() != self.raw[p]]] = False
        return np.where(hit, self.number[at], -1) if len(self) else np.full(len(got), -1)


def _vectors(shared):
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, start, end, of = _terms(part.column("text"))
                n = np.bincount(of, minlength=part.num_rows)
                term = vocabulary.find(data, start, end)
                hit = term >= 0
                key, tf = np.unique(of[hit] * max(len(vocabulary), 1) + term[hit], return_counts=True)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) * max(len(vocabulary), 1))
                term, tf = (key % max(len(vocabulary), 1)).astype("<i4"), tf.astype("<i4")
                have = np.flatnonzero(n)
                ids = part.column("doc_id").to_pylist()
                piece = lambda v: pa.array([v[cut[i]:cut[i + 1]].tobytes() for i in have], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in have], pa.int64()), pa.array(n[have]), piece(term), piece(tf)],
                                                 ["doc_id", "n", "terms", "tf"])
    return run


def _frequencies(width):
    def run(batches):
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(_joined(batch.column("terms"), "<i4"), minlength=width)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], ["term", "df"])
    return run


def _joined(column, kind) -> np.ndarray:
    """All values of a binary column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), ``n`` the length of each entry's document."""
    m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // length
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Rows:
    """Sparse rows: ``cut[i]:cut[i + 1]`` are the entries of row i."""

    def __init__(self, cut, term, value):
        self.cut, self.term, self.value = cut, term, value

    def take(self, rows):
        size = np.diff(self.cut)[rows]
        cut = np.append(0, np.cumsum(size))
        at = np.repeat(self.cut[rows] - cut[:-1], size) + np.arange(cut[-1])
        return Rows(cut, self.term[at], self.value[at])

    def sums(self, entries):
        """The sum of ``entries`` (one per entry) in each row; exact for integers."""
        total = np.append(np.zeros(1, entries.dtype), np.cumsum(entries)) if entries.dtype.kind == "i" else None
        if total is not None:
            return total[self.cut[1:]] - total[self.cut[:-1]]
        return np.bincount(np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut)), weights=entries, minlength=len(self.cut) - 1)


def build(rows: Rows, weight: np.ndarray):
    """A ball tree over integer rows: the documents' order, and per node the
    documents' range, children (0: leaf), centroid rows, excess and radii (all, bands)."""
    n, width = len(rows.cut) - 1, len(weight)
    band = np.searchsorted(BANDS, weight, side="right")
    order = np.arange(n)
    span, child, radius, c_size, c_term, c_value, c_excess = [(0, n)], [(0, 0)], [], [], [], [], []
    squares = rows.sums(rows.value.astype(float) ** 2)
    dense = np.zeros(width)
    node = 0
    while node < len(span):
        a, b = span[node]
        mine = rows.take(order[a:b])
        value = mine.value.astype(float)
        support, where = np.unique(mine.term, return_inverse=True)
        centre = (np.bincount(where, weights=value, minlength=len(support)) / (b - a)).astype(np.float32).astype(float)
        excess = -centre
        np.maximum.at(excess, where, value - centre[where])
        # |x - c|^2 per band: |x|^2 - 2 x.c + |c|^2, from the differences to avoid cancelling
        own = centre[where]
        of_row = np.repeat(np.arange(b - a), np.diff(mine.cut))
        kinds = len(BANDS) + 1
        gap = np.bincount(of_row * kinds + band[mine.term], weights=(value - own) ** 2 - own ** 2, minlength=(b - a) * kinds).reshape(-1, kinds)
        gap += np.bincount(band[support], weights=centre ** 2, minlength=kinds)
        whole = gap.sum(1)
        scale = float(squares[order[a:b]].max(initial=0)) + float((centre ** 2).sum())
        error = scale * (len(value) + len(support) + 16) * 2.0 ** -51
        far = np.concatenate([[whole.max(initial=0)], gap.max(0, initial=0)])
        radius.append(np.sqrt(np.maximum(far, 0) + error))
        c_size.append(len(support))
        c_term.append(support)
        c_value.append(centre.astype(np.float32))
        c_excess.append(np.nextafter(np.maximum(excess, 0).astype(np.float32), np.float32(np.inf)))
        if b - a > LEAF:
            def apart(i):  # squared distances to document i of the node
                one = slice(mine.cut[i], mine.cut[i + 1])
                dense[mine.term[one]] = value[one]
                out = mine.sums(value * dense[mine.term])
                dense[mine.term[one]] = 0
                return squares[order[a:b]] - 2 * out
            left = int(whole.argmax())
            to_left = apart(left)
            right = int(to_left.argmax())
            nearer = np.argsort(to_left - apart(right), kind="stable")
            order[a:b] = order[a:b][nearer]
            middle = (a + b) // 2
            child[node] = (len(span), len(span) + 1)
            span += [(a, middle), (middle, b)]
            child += [(0, 0), (0, 0)]
        node += 1
    centres = Rows(np.append(0, np.cumsum(c_size)), np.concatenate(c_term), np.concatenate(c_value))
    return order, np.array(span), np.array(child), centres, np.concatenate(c_excess), np.array(radius)


class Tree:
    """A block's documents in tree order, with its nodes."""

    def __init__(self, ids, rows, weight, nodes=None):
        self.weight = weight
        if nodes is None:
            order, *nodes = build(Rows(rows.cut, rows.term, rows.value * weight[rows.term]), weight)
            ids, rows = ids[order], rows.take(order)
        self.ids, self.rows = ids, rows
        self.span, self.child, self.centres, self.excess, self.radius = nodes
        self.value = rows.value.astype(np.int64) * weight[rows.term]
        self.band = np.searchsorted(BANDS, weight, side="right")
        # centroids by term: entries of each term, with their node
        by_term = np.argsort(self.centres.term, kind="stable")
        self.of_term = np.searchsorted(self.centres.term[by_term], np.arange(len(weight) + 1))
        self.node = np.repeat(np.arange(len(self.span)), np.diff(self.centres.cut))[by_term]
        self.centre_of, self.excess_of = self.centres.value[by_term].astype(float), self.excess[by_term].astype(float)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, cut=self.rows.cut, term=self.rows.term, value=self.rows.value.astype(np.int32), span=self.span,
                 child=self.child, c_cut=self.centres.cut, c_term=self.centres.term.astype(np.int32), c_value=self.centres.value, excess=self.excess,
                 radius=self.radius)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, weight):
        v = np.load(io.BytesIO(data))
        return cls(v["ids"], Rows(v["cut"], v["term"], v["value"]), weight,
                   (v["span"], v["child"], Rows(v["c_cut"], v["c_term"], v["c_value"]), v["excess"], v["radius"]))

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node a score that none of its documents passes; ``terms`` are the query's."""
        size = self.of_term[terms + 1] - self.of_term[terms]
        at = np.repeat(self.of_term[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        node, n, kinds = self.node[at], len(self.span), len(BANDS) + 1
        inner = np.bincount(node, weights=self.centre_of[at], minlength=n)
        cell = node * kinds + np.repeat(self.band[terms], size)
        held = np.bincount(cell, minlength=n * kinds).reshape(n, kinds)
        excess = np.bincount(cell, weights=self.excess_of[at], minlength=n * kinds).reshape(n, kinds)
        ball = np.minimum(np.sqrt(held) * self.radius[:, 1:], excess).sum(1)
        best = inner + np.minimum(ball, np.sqrt(held.sum(1)) * self.radius[:, 0])
        return best * (1 + (len(terms) + 32) * 2.0 ** -50)

    def score(self, a: int, b: int, asked) -> np.ndarray:
        """Integer scores of the documents a to b - 1."""
        one = slice(self.rows.cut[a], self.rows.cut[b])
        return Rows(self.rows.cut[a:b + 1] - self.rows.cut[a], None, None).sums(self.value[one] * asked[self.rows.term[one]])

    def search(self, terms: np.ndarray, best: Best, leaves: int | None = None) -> int:
        """Give ``best`` all documents that can enter it; how many were scored."""
        bound = self.bounds(terms).tolist()
        asked = np.zeros(len(self.weight), bool)
        asked[terms] = True
        heap, scored = [(-bound[0], 0)], 0
        while heap and (leaves is None or leaves > 0):
            top, node = heapq.heappop(heap)
            if -top < best.least or top >= 0:
                break
            if self.child[node, 0]:
                for child in self.child[node].tolist():
                    if bound[child] >= best.least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            scores = self.score(a, b, asked)
            keep = (scores >= best.least) & (scores > 0)
            if keep.any():
                best.add(scores[keep], self.ids[a:b][keep])
            scored += int(b - a)
            leaves = None if leaves is None else leaves - 1
        return scored


#: Stands for a null doc_id: last among ties.
NO_ID = np.iinfo(np.int64).max


class Best:
    """The k best (score, doc_id) so far; ``least`` is the score that a new one must reach."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.floor, self.least = k, least, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores, ids) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.floor, int(self.scores[-1]))


def _trees(weight, n_docs, length, block):
    def run(batches):
        weights = weight.value
        held, size = [], 0

        def made():
            ids, n, cut, term, tf = (np.concatenate(c) for c in zip(*held))
            per = cut
            cut = np.append(0, np.cumsum(per))
            value = saturated(tf, np.repeat(n, per), n_docs, length)
            keep = weights[term] > 0
            cut = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(per)), per)[keep], minlength=len(per))))
            return pa.RecordBatch.from_arrays([pa.array([Tree(ids, Rows(cut, term[keep], value[keep]), weights).dump()], pa.binary())], ["tree"])

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                ids = np.array([NO_ID if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
                term = _joined(part.column("terms"), "<i4")
                per = np.array([len(t) // 4 for t in part.column("terms").to_pylist()], np.int64)
                have = per > 0
                if have.any():
                    n = part.column("n").to_numpy()
                    held.append((ids[have], n[have], per[have], term, _joined(part.column("tf"), "<i4")))
                    size += int(have.sum())
                if size >= block:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()
    return run


def _searched(weight, asked_of, least, k, leaves):
    """The k best of all blocks of a task, for each item."""
    def run(batches):
        weights, items, floor = weight.value, asked_of.value, least.value if least else {}
        best = {i: Best(k, floor.get(i, 1)) for i in range(len(items))}
        for batch in batches:
            for row in batch.column("tree"):
                tree = Tree.load(row.as_buffer(), weights)
                for i, terms in enumerate(items):
                    tree.search(terms, best[i], leaves)
        for i, b in best.items():
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), i), pa.int32()), pa.array(b.ids, mask=b.ids == NO_ID), pa.array(b.scores)],
                                                 ["item", "doc_id", "score"])
    return run


def _group(docs: DataFrame, terms: list[list[str]], k: int, block: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents of each item, at least."""
    spark = docs.sparkSession
    names = sorted({t for own in terms for t in own})
    number = {t: i for i, t in enumerate(names)}
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vectors = staged(rows.mapInArrow(lean(_vectors(share(Vocabulary(names)))), "doc_id long, n long, terms binary, tf binary"), "term-vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(names), np.int64)
    counts = vectors.select("terms").mapInArrow(lean(_frequencies(len(names))), "term long, df long")
    for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # GROUP_TERMS rows or so at most
        df[r["term"]] = r["df"]
    weight = share(weights(df, n_docs))
    trees = vectors.mapInArrow(lean(_trees(weight, n_docs, length or 1, block)), "tree binary")
    trees = staged(trees, "ball-trees", maxRecordsPerFile=FILE_TREES)  # a reader holds the trees of a file
    asked = share([np.array([number[t] for t in own], np.int64) for own in terms])
    schema = "item int, doc_id long, score long"
    probed = trees.mapInArrow(lean(_searched(weight, asked, None, k, PROBE)), schema)
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc())
    kth = probed.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") == k).select("item", "score").collect()
    least = share({r["item"]: r["score"] for r in kth})
    return trees.mapInArrow(lean(_searched(weight, asked, least, k, None)), schema)


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP, block: int = BLOCK, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    terms = staged(found.mapInArrow(lean(_item_terms), "item_id long, term string").groupBy("item_id")
                   .agg(F.array_sort(F.collect_set("term")).alias("terms")), "item-terms")
    groups = max(1, math.ceil((terms.agg(F.sum(F.size("terms"))).first()[0] or 0) / group_terms))
    out = None
    for g in range(groups):  # a group's vocabulary goes to every task
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        if not own:
            continue
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item int, item_id long")
        got = _group(docs, [r["terms"] for r in own], k, block).join(F.broadcast(ids), "item").drop("item")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
