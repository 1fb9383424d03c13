"""N-gram Jaccard join: count-vector R-tree over groups of hashed shingles.

Which documents share enough 5-word shingles, exactly: two documents link when
``DEN * intersection >= NUM * union``.

1. Every text becomes its set of 64-bit shingle hashes.  Equal sets become one
   node (a 64-bit key of the set).
2. Shingles are dealt by hash into parts; each part finds the shingles that
   two nodes or more share and how many nodes share them, and answers the
   chunk of documents that each node came from.  Very common shingles (in 1/64 of all nodes) are found first, their
   number is bounded by 64 times the mean set size, and they never travel.
3. In the common order (rarest first) two linked nodes share one of their
   first ``n - ceil(NUM/DEN * n) + 1`` shingles.  Shingles of one node alone
   use up places without a posting, so only nodes with a possible partner
   go on.
4. Nodes with a posting in common are candidates.  First nodes are held
   against pivots, and linked nodes are joined to components.  Then, per
   posting, nodes of different components go into an R-tree: shingles are
   hashed into ``GROUPS`` groups, the counts per group are a node's point, an
   entry's bound is the sum of coordinate minima with the box's upper corner.
   Pairs whose bound reaches the needed overlap are verified on the sets.
5. Components over all verified links give ``component_id``.

No link is lost: pairs are skipped only if they are already connected or their
bound proves them too small.  Null and empty texts have no shingle and link
with nothing.  Repeated rows form one component.  Two different sets or
shingles with equal 64-bit hashes would be taken as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.common import bucketed, lean, lean_group, parts, slices, small_batches, staged, text_rows
from tickframe.llm.components import components

SIZE = 5
NUM, DEN = 75, 100
#: Coordinates of a node's point.
GROUPS = 64
#: Shingles gathered by a task before it sends them; shingles per part.
FLUSH = 700_000
PART = 1_000_000
#: A shingle in this share of all nodes is common.
COMMON = 64
#: Nodes of a chunk are numbered with 16 bits.
MAX_NODES = 60_000
#: Members of one posting that are compared in one task.
BLOCK = 4096
LEAF = 16
#: Rounds in which components are joined over pivots before the trees.
STAR_ROUNDS = 3
_U = np.uint64


def prefix_length(n):
    """Shingles of a set of ``n`` among which any linked set has one too."""
    return n - -(-NUM * n // DEN) + 1


def needed(a, b):
    """The smallest intersection that links sets of these sizes."""
    return -(-NUM * (a + b) // (NUM + DEN))


def sets(column, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column."""
    data, off = words.text_bytes(column)
    low = words.LOWER[data]
    start, end, text = words.spans(words.SPACE[low], off)
    count = np.bincount(text, minlength=len(column))
    got, per = words.shingles(words.hashes(low, start, end), count, size)
    return [np.unique(x) for x in np.split(got, np.cumsum(per)[:-1])] if len(per) else []


def set_key(tokens: np.ndarray) -> int:
    """A 63-bit key of a set, from its size and the sum of mixed hashes."""
    total = words.mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True)
    return int(words.mix(total + _U(len(tokens)))[0] >> _U(1))


def _flushes(batches, column="text"):
    """Chunks of ((doc id, text hash) of each row, sets) with about FLUSH shingles."""
    ids, got, n = [], [], 0
    for batch in batches:
        for part in slices(batch, column):
            ids += zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist())
            new = sets(part.column(column))
            got += new
            n += sum(map(len, new))
            if n >= FLUSH or len(got) >= MAX_NODES:
                yield ids, got
                ids, got, n = [], [], 0
    if ids:
        yield ids, got


def _summaries(batches):
    """kind 0: (doc_id, key, n, text_hash) of each row.  kind 1: (shingle, nodes) common in a chunk."""
    for ids, got in _flushes(batches):
        keys = [set_key(s) if len(s) else None for s in got]
        own = {k: s for k, s in zip(keys, got) if k is not None}
        tok, df = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]), return_counts=True)
        hot = df >= max(8, len(own) // COMMON)
        tok, df = tok[hot].view(np.int64), df[hot]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(ids) + [1] * len(tok), pa.int32()),
             pa.concat_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array(tok)]),
             pa.concat_arrays([pa.array(keys, pa.int64()), pa.array(df.astype(np.int64))]),
             pa.array([len(s) for s in got] + [0] * len(tok), pa.int64()),
             pa.array([h for _, h in ids] + [None] * len(tok), pa.int64())],
            ["kind", "doc_id", "key", "n", "text_hash"])


def _dealt(common, n_parts):
    """The shingles of each chunk by part: the node's number in the chunk and
    the low 40 bits.  Part numbers from ``n_parts`` carry a chunk's directory:
    keys and set sizes of its nodes, and their common shingles."""
    def run(batches):
        hot = common.value
        for number, (_, got) in enumerate(_flushes(batches)):
            own = {set_key(s): s for s in got if len(s)}
            if not own:
                continue
            chunk = TaskContext.get().partitionId() << 32 | number  # the same if the task runs again
            size = np.fromiter(map(len, own.values()), np.int64, len(own))
            tok, node = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), size)
            where, which = node[:0], node[:0]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
                is_hot = hot[at] == tok
                where, which = node[is_hot], at[is_hot]
                tok, node = tok[~is_hot], node[~is_hot]
            out = [[n_parts + chunk % n_parts], [np.fromiter(own, np.int64, len(own)).tobytes()], [size.astype(np.uint32).tobytes()],
                   [where.astype(np.uint16).tobytes() + which.astype(np.uint32).tobytes()]]
            part = (((tok >> _U(32)) * _U(n_parts)) >> _U(32)).astype(np.uint16 if n_parts <= 65536 else np.int64)
            order = np.argsort(part, kind="stable")
            tok, node, part = tok[order], node[order], part[order]
            cuts = np.searchsorted(part, np.arange(n_parts + 1))
            low = np.ascontiguousarray(tok).view(np.uint8).reshape(-1, 8)[:, :5]
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                # steps between node numbers, low bytes first, compress well
                step = np.diff(node[a:b], prepend=0).astype(np.uint16).view(np.uint8).reshape(-1, 2).T
                for col, v in zip(out, (int(p), step.tobytes(), low[a:b].tobytes(), b"")):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([chunk] * len(out[0]), pa.int64())]
                                             + [pa.array(c, pa.binary()) for c in out[1:]], ["part", "chunk", "a", "b", "c"])
    return run


def _wide(raw: bytes) -> np.ndarray:
    """40-bit numbers as long."""
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


def _shared(n_parts):
    """Of each part, the shingles of two nodes or more go back to their chunks
    with the number of nodes (255 at most: an order is all that is needed)."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= n_parts:
            return table
        steps, raw = table.column("a").to_pylist(), table.column("b").to_pylist()
        tok = _wide(b"".join(raw))
        _, at, df = np.unique(tok, return_inverse=True, return_counts=True)
        df = np.minimum(df, 255).astype(np.uint8)[at]
        del at
        keep = df > 1
        out, first = [[], [], [], []], 0
        for i, (a, b) in enumerate(zip(steps, raw)):
            n = len(b) // 5
            mine = keep[first:first + n]
            if mine.any():
                node = np.cumsum(np.ascontiguousarray(np.frombuffer(a, np.uint8).reshape(2, -1).T).view(np.uint16).ravel(), dtype=np.uint16)
                for col, v in zip(out, (i, node[mine].tobytes(), np.frombuffer(b, np.uint8).reshape(-1, 5)[mine].tobytes(),
                                        df[first:first + n][mine].tobytes())):
                    col.append(v)
            first += n
        return pa.table([table.column("part").take(pa.array(out[0], pa.int64())), table.column("chunk").take(pa.array(out[0], pa.int64()))]
                        + [pa.array(c, pa.binary()) for c in out[1:]], ["part", "chunk", "a", "b", "c"])
    return run


def _postings(n_parts):
    """A chunk's nodes with a possible partner: their shared shingles, and those of the prefix."""
    def run(table: pa.Table) -> pa.Table:
        node, tok, df = [], [], []
        keys = sizes = np.zeros(0, np.int64)
        for part, a, b, c in zip(*(table.column(x).to_pylist() for x in ("part", "a", "b", "c"))):
            if part >= n_parts:
                keys, sizes, hot = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32).astype(np.int64), len(c) // 6
                node.append(np.frombuffer(c[:2 * hot], np.uint16))
                tok.append(np.frombuffer(c[2 * hot:], np.uint32).astype(np.int64) + (np.int64(n_parts) << 40))
                df.append(np.full(hot, 255, np.uint8))
            else:
                node.append(np.frombuffer(a, np.uint16))
                tok.append(_wide(b) + (np.int64(part) << 40))
                df.append(np.frombuffer(c, np.uint8))
        node, tok, df = (np.concatenate(x) for x in (node, tok, df))
        order = np.lexsort((tok, df, tok >= np.int64(n_parts) << 40, node))
        tok, node = tok[order], node[order]
        cut = np.searchsorted(node, np.arange(len(keys) + 1))
        out = [[], [], [], [], []]
        for i, (key, n) in enumerate(zip(keys.tolist(), sizes.tolist())):
            mine = tok[cut[i]:cut[i + 1]]
            take = prefix_length(n) - (n - len(mine))
            if take > 0:
                point = np.bincount((words.mix(mine.view(np.uint64)) % _U(GROUPS)).astype(np.int64), minlength=GROUPS)
                for col, v in zip(out, (key, n, np.sort(mine).tobytes(), mine[:take], point.astype(np.uint32).tobytes())):
                    col.append(v)
        return pa.table({"key": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "tokens": pa.array(out[2], pa.binary()),
                         "prefix": pa.array(out[3], pa.list_(pa.int64())), "point": pa.array(out[4], pa.binary())})
    return run


def _bounded(batches):
    """Pairs whose summed coordinate minima reach the needed intersection."""
    for batch in batches:
        pa_, pb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, GROUPS) for c in ("pa", "pb"))
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = pa.array(np.minimum(pa_, pb).sum(1) >= needed(na, nb), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b", "ra", "rb")], ["a", "b", "ra", "rb"])


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, ra, rb) whose points do not rule a link out."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb", "pa", "pb")
            .mapInArrow(lean(_bounded), "a long, b long, ra long, rb long"))


def _verify(batches):
    """Pairs whose sets reach the needed intersection."""
    for batch in batches:
        ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        both = np.array([len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), True))
                         for x, y in zip(ta, tb)], np.int64)
        ok = pa.array((DEN + NUM) * both >= NUM * (na + nb), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("ra").filter(ok), batch.column("rb").filter(ok)], ["ra", "rb"])


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The components (ra, rb) of the pairs of node keys (a, b) that link."""
    side = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("ra", "rb", "na", "nb", "ta", "tb").mapInArrow(lean(_verify), "ra long, rb long"))


class CountTree:
    """A bulk-loaded R-tree over count vectors.

    Entries are packed in order of size, then of their fullest group; a node
    keeps the upper corner of its box and the range of sizes below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.leaf = leaf
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            box, low, high = self.levels[-1]
            cut = np.arange(0, len(box), leaf)
            self.levels.append((np.maximum.reduceat(box, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, points: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 16):
        """Yield (query, entry) index arrays whose bound reaches the needed overlap."""
        for a in range(0, len(points), 256):
            q = np.arange(a, min(a + 256, len(points)))
            node = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                box, low, high = self.levels[depth]
                if depth < len(self.levels) - 1:
                    q = np.repeat(q, self.leaf)
                    node = (node[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                    inside = node < len(box)
                    q, node = q[inside], node[inside]
                n = sizes[q]
                keep = (NUM * n <= DEN * high[node]) & (NUM * low[node] <= DEN * n)
                q, node = q[keep], node[keep]
                reach = np.concatenate([np.minimum(points[q[i:i + chunk]], box[node[i:i + chunk]]).sum(1)
                                        for i in range(0, len(q), chunk)] or [np.zeros(0)])
                keep = reach >= needed(sizes[q], np.maximum(low[node], -(-NUM * sizes[q] // DEN)))
                q, node = q[keep], node[keep]
            yield q, self.order[node]


def _tree_pairs(table: pa.Table) -> pa.Table:
    """Candidate pairs of different components under one posting, over all postings of a bucket."""
    token, cell = table.column("token").to_numpy(), table.column("cell").to_numpy()
    side, key = table.column("side").to_numpy(), table.column("key").to_numpy()
    comp, size = table.column("root").to_numpy(), table.column("n").to_numpy()
    point = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint32).reshape(-1, GROUPS).astype(np.int64)
    order = np.lexsort((cell, token))
    cut = np.flatnonzero(np.diff(token[order]) | np.diff(cell[order])) + 1
    seen = set()
    for group in np.split(order, cut):
        left, right = group[side[group] != 2], group[side[group] != 1]
        if not len(left) or not len(right) or len(np.unique(comp[group])) < 2:
            continue
        tree = CountTree(point[right], size[right])
        for q, e in tree.search(point[left], size[left]):
            x, y = left[q], right[e]
            keep = comp[x] != comp[y]
            x, y = x[keep], y[keep]
            x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
            seen.update(zip(key[x].tolist(), key[y].tolist(), comp[x].tolist(), comp[y].tolist()))
    cols = zip(*seen) if seen else [()] * 4
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "ra", "rb"), cols)})


def _blocked(postings: DataFrame) -> DataFrame:
    """Postings with members of two components or more; each large one as cells
    of two blocks, so that no task meets more than 2 * BLOCK members.
    side 0: both roles, 1: left, 2: right."""
    sizes = (postings.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("r0"), F.max("root").alias("r1"))
             .filter("r0 <> r1").select("token", F.ceil(F.col("f") / BLOCK).cast("long").alias("blocks")))
    got = postings.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    got = got.withColumn("other", F.explode(cells))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return (got.withColumn("cell", low * F.col("blocks") + high)
            .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
            .select("token", "cell", "side", "key", "root", "n", "point"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    got = _classes(docs)
    low = got.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"))
    return (got.join(low, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id")))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class) of every row; null class: no shingles.

    ``docs`` is read twice and, if an executor is lost, in part again: pass a
    stored table, whose rows come in the same order each time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = text_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    summary = staged(rows.mapInArrow(lean(_summaries), "kind int, doc_id long, key long, n long, text_hash long"), "sets")
    members = summary.filter("kind = 0").select("doc_id", "key", "n", "text_hash")
    total = members.agg(F.count("key").alias("nodes"), F.sum("n").alias("n")).first()
    nodes_n, n_parts = total["nodes"], max(parts(spark), math.ceil((total["n"] or 0) / PART))
    hot = (summary.filter("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("key").alias("df"))
           .filter(F.col("df") >= max(256, nodes_n // COMMON)).toPandas())
    common = spark.sparkContext.broadcast(np.sort(hot.token.to_numpy(np.int64).view(np.uint64)))
    kind = "part long, chunk long, a binary, b binary, c binary"
    answers = (rows.mapInArrow(lean(_dealt(common, n_parts)), kind).groupBy("part").applyInArrow(lean_group(_shared(n_parts)), kind))
    nodes = (answers.groupBy("chunk").applyInArrow(
        lean_group(_postings(n_parts)), "key long, n long, tokens binary, prefix array<long>, point binary"))
    with bucketed(nodes, "nodes", "key") as nodes:  # equal sets of several chunks
        roots = node_links(nodes)
    return (members.join(roots, members.key == roots.node, "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("class")))


def node_links(nodes: DataFrame) -> DataFrame:
    """(node, root) of all nodes; those that link share a root.

    Star rounds: under each posting with members of several components, the
    others are held against one pivot (first the member that shares the
    largest part of its set, later one chosen by hash), each node against the
    pivot that it meets most often.  When a round joins nothing more, the
    trees look for what is left between components.
    """
    few = max(1, parts(nodes.sparkSession) // 8)
    roots = nodes.select("key", F.col("key").alias("root"))
    share = F.length("tokens") / (8 * F.col("n"))
    posted = nodes.select("key", share.alias("share"), F.explode("prefix").alias("token"))
    opened = None
    for turn in range(STAR_ROUNDS):
        named = posted.join(roots, "key") if turn else posted.withColumn("root", F.col("key"))
        first = F.struct("share", "key") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)), "key")
        pivot = (named.groupBy("token").agg(F.max_by(F.struct("key", "root"), first).alias("p"), F.min("root").alias("r0"),
                                            F.max("root").alias("r1")).filter("r0 <> r1").select("token", "p"))
        votes = (named.join(pivot, "token").filter("root <> p.root")
                 .groupBy("key", "root", "p").agg(F.count(F.lit(1)).alias("votes")))
        star = (votes.groupBy("key", "root").agg(F.max_by("p", F.struct("votes", "p")).alias("p"))
                .select(F.col("key").alias("a"), F.col("p.key").alias("b"), F.col("root").alias("ra"), F.col("p.root").alias("rb")))
        star = staged(bounded(star, nodes).coalesce(few), "pairs")
        links = staged(verified(star, nodes).coalesce(few), "links")
        if links.isEmpty():
            break
        roots = _merged(roots, links)
        if opened is None:
            posted = opened = _open(nodes, roots, share)
    bucket = F.pmod(F.xxhash64("token", "cell"), F.lit(4 * parts(nodes.sparkSession)))
    opened = _open(nodes, roots, share) if opened is None else opened
    named = opened.join(roots, "key").join(nodes.select("key", "n", "point"), "key")
    pairs = (_blocked(named).withColumn("bucket", bucket).groupBy("bucket")
             .applyInArrow(lean_group(_tree_pairs), "a long, b long, ra long, rb long").distinct())
    pairs = staged(pairs.coalesce(few), "pairs")
    links = staged(verified(pairs, nodes).coalesce(few), "links")
    roots = staged(roots, "roots") if links.isEmpty() else _merged(roots, links)
    return roots.select(F.col("key").alias("node"), "root")


def _open(nodes: DataFrame, roots: DataFrame, share) -> DataFrame:
    """The postings whose members are still in several components."""
    posted = (nodes.select("key", share.alias("share"), "prefix").join(roots, "key")
              .select("key", "root", "share", F.explode("prefix").alias("token")))
    tokens = posted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token")
    return staged(posted.join(staged(tokens, "tokens"), "token").select("key", "share", "token"), "postings")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after the links (ra, rb) between components."""
    few = max(1, parts(roots.sparkSession) // 8)
    up = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return staged(roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                  .select("key", F.coalesce("top", "root").alias("root")).coalesce(few), "roots")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns: the smallest doc_id, among
    rows of that doc_id the text with the smallest hash.

    Rows that agree in doc_id and text, or in doc_id without any shingle, stay
    once (the first by their columns as JSON); different texts under one doc_id
    stay unless they link.  Rows without doc_id all stay.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    group = ["class", F.when(F.col("class").isNull(), F.col("doc_id")).alias("lone")]
    keep = (_classes(docs).filter("doc_id is not null").groupBy(*group)
            .agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash"))
    whole = F.struct(*(F.col(c) for c in docs.columns))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), whole.alias("row"))
    kept = (named.join(keep, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash")
            .agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return kept.unionByName(docs.filter("doc_id is null"))
