"""Exact top-k search by multi-resolution segment statistics.

Components become integers floor(scale * x); the score is the integer inner
product, so nearness is |q|^2 + |x|^2 - 2 <q, x>.  Each vector is cut into 1,
4, 16, ... segments; with the means m and deviations s of both vectors, the
squared distance of two segments of length l is at least
l * ((m_q - m_x)^2 + (s_q - s_x)^2), that is, the inner product is at most
l * (m_q m_x + s_q s_x).  From coarse to fine, rows whose bound cannot reach
the query's k-th best exact score so far are left out; the survivors of the
finest level get exact integer scores.  The result is exact.

Rows and queries meet in blocks (row block, query block), so no task holds
more than two bounded blocks; copies of one vector are scored once per block.
Scores beyond 64 bits are held at the largest long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches
from tickframe.llm.vectors import BLOCK_QUERIES, BLOCK_ROWS, Distinct, clean, hashed, matrix, query_rows, ranked

SCALE = 64
LEVELS = (1, 4, 16, 32)
#: Rows with the best coarse bounds that get exact scores first.
PROBE = 64
#: Queries bounded together; the share of pairs above which a level is one matrix product.
BATCH, DENSE = 128, 0.1
_LONG = (1 << 63) - 1


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * mean and sqrt(l) * deviation of each segment, side by side."""
    cuts = np.unique(np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int))
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / size
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / size
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0) * size)])


def exact_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products of row pairs; held at the long range if they could pass it."""
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1]
    if most < 2 ** 53:
        return (rows * queries).sum(1).astype(np.int64)
    if most < 2 ** 62:
        return (rows.astype(np.int64) * queries.astype(np.int64)).sum(1)
    return np.array([max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(r, q)))) for r, q in zip(rows, queries)], np.int64)


def _products(left: np.ndarray, right: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """left @ right.T where ``keep`` holds; the rest is -inf.  Few pairs are multiplied one by one."""
    if keep.mean() > DENSE:
        return np.where(keep, left @ right.T, -np.inf)
    out = np.full(keep.shape, -np.inf)
    i, j = np.nonzero(keep)
    for a in range(0, len(i), 1 << 16):
        cut = slice(a, a + (1 << 16))
        out[i[cut], j[cut]] = (left[i[cut]] * right[j[cut]]).sum(1)
    return out


def best_of(rows: Distinct, levels: list[np.ndarray], queries: np.ndarray, ids: np.ndarray, k: int):
    """Per query its k best rows of a block (ids, scores), and how many exact scores were computed."""
    copies = np.diff(rows.start)
    asked = [statistics(queries, s) for s in LEVELS]
    norm = np.sqrt((levels[0] ** 2).sum(1)).max(initial=0)
    slack = 1e-9 * (np.sqrt((queries * queries).sum(1)) * norm + 1)
    keep = np.ones((len(queries), len(rows.vectors)), bool)
    bound = _products(asked[0], levels[0], keep)
    more = k + rows.most
    n = min(max(PROBE, more), bound.shape[1])
    probe = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    own = np.repeat(np.arange(len(queries)), n)
    score = exact_scores(rows.vectors[probe.ravel()], queries[own]).reshape(-1, n)
    order = np.argsort(-score, axis=1, kind="stable")
    held = np.cumsum(copies[np.take_along_axis(probe, order, 1)], axis=1)
    enough = (held < more).sum(1)  # copies of one vector count, some may be the query's own
    least = np.where(enough < n, np.take_along_axis(score, order, 1)[np.arange(len(queries)), np.minimum(enough, n - 1)], -np.inf)
    least = (least - slack)[:, None]
    keep &= bound >= least
    for level, of_query in zip(levels[1:], asked[1:]):
        keep &= _products(of_query, level, keep) >= least
    safe = np.abs(rows.vectors).max(initial=0) * np.abs(queries).max(initial=0) * queries.shape[1] < 2 ** 53
    if safe:
        exact = _products(queries, rows.vectors, keep)
    else:
        i, j = np.nonzero(keep)
        exact = np.full(keep.shape, -np.inf)
        exact[i, j] = exact_scores(rows.vectors[j], queries[i])
    out = []
    for q in range(len(queries)):
        found = np.flatnonzero(keep[q])
        if len(found) > more:
            cut = np.partition(exact[q, found], len(found) - more)[len(found) - more]
            found = found[exact[q, found] >= cut]
        values = exact[q, found].astype(np.int64) if safe else exact_scores(rows.vectors[found], np.broadcast_to(queries[q], (len(found), queries.shape[1])))
        out.append(rows.best(found, values, ids[q], k))
    return out, int(keep.sum())


def _searched(width, k):
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        ids, v = table.column("vec_id").to_numpy(), matrix(table.column("v"), width)
        out = [[], [], []]
        if is_query.any() and not is_query.all():
            rows = Distinct(v[~is_query], ids[~is_query], k)
            levels = [statistics(rows.vectors, s) for s in LEVELS]
            queries, own = v[is_query], ids[is_query]
            for a in range(0, len(queries), BATCH):
                found, _ = best_of(rows, levels, queries[a:a + BATCH], own[a:a + BATCH], k)
                for q, (best, score) in zip(own[a:a + BATCH], found):
                    out[0] += [q] * len(best)
                    out[1] += best.tolist()
                    out[2] += score.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), out)})
    return run


def top_k(embeddings: DataFrame, is_query, *, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores for every row that
    ``is_query`` (a condition on vec_id) takes, its own row left out."""
    small_batches(embeddings.sparkSession, 4096)
    rows = clean(embeddings).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()
    n, width, queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(is_query, 1))).first()
    blocks, spread = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil((queries or 0) / BLOCK_QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = (query_rows(rows, is_query).withColumn("block", every(blocks))
            .withColumn("part", hashed("vec_id", F.lit(spread)).cast("long")).withColumn("is_query", F.lit(True)))
    right = (rows.withColumn("block", hashed("vec_id", F.lit(blocks)).cast("long"))
             .withColumn("part", every(spread)).withColumn("is_query", F.lit(False)))
    found = left.unionByName(right).groupBy("block", "part").applyInArrow(
        _searched(width or 1, k), "query_id long, vec_id long, score long")
    return ranked(found, k)
