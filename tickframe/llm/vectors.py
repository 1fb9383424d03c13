"""Shared parts of the vector searches: clean vectors, blocks, final ranks.

A vector that is null, empty or holds a null or non-finite component takes no
part, nor does a row without id.  Rows equal in id and vector count once;
different vectors under one id are all candidates (so an id may be found more
than once), and as a query such an id asks with the smallest of them.
Vectors of different lengths are compared as if the shorter were padded with
zeros.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators.ranking import top_n_per_key

#: Rows and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def clean(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): usable vectors as arrays of doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)).distinct()


def query_rows(rows: DataFrame, is_query) -> DataFrame:
    """(vec_id, v): the queries among clean rows, one vector per id."""
    return rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as a matrix of doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == size[0]).all():
        out[:, :size[0]] = flat.reshape(len(column), -1)
    else:
        for i, x in enumerate(np.split(flat, np.cumsum(size)[:-1]) if len(size) else []):
            out[i, :len(x)] = x
    return out


class Distinct:
    """The different vectors of a block, each with its ``k + 1`` smallest ids, an
    id at most ``k`` times.

    More copies can never be among a query's k best, as ties go to smaller ids
    and at most one of the k + 1 ids is the query's own.  ``most`` is the number
    of rows that one id, so also a query's own, has in the block.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
        _, first, same = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, same))
        vector, own = same[order], ids[order]
        start = np.searchsorted(vector, np.arange(len(first)))
        new = np.ones(len(own), bool)
        new[1:] = (vector[1:] != vector[:-1]) | (own[1:] != own[:-1])
        nth_id = np.cumsum(new)
        copy = np.arange(len(own)) - np.flatnonzero(new)[nth_id - 1]
        keep = (nth_id - nth_id[start[vector]] <= k) & (copy < k)
        self.vectors, self.first = vectors[first], first
        self.of, self.ids = vector[keep], own[keep]
        self.start = np.searchsorted(self.of, np.arange(len(first) + 1))
        self.most = int(np.unique(ids, return_counts=True)[1].max(initial=1))

    def best(self, found: np.ndarray, scores: np.ndarray, own: int, k: int):
        """(ids, scores) of the k best rows among the distinct vectors ``found``."""
        n = self.start[found + 1] - self.start[found]
        at = np.repeat(self.start[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, scores = self.ids[at], np.repeat(scores, n)
        keep = ids != own
        ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query over all blocks, with their rank."""
    best = [F.col("score").desc(), F.col("vec_id").asc()]
    kept = top_n_per_key(found, "query_id", best, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("int")
    return kept.select("query_id", rank.alias("rank"), "vec_id", "score")


def hashed(column: str, blocks):
    """The block of an id."""
    return F.pmod(F.xxhash64(column, F.lit(3)), blocks)
