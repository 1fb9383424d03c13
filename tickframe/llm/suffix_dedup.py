"""Repeated passages by a sparse suffix array.

Which stretches of ``MIN_WORDS`` words or more of a document occur in another
document.  Words are runs without white space, A-Z in lower case.

1. Select: among the ``GRAM``-word grams of every ``MIN_WORDS``-word window
   the one with the smallest hash is its minimiser (the first, if equal).
   Equal windows have equal minimisers, so only suffixes at these positions
   are kept, about one in ``(MIN_WORDS - GRAM) / 2`` words.
2. Sort: suffixes are dealt by their minimiser and sorted; with each go, as
   hashes, the windows to its left and right that it stands for.
3. Compare and extend: neighbours in the sorted order with an equal window in
   another document match there; matching windows next to each other extend
   the match left and right, across minimisers, to its full length.

A task first compares the suffixes of its own chunk: matches are settled at
once and one copy of each window is sent on, so a passage that a third of all
documents share reaches the sort once per chunk.  The result is exact (up to
equal 88-bit hashes of different windows).  Null and short texts have no
passage.  Rows that repeat a doc_id are one document to this operator, and
rows without doc_id are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.common import lean, lean_group, parts, slices, small_batches, text_rows

MIN_WORDS, GRAM = 50, 26
#: Words gathered by a task before it compares and sends them; words per part.
FLUSH = 500_000
PART = 500_000
_U = np.uint64


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * words.powers(len(h), words._BASE), out=total[1:])
    return words.mix((total[n:] - total[:-n]) * words.powers(len(h) - n + 1, words._INVERSE))


def minimisers(h: np.ndarray, counts: np.ndarray, size: int = MIN_WORDS, gram: int = GRAM):
    """(window start, minimiser start, minimiser hash, window hash) of all windows inside one text.

    ``counts`` holds the words per text; starts count from the first word of all.
    """
    ends = np.cumsum(counts)
    n = len(h) - size + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    grams = rolling(h, gram)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, size - gram + 1):
        other = grams[j:j + n]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    left = np.repeat(ends, counts)[:n] - np.arange(n)
    keep = np.flatnonzero(left >= size)
    return keep, at[keep], least[keep], rolling(h, size)[keep]


def _chunks(batches):
    """(doc ids, words per text, word hashes) of about FLUSH words."""
    ids, counts, hashes, n = [], [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = words.text_bytes(part.column("text"))
            low = words.LOWER[data]
            start, end, text = words.spans(words.SPACE[low], off)
            ids.append(part.column("doc_id").to_numpy(zero_copy_only=False))
            counts.append(np.bincount(text, minlength=part.num_rows))
            hashes.append(words.hashes(low, start, end))
            n += len(start)
            if n >= FLUSH:
                yield np.concatenate(ids), np.concatenate(counts), np.concatenate(hashes)
                ids, counts, hashes, n = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(counts), np.concatenate(hashes)


def _matched(window: np.ndarray, doc: np.ndarray, seed: np.ndarray | None = None):
    """Sort suffixes by minimiser and window and compare neighbours.

    (windows that another document has too, the first of each window)
    """
    order = np.lexsort((doc, window)) if seed is None else np.lexsort((doc, window, seed))
    w, d = window[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    if seed is not None:
        new[1:] |= seed[order][1:] != seed[order][:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(w)) - 1
    shared = d[begin] != d[last] if len(w) else np.zeros(0, bool)
    hit, first = np.zeros(len(w), bool), np.zeros(len(w), bool)
    hit[order] = np.repeat(shared, last - begin + 1)
    first[order[begin]] = True
    return hit, first


def _stretches(doc: np.ndarray, start: np.ndarray):
    """Matching windows next to each other as (doc, start, end)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + MIN_WORDS)
    begin = np.flatnonzero(cut)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], start[last] + MIN_WORDS if len(doc) else start


def _suffixes(n_parts):
    """Per chunk and part the kept suffixes: document, minimiser, first window,
    number of windows, low 40 bits of each window's hash.  Part numbers from
    ``n_parts`` carry settled stretches."""
    def run(batches):
        for ids, counts, h in _chunks(batches):
            start, _, seed, window = minimisers(h, counts)
            if not len(start):
                continue
            text = np.repeat(np.arange(len(counts)), counts)[start]
            doc, place = ids[text], start - (np.cumsum(counts) - counts)[text]
            hit, first = _matched(window, doc)
            rows = [[], [], [], [], [], []]
            d, a, b = _stretches(doc[hit], place[hit])
            for p in range(0, len(d), 4096):  # spread over the parts
                cut = slice(p, p + 4096)
                for col, v in zip(rows, (n_parts + int(words.mix(d[p:p + 1].view(np.uint64))[0] % _U(n_parts)), d[cut].tobytes(), b"", a[cut].astype(np.uint32).tobytes(),
                                         b[cut].astype(np.uint32).tobytes(), b"")):
                    col.append(v)
            send = first | ~hit  # of a settled window one copy, of others all places
            doc, place, seed, window = doc[send], place[send], seed[send], window[send]
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (seed[1:] != seed[:-1])
            head = np.flatnonzero(head)
            many = np.diff(np.append(head, len(doc)))
            # mixed again: a minimiser is the smallest of many hashes, so its high bits are not even
            part = (((words.mix(seed[head]) >> _U(32)) * _U(n_parts)) >> _U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
            low = np.ascontiguousarray(window).view(np.uint8).reshape(-1, 8)[:, :5]
            for p in range(n_parts):
                mine = order[cuts[p]:cuts[p + 1]]
                if len(mine):
                    n = many[mine]
                    at = np.repeat(head[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    for col, v in zip(rows, (p, doc[head[mine]].tobytes(), seed[head[mine]].tobytes(),
                                             place[head[mine]].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), low[at].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64())] + [pa.array(c, pa.binary()) for c in rows[1:]],
                                             ["part", "docs", "seeds", "starts", "counts", "windows"])
    return run


def _compared(n_parts):
    """The stretches that match between chunks, and the settled ones."""
    def run(table: pa.Table) -> pa.Table:
        raw = {c: b"".join(table.column(c).to_pylist()) for c in ("docs", "seeds", "starts", "counts", "windows")}
        doc, seed = np.frombuffer(raw["docs"], np.int64), np.frombuffer(raw["seeds"], np.uint64)
        place, count = (np.frombuffer(raw[c], np.uint32).astype(np.int64) for c in ("starts", "counts"))
        if table.column("part")[0].as_py() >= n_parts:
            end = count
        else:
            wide = np.zeros((len(raw["windows"]) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(raw["windows"], np.uint8).reshape(-1, 5)
            which = np.repeat(np.arange(len(doc)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            hit, _ = _matched(wide.view(np.uint64).ravel(), doc[which], seed[which])
            doc, place, end = _stretches(doc[which][hit], (place[which] + nth)[hit])
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(place, pa.int64()), "end": pa.array(end, pa.int64())})
    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, passage, start, end, n_words): the passages of each document
    that occur elsewhere, as word positions (end exclusive), in order."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = text_rows(docs).filter("doc_id is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(parts(spark), math.ceil(size / 6 / PART))
    found = (rows.mapInArrow(lean(_suffixes(n_parts)), "part long, docs binary, seeds binary, starts binary, counts binary, windows binary")
             .groupBy("part").applyInArrow(lean_group(_compared(n_parts)), "doc_id long, start long, end long"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") > F.col("reach"), F.lit(True)), 1).otherwise(0)
    return (found.withColumn("reach", reach).withColumn("passage", F.sum(new).over(order).cast("int"))
            .groupBy("doc_id", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .withColumn("n_words", F.col("end") - F.col("start")))
