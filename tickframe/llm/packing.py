"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids; each bin takes the
largest remaining piece and the set of available lengths that fills the rest
best, found by subset-sum dynamic programming on a bitset.  Only lengths
matter, so the program runs on the length histogram (``capacity`` counters,
whatever the corpus): a found combination is used as often as the counters
allow.  Pieces then look up their place by their rank among pieces of equal
length; ranks come from counts per hash bucket, so a frequent length is never
ranked in one task.

Null text counts as empty: one piece with the end id alone.  Repeated rows are
packed as often as they occur; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import lean, parts, slices, small_batches, staged, text_rows

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: The public pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone are split alike by every regex library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
#: Hash buckets that ranks are counted in, per shuffle partition.
BUCKETS = 4


class Encoder:
    """Token ids of a vocabulary file in the tokenizers format.

    Plain texts go through the faster library with the same ranks; texts with
    rare characters or a special token's string go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken

        if "/" not in path:
            import public_tokenizers
            path = public_tokenizers.path(path)
        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer
            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces; the first may be shorter."""
    first = total % capacity or capacity
    return [(0, min(first, total))] + [(s, capacity) for s in range(first, total, capacity)]


def _pieces(path, capacity, end_id, keep_ids):
    def run(batches):
        encode = Encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                cols = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(text), end_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start:start + length].tobytes()
                        for col, v in zip(cols, (doc_id, k, start, length, zlib.crc32(raw), raw if keep_ids else None)):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)][:5 + keep_ids],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + keep_ids])
    return run


def pieces(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if wanted, ids as little-endian bytes)."""
    small_batches(docs.sparkSession, 256)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return text_rows(docs).mapInArrow(lean(_pieces(tokenizer, capacity, end_id, keep_ids)), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    ``reach`` has bit s set if sum s can be made.  Lengths enter from the
    largest, and a sum is taken back by the earliest entries that reach it, so
    large pieces are used up first.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    goal, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> goal & 1:
            used[length] = used.get(length, 0) + copies
            goal -= length * copies
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces per length in a bin, bins) until no length is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        combo = fullest({k: v for k, v in left.items() if v}, capacity - top)
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[k] // m for k, m in combo.items())
        out.append((combo, times))
        for k, m in combo.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return out


def lookup(steps: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first bin, offset in the bin), sorted."""
    rows, taken, first_bin = [], {}, 0
    for combo, times in steps:
        offset = 0
        for length in sorted(combo, reverse=True):
            rows.append((length, taken.get(length, 0), combo[length], first_bin, offset))
            taken[length] = taken.get(length, 0) + combo[length] * times
            offset += length * combo[length]
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(shared):
    def run(batches):
        table = shared.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                [*batch.schema.names[:-1], "sequence_id", "offset"])
    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.  ``found`` is read three times: pass a stored table."""
    spark = found.sparkSession
    n = BUCKETS * parts(spark)
    rows = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    cells = rows.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.join(cells, ["_bucket", "length"])
              .withColumn("_rank", (F.col("_before") + F.row_number().over(within) - 1).cast("long"))
              .select(*found.columns, "_rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(lean(_placed(table)), f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``capacity`` tokens."""
    found = staged(pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    return pack(found, capacity)
