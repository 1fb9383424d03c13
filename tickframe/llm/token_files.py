"""Token-id files with Simple-8b words.

Documents are tokenised, an end id closes each, and the ids go to binary files
in ascending doc_id order, one file per range of ids.

Coding: a 64-bit word has a selector in its 4 high bits; the other 60 bits hold
240 or 120 zeros, 60 ids of 1 bit, 30 of 2, ... or one of 60 bits.  Selector 0
is the escape: its payload is the place of a raw 64-bit id in the block's list
of exceptions.  Ids come in blocks; no word reaches past its block, so a block
is decoded without its neighbours, all words of a selector at once.

File (little-endian): header (magic, version, block size), blocks (words, then
exceptions), table of documents (doc_id, ids, whether doc_id is present), table
of blocks (byte offset, words, exceptions), footer (counts, offsets, crc32 of
all before it, magic).  ``TokenFile.ids(a, b)`` reads the blocks of a span only.

A file is written under a temporary name and then renamed, and its content
depends on its rows alone, so a repeated task replaces it by an equal one.  The
folder must be reachable by pyarrow's file systems (file, hdfs, s3, gs).

Null text counts as empty: the end id alone.  A null doc_id comes first.
Repeated rows are written as often as they occur; equal doc_ids are ordered by
text.  Other columns are ignored.  An empty table gives no file and no row.
Very long texts are tokenised whole; a task holds one document's ids at least.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import lean, shared_dir, slices, small_batches, staged, text_rows
from tickframe.llm.words import LOWER, text_bytes

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids in a block; blocks decoded together; text bytes of a file, about.
BLOCK, RUN, FILE_BYTES = 1 << 14, 32, 32 << 20
#: Words whose ids a task remembers.
CACHE = 1_000_000

#: (ids, bits) by selector; selector 0 is the escape.
LAYOUT = [(1, 64), (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15),
          (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
_COUNT = np.array([n for n, _ in LAYOUT])
_U = np.uint64
#: 2^bits of the selectors 1 to 15, and how many of them an id reaches; small ids by a table.
_LIMITS = np.array([1 << bits for _, bits in LAYOUT[1:]], _U)
_LEVEL = np.searchsorted(_LIMITS, np.arange(1 << 16).astype(_U), side="right").astype(np.uint8)
MAGIC, VERSION = b"TFS8", 1
HEADER, FOOTER = "<4sIII", "<QQQQQI4s"
FOOTER_SIZE = struct.calcsize(FOOTER)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, exceptions) of the unsigned 64-bit ``ids`` of a block."""
    ids = ids.astype(_U, copy=False)
    n, most = len(ids), int(ids.max(initial=0))
    chosen = np.zeros(n, np.int8)
    level = _LEVEL[ids] if most < len(_LEVEL) else np.searchsorted(_LIMITS, ids, side="right").astype(np.uint8)
    for selector in range(15, 0, -1):  # from few ids in a word to many: the last that fits is the fullest
        count, bits = LAYOUT[selector]
        if most >> bits == 0:
            chosen[:max(n - count + 1, 0)] = selector
            if n < count:
                break
            continue
        edge = np.concatenate([[-1], np.flatnonzero(level >= selector), [n]])
        free = np.diff(edge) - 1
        runs = np.flatnonzero(free >= count)
        if not len(runs):
            break
        turn = np.zeros(n + 1, np.int8)
        turn[edge[runs] + 1] = 1
        turn[edge[runs] + 2 + free[runs] - count] -= 1
        chosen[np.cumsum(turn[:n], dtype=np.int8) > 0] = selector
    after, at, i = (np.arange(n) + _COUNT[chosen]).tolist(), [], 0
    while i < n:
        at.append(i)
        i = after[i]
    at = np.array(at, np.int64)
    picked = chosen[at]
    out = np.zeros(len(at), _U)
    for selector in np.unique(picked):
        here = np.flatnonzero(picked == selector)
        if selector != ESCAPE:
            count, bits = LAYOUT[selector]
            parts = ids[at[here][:, None] + np.arange(count)] << (np.arange(count) * bits).astype(_U)
            out[here] = np.bitwise_or.reduce(parts, axis=1) | _U(int(selector) << 60)
    raw = np.flatnonzero(picked == ESCAPE)
    out[raw] = np.arange(len(raw), dtype=_U)
    return out, ids[at[raw]]


def unpack(words: np.ndarray, exceptions: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The ids of one block, or of several: ``first`` then holds, for each
    word, the place of its block's first exception."""
    selector = (words >> _U(60)).astype(np.int64)
    end = np.cumsum(_COUNT[selector])
    out = np.zeros(int(end[-1]) if len(end) else 0, _U)
    begin = end - _COUNT[selector]
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[begin[here]] = exceptions[words[here].astype(np.int64) + (0 if first is None else first[here])]
        elif LAYOUT[s][1]:
            count, bits = LAYOUT[s]
            shift = (np.arange(count) * bits).astype(_U)
            out[begin[here][:, None] + np.arange(count)] = (words[here][:, None] >> shift) & _U((1 << bits) - 1)
    return out


class Writer:
    """Writes documents to a binary stream; holds less than a block of ids between calls."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block, self.crc, self.at = stream, block, 0, 0
        self.rest, self.ids = np.zeros(0, _U), 0
        self.blocks, self.docs = ([], [], []), ([], [], [])
        self._put(struct.pack(HEADER, MAGIC, VERSION, block, 0))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.crc, self.at = zlib.crc32(data, self.crc), self.at + len(data)

    def _block(self, ids: np.ndarray) -> None:
        words, exceptions = pack(ids)
        for column, value in zip(self.blocks, (self.at, len(words), len(exceptions))):
            column.append(value)
        self._put(words.astype("<u8", copy=False).tobytes())
        self._put(exceptions.astype("<u8", copy=False).tobytes())

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with ``counts`` ids each, ``ids`` one after the other."""
        self.docs[0].extend(0 if d is None else d for d in doc_ids)
        self.docs[1].extend(int(n) for n in counts)
        self.docs[2].extend(d is not None for d in doc_ids)
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids.astype(_U, copy=False)])
        full = len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            self._block(ids[a:a + self.block])
        self.rest = ids[full:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        docs_at = self.at
        for column, kind in zip(self.docs, ("<i8", "<u8", "u1")):
            self._put(np.array(column, kind).tobytes())
        index_at = self.at
        for column in self.blocks:
            self._put(np.array(column, "<u8").tobytes())
        self.stream.write(struct.pack(FOOTER, self.ids, len(self.docs[0]), len(self.blocks[0]), docs_at, index_at, self.crc, MAGIC[::-1]))


class TokenFile:
    """Reads a file: its documents' table at once, ids block by block."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(0)
        magic, version, self.block, _ = struct.unpack(HEADER, stream.read(struct.calcsize(HEADER)))
        stream.seek(size - FOOTER_SIZE)
        self.n_ids, n, blocks, docs_at, index_at, self.crc, end = struct.unpack(FOOTER, stream.read(FOOTER_SIZE))
        if magic != MAGIC or end != MAGIC[::-1] or version != VERSION:
            raise ValueError("not a token file, or cut short")
        stream.seek(docs_at)
        self.doc_id = np.frombuffer(stream.read(8 * n), "<i8")
        self.counts = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        self.present = np.frombuffer(stream.read(n), "u1") > 0
        stream.seek(index_at)
        self.offset, self.words, self.exceptions = np.frombuffer(stream.read(24 * blocks), "<u8").astype(np.int64).reshape(3, blocks)
        self.start = np.cumsum(self.counts) - self.counts

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Ids of the blocks a to b - 1, decoded together."""
        if a >= b:
            return np.zeros(0, _U)
        self.stream.seek(int(self.offset[a]))
        sizes = self.words[a:b] + self.exceptions[a:b]
        data = np.frombuffer(self.stream.read(8 * int(sizes.sum())), "<u8")
        edge = np.cumsum(sizes) - sizes
        is_word = np.ones(len(data), bool)
        for k in np.flatnonzero(self.exceptions[a:b]):
            is_word[edge[k] + self.words[a + k]:edge[k] + sizes[k]] = False
        before = np.cumsum(self.exceptions[a:b]) - self.exceptions[a:b]
        return unpack(data[is_word], data[~is_word], np.repeat(before, self.words[a:b]))

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids a to b - 1 of the file."""
        if a >= b:
            return np.zeros(0, _U)
        first = a // self.block
        return self.blocks(first, (b - 1) // self.block + 1)[a - first * self.block:b - first * self.block]

    def documents(self, run: int = RUN):
        """(first document, last + 1, first id, ids) of each run of blocks; a
        document with ids in several runs is in each of them."""
        ends = self.start + self.counts
        for a in range(0, max(len(self.offset), 1), run):
            low, high = a * self.block, min((a + run) * self.block, self.n_ids)
            first = int(np.searchsorted(ends, low, side="right"))
            last = int(np.searchsorted(self.start, high, side="left")) if high > low else first
            yield first, last, low, self.blocks(a, min(a + run, len(self.offset)))


_SPACE, _LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True


def chunks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts whose ids don't depend on their neighbours: at a
    text's start, after white space, and where one of ``.,;:!?`` follows an
    ASCII or Latin-1 letter.  The tokenizer drops white space and never joins
    a letter with what follows there."""
    first = np.zeros(len(data), bool)
    space = _SPACE[data]
    if len(data) > 1:
        first[1:] = (space[:-1] & ~space[1:]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
    if len(data) > 2:
        latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # all other bytes after 0xC3 end a letter
        first[2:] |= latin & _MARK[data[2:]]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


#: One word of ASCII and Latin-1 letters: the tokenizer lowers it and looks up its bytes, nothing else applies.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How byte-level vocabularies write a byte (a fixed rule of this file format).
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class WordEncoder:
    """Token ids of texts by ``tokenizers``, each different part encoded once:
    single words by its model alone, all other parts by the whole tokenizer."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers
            path = public_tokenizers.path(path)
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.plain = path.rsplit("/", 1)[-1] == TOKENIZER  # the rule for single words holds for this vocabulary
        self._clear()

    def _clear(self):
        """Slot 0 is the end id; part i of ``known`` has slot i + 1; slot i has the ids begin[i]:begin[i + 1] of flat."""
        self.known, self.flat, self.begin = pa.array([], pa.large_string()), array("I", [self.end_id]), array("q", [0, 1])

    def _ids(self, parts: list[str]) -> list[list[int]]:
        out, tokenize, others = [None] * len(parts), self.tokenizer.model.tokenize, []
        for i, part in enumerate(parts):
            if self.plain and PLAIN.fullmatch(part):
                word = part if part.isascii() else part.lower().encode().decode("latin-1").translate(BYTE_CHARS)
                out[i] = [t.id for t in tokenize(word)]
            else:
                others.append(i)
        for a in range(0, len(others), 4096):
            these = others[a:a + 4096]
            for i, got in zip(these, self.tokenizer.encode_batch_fast([parts[i] for i in these], add_special_tokens=False)):
                out[i] = got.ids
        return out

    def _slots(self, parts: pa.Array) -> np.ndarray:
        if len(self.known) + len(parts) > CACHE:
            self._clear()
        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(at))
        slot = at.fill_null(-1).to_numpy().astype(np.int32) + 1
        slot[slot == 0] = len(self.known) + 1 + np.arange(len(new), dtype=np.int32)
        ids = self._ids(new.to_pylist())
        self.flat.extend(chain.from_iterable(ids))
        self.begin.extend((self.begin[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)).tolist())
        self.known = pa.concat_arrays([self.known, new])
        return slot

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids of each text), the end id included."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        start = chunks(data, offsets)
        per = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
        slot = np.zeros(len(start) + n, np.int32)  # 0, the end id, after the parts of each text
        if len(start):
            # without white space, and in lower case where a part is ASCII and has no special token's "<"
            other = np.logical_or.reduceat((data >= 128) | (data == 60), start)
            seen = ~_SPACE[data]
            data = np.where(np.repeat(other, np.diff(np.append(start, len(data)))), data, LOWER[data])[seen]
            place = np.append(np.append(0, np.cumsum(seen))[start], len(data)).astype(np.int64)
            buffers = [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data))]
            parts = pa.Array.from_buffers(pa.large_string(), len(start), buffers).dictionary_encode()
            own = self._slots(parts.dictionary)
            slot[np.arange(len(start)) + np.repeat(np.arange(n), per)] = own[parts.indices.to_numpy()]
        begin, flat = np.frombuffer(self.begin, np.int64), np.frombuffer(self.flat, np.uint32)
        length = np.diff(begin)[slot]
        end = np.cumsum(length)
        out = flat[np.repeat(begin[slot] - (end - length), length) + np.arange(end[-1] if n else 0)]
        last = end[np.cumsum(per + 1) - 1]
        return out, np.diff(last, prepend=0)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _written(folder, tokenizer, end_id, block):
    def run(batches):
        from pyspark import TaskContext

        encode, out, rows = WordEncoder(tokenizer, end_id), None, 0
        shard = TaskContext.get().partitionId()
        fs, base = _filesystem(folder)
        name = f"{base}/part-{shard:08d}.s8b"
        temporary = f"{base}/_{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                if out is None:
                    stream = fs.open_output_stream(temporary)
                    out = Writer(stream, block)
                out.add(part.column("doc_id").to_pylist(), *encode(part.column("text")))
                rows += part.num_rows
        if out is not None:
            out.close()
            stream.close()
            fs.move(temporary, name)
            size = fs.get_file_info(name).size
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name.rsplit("/", 1)[1]], "bytes": [size],
                                              "n_docs": [rows], "n_tokens": [out.ids]})
    return run


def write(docs: DataFrame, folder: str | None = None, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK,
          file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the files; (folder, manifest): one row per file with shard, path,
    bytes, n_docs, n_tokens and start (the ids in the files before it)."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    folder = folder or f"{shared_dir(spark)}/tickframe-token-files-{uuid.uuid4().hex}"
    fs, base = _filesystem(folder)
    fs.create_dir(base)
    rows = text_rows(docs)
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / file_bytes))
    ordered = (rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").drop("_h")
               .sortWithinPartitions("doc_id", "text"))
    manifest = staged(ordered.mapInArrow(lean(_written(folder, tokenizer, end_id, block)),
                                         "shard int, path string, bytes long, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return folder, manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(folder, keep_ids):
    def run(batches):
        fs, base = _filesystem(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:4 + keep_ids]
        for batch in batches:
            for name, size, before in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                with fs.open_input_file(f"{base}/{name}") as stream:
                    file = TokenFile(stream, size)
                    crc, kept = 0, []
                    for first, last, low, ids in file.documents():
                        raw, done, out = memoryview(ids.astype("<u4").tobytes()), first, []
                        for d in range(first, last):
                            a, b = int(file.start[d]), int(file.start[d] + file.counts[d])
                            piece = raw[4 * max(a - low, 0):4 * (b - low)]
                            crc = zlib.crc32(piece, crc)
                            if keep_ids:
                                kept.append(bytes(piece))
                            if b <= low + len(ids):
                                out.append((crc, b"".join(kept)))
                                crc, kept, done = 0, [], d + 1
                        if out:
                            span = slice(first, done)
                            columns = [pa.array(file.doc_id[span], mask=~file.present[span]), pa.array(file.start[span] + before),
                                       pa.array(file.counts[span]), pa.array([c for c, _ in out], pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns + [pa.array([k for _, k in out], pa.binary())] * keep_ids, names)
    return run


def read(folder: str, manifest: DataFrame, *, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if wanted, ids as little-endian
    32-bit integers) of every document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    files = manifest.select("shard", "path", "bytes", "start")
    files = files.repartition(_tasks(files), F.xxhash64("shard", F.lit(11)))
    return files.mapInArrow(lean(_read(folder, keep_ids)), schema)


def _tasks(files: DataFrame) -> int:
    return int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def token_files(docs: DataFrame, folder: str | None = None, *, keep_ids: bool = False, **options) -> DataFrame:
    """Write the documents' ids and read them back."""
    return read(*write(docs, folder, **options), keep_ids=keep_ids)
