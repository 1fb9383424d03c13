"""Secret scans: a worklist of decoded layers, rescanned until nothing new comes.

The whole text is the first layer.  A layer is scanned for the three kinds of
secrets, then unwrapped: URL escapes, Unicode escapes (backslash, HTML and
full-width forms), base64 runs (all four alignments, line-wrapped runs),
UTF-16 content and compressed data at any place in their bytes (zlib, gzip,
bzip2, xz, zstd; adjoining members are one stream).  Decoded bytes are read as
UTF-8, where they aren't as Latin-1.
Every new layer joins the worklist unless its text was seen before, so cycles
end.  Each character of a layer knows the span of the original text that it
came from; a finding is reported as that span.

A decompressed layer is read in windows of ``WINDOW`` characters that overlap
by ``OVERLAP``; an encoded run or a compressed member that a window cuts off is
carried whole into the next one, up to ``LONGEST`` bytes, so memory stays
bounded.  Null text
counts as empty; empty texts and tables give no finding; repeated rows give
repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches

# Fixed values of the task: the kinds in their order, and the least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}")
QUOTED = re.compile(r"[A-Za-z0-9_.~/+-]*%[0-9A-Fa-f]{2}(?:[A-Za-z0-9_.~/+-]|%[0-9A-Fa-f]{2})*")
UNIT = re.compile(r"%[0-9A-Fa-f]{2}|.")
UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                     r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|([\uff01-\uff5e])")
#: The shortest secret ("token:" and 8 characters) has 14 bytes, 19 in base64.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{19,}={0,2}")
#: Bytes that a secret could be in: plain ones, full-width ones in UTF-8, and what LATIN finds in UTF-8.
KEEP = re.compile(rb"[\t\n\r\x20-\x7e]{14}|\xef(?:\xbc[\x81-\xbf]|\xbd[\x80-\x9e])|\xc3\xaf\xc2[\xbc\xbd]"
                  rb"|\x1f\xc2\x8b|x(?:[\x01\x5e]|\xc2\x9c|\xc3\x9a)|BZh|\xc3\xbd7zXZ|\(\xc2\xb5/\xc3\xbd")
#: UTF-16 of printable or full-width characters.
WIDE = ((re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00|[\x01-\x5e]\xff){14,}"), "utf-16-le"),
        (re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]|\xff[\x01-\x5e]){14,}"), "utf-16-be"))
URL_SAFE = str.maketrans("-_", "+/")
#: Starts of gzip, zlib, bzip2, xz and zstd members.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: The same as characters, UTF-8 of full-width characters and UTF-16.
LATIN = re.compile(MAGIC.pattern.decode("latin-1") + "|\xef(?:\xbc[\x81-\xbf]|\xbd[\x80-\x9e])"
                   "|" + "|".join(p.pattern.decode("latin-1") for p, _ in WIDE))
BELOW_256 = re.compile("[\x00-\xff]+")
#: Bytes read at a time (little comes out of so few at once), and the bytes of encoded runs.
PIECE = 512
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=%.~-\\{}&#;\r\n"
#: A window of unpacked data, its overlap, and the longest run carried into the next one.
WINDOW, OVERLAP, LONGEST = 8 << 20, 1 << 16, 64 << 20

#: What a batch is searched for first (RE2, one pass over the whole batch each).
HINTS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]""",
    "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{32}", "url": r"%[0-9A-Fa-f]{2}",
    "unicode": r"\\[uUx][0-9A-Fa-f{]|&#|[\x{ff01}-\x{ff5e}]", "base64": r"[A-Za-z0-9+/_-]{19}",
}
FINDINGS = "array<struct<kind:string,start:int,end:int,depth:int,via:string>>"


def scan(text: str, hints=frozenset(HINTS)) -> list[tuple[str, int, int]]:
    """Base findings: leftmost non-overlapping per kind, failing matches dropped."""
    got = []
    if "assign" in hints:
        got += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "access" in hints:
        got += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if "hex" in hints:
        got += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return got


def flat(place) -> bool:
    """One place for all characters, held once."""
    return place.strides == (0,) and len(place) > 0


def pick(place, index):
    return np.broadcast_to(place[:1], len(index)) if flat(place) else place[index]


class Layer:
    """A text whose character i came from [first[i], last[i]) of the original;
    ``data`` are the bytes that it was decoded from, with their places."""

    def __init__(self, text: str, first, last, via: tuple = (), data: tuple = ()):
        self.text, self.first, self.last, self.via, self.data = text, first, last, via, data

    @classmethod
    def of(cls, data: bytes, first, last, via: tuple) -> Layer:
        return cls(*_text(data, first, last), via, (data, first, last))

    @classmethod
    def root(cls, text: str) -> Layer:
        place = np.arange(len(text) + 1)
        return cls(text, place[:-1], place[1:])

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def replaced(self, pieces, via: str) -> Layer:
        """A layer with each (start, end, text) piece put in place of the source."""
        text, first, last, at = [], [], [], 0
        for start, end, new in pieces:
            text += [self.text[at:start], new]
            first += [self.first[at:start], np.full(len(new), 0)]
            last += [self.last[at:start], np.full(len(new), 0)]
            if new:
                first[-1] += int(self.first[start])
                last[-1] += int(self.last[end - 1])
            at = end
        whole = "".join([*text, self.text[at:]])
        if flat(self.first):
            return Layer(whole, *(np.broadcast_to(x[:1], len(whole)) for x in (self.first, self.last)), (*self.via, via))
        return Layer(whole, np.concatenate([*first, self.first[at:]]),
                     np.concatenate([*last, self.last[at:]]), (*self.via, via))


def _stream(data: bytes, start: int, ends: list):
    """Output of the adjoining compressed members from ``start`` on; ``ends``
    gets (end, state) of each: done, cut off by the end of the data, or bad."""
    at, kind = start, data[start]
    while MAGIC.match(data, at):
        if data[at] in (0x1F, 0x78):
            unpack, bound = zlib.decompressobj(wbits=47), ()
        elif data[at] == 0x28:
            unpack, bound = zstandard.ZstdDecompressor().decompressobj(), ()
        else:
            unpack, bound = (bz2.BZ2Decompressor() if data[at] == 0x42 else lzma.LZMADecompressor()), (WINDOW,)
        if at > start and data[at] != kind:
            return
        some, stop = False, at
        try:
            while stop < len(data) and not unpack.eof:
                piece = data[stop:stop + PIECE]
                stop += len(piece)
                while out := unpack.decompress(piece, *bound):
                    some = True
                    yield out
                    piece = b""
                    if not bound or unpack.eof:
                        break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            if some:
                ends.append((stop, "bad"))
            return
        if not unpack.eof:
            ends.append((stop, "cut"))
            return
        at = stop - len(unpack.unused_data)
        ends.append((at, "done"))


def _carried(window: bytes) -> int:
    """Where the next window starts: the overlap, and before it an encoded run
    or a compressed member that reaches the end of this window."""
    at = min(len(window) - OVERLAP, len(window.rstrip(RUN)))
    for m in MAGIC.finditer(window, 0, max(at, 0)):
        ends = []
        for _ in _stream(window, m.start(), ends):
            pass
        if ends and ends[-1][1] == "cut":
            at = m.start()
            break
    return max(at if len(window) - at <= LONGEST else len(window) - OVERLAP, 0)


def _windows(pieces):
    held, size = [], 0
    for out in pieces:
        held.append(out)
        size += len(out)
        if size >= WINDOW:
            window = b"".join(held)
            yield window
            tail = window[_carried(window):]
            held, size = [tail], 0
    if size:
        yield b"".join(held)


def decompressed(data: bytes, partial: bool = True):
    """(start, end, window) of everything packed in the data, at any offset;
    without ``partial`` only members that end, as the data goes on with other text."""
    at = 0
    while m := MAGIC.search(data, at):
        start, ends, held, size = m.start(), [], [], 0
        for out in _stream(data, start, ends):
            size += len(out)
            if size <= WINDOW:
                held.append(out)
        done = [e for e, state in ends if state == "done"]
        at = done[-1] if done else start + 1
        if size and (partial or done):
            whole = partial or ends[-1][1] == "done"
            again = held if whole and size <= WINDOW else _stream(data if whole else data[:at], start, [])
            for window in _windows(again):
                yield start, ends[-1][0] if whole else at, window


def _text(data: bytes, first, last):
    """Bytes as UTF-8 with the places of the characters; bytes that aren't UTF-8 as Latin-1."""
    if data.isascii():
        return data.decode("ascii"), first, last
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    odd = (code >= 0xDC80) & (code <= 0xDCFF)
    width = 1 + ((code >= 0x80) & ~odd) + ((code >= 0x800) & ~odd) + (code >= 0x10000)
    if flat(first):
        first, last = (np.broadcast_to(x[:1], len(code)) for x in (first, last))
    else:
        end = np.cumsum(width)
        first, last = first[end - width], last[end - 1]
    if odd.any():
        text = np.where(odd, code - 0xDC00, code).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return text, first, last


def _wide(data: bytes):
    """(start, end, text) of UTF-16 runs, little and big end first; of two readings
    of the same run, one byte apart, the one that has all characters."""
    runs = sorted(((*m.span(), m[0].decode(code)) for p, code in WIDE for m in p.finditer(data)),
                  key=lambda x: (x[0], -x[1]))
    kept = (0, 0, "")
    for run in runs:
        if run[1] > kept[1] or run[2] not in kept[2]:
            kept = run
            yield run


def _unpacked(data: bytes, first, last, via: tuple, partial: bool = True):
    for start, end, window in decompressed(data, partial):
        n = len(window)
        yield Layer.of(window, np.broadcast_to(np.int64(first[start:end].min()), n),
                       np.broadcast_to(np.int64(last[start:end].max()), n), (*via, "compressed"))


def _bytes(layer: Layer):
    """What is packed in a decoded layer's bytes, or in its characters below 256 taken as bytes."""
    if layer.data:
        data, first, last = layer.data
        yield from _unpacked(data, first, last, layer.via, flat(first) or layer.via[-1] not in ("url", "bytes"))
        for start, end, text in _wide(data):
            yield Layer(text, first[start:end:2], last[start + 1:end:2], (*layer.via, "utf16"))
        if len(data) == len(layer.text):
            return
    if LATIN.search(layer.text):
        for m in BELOW_256.finditer(layer.text):
            if LATIN.search(m[0]):
                at = slice(*m.span())
                yield Layer.of(m[0].encode("latin-1"), layer.first[at], layer.last[at], (*layer.via, "bytes"))


def _url(layer: Layer):
    raw = layer.text.encode("utf-8", "surrogatepass")
    starts = np.fromiter((m.start() for m in ESCAPE.finditer(raw)), np.int64)
    if not len(starts):
        return
    code = np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), "<u4")
    char = np.repeat(np.arange(len(code)), 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    low, high = char, char.copy()
    high[starts] += 2
    keep = np.ones(len(raw), bool)
    keep[starts + 1] = keep[starts + 2] = False
    data = unquote_to_bytes(raw)
    yield Layer.of(data, pick(layer.first, low[keep]), pick(layer.last, high[keep]), (*layer.via, "url"))
    # A quoted word alone: a member that is cut off there must not go on with the text behind it.
    for m in QUOTED.finditer(layer.text):
        data = unquote_to_bytes(m[0])
        if MAGIC.search(data):
            low = np.array([x.start() for x in UNIT.finditer(m[0])]) + m.start()
            high = np.append(low[1:], m.end()) - 1
            yield from _unpacked(data, pick(layer.first, low), pick(layer.last, high), (*layer.via, "url"))


def _unicode(layer: Layer):
    pieces, data, low, high = [], bytearray(), [], []
    for m in UNICODE.finditer(layer.text):
        digits = next((g for g in m.groups()[:5] if g), None)
        code = int(digits, 16) if digits else int(m[6]) if m[6] else ord(m[7]) - 0xFEE0
        if code < 0x110000:
            pieces.append((m.start(), m.end(), chr(code)))
    if not pieces:
        return
    yield layer.replaced(pieces, "unicode")
    # A run of escapes alone, as in _url.
    for start, end, new in [*pieces, (-1, -1, "")]:
        if data and (start != high[-1] + 1 or not "" < new < "\u0100"):
            if MAGIC.search(data):
                yield from _unpacked(bytes(data), pick(layer.first, np.array(low)), pick(layer.last, np.array(high)),
                                     (*layer.via, "unicode", "bytes"))
            data, low, high = bytearray(), [], []
        if "" < new < "\u0100":
            data.append(ord(new))
            low.append(start)
            high.append(end - 1)


def _base64(layer: Layer):
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").translate(URL_SAFE)
        place = None
        if "\n" in run:
            place = None if flat(layer.first) else np.array([i for i, c in enumerate(run) if c not in "\r\n"])
            run = run.replace("\r", "").replace("\n", "")
        for skip in range(4):
            part = run[skip:]
            part = part[:-1] if len(part) % 4 == 1 else part
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            if not KEEP.search(data) and not any(p.search(data) for p, _ in WIDE) and not MAGIC.search(data):
                continue
            if flat(layer.first):
                first, last = (np.broadcast_to(x[:1], len(data)) for x in (layer.first, layer.last))
            else:
                byte = np.arange(len(data))
                low, high = skip + byte * 4 // 3, np.minimum(skip + (byte * 4 + 7) // 3 - 1, len(run) - 1)
                if place is not None:
                    low, high = place[low], place[high]
                high[-1] = len(m[0]) - 1
                first, last = layer.first[m.start() + low], layer.last[m.start() + high]
            yield Layer.of(data, first, last, (*layer.via, "base64"))


UNWRAP = {"url": _url, "unicode": _unicode, "base64": _base64}


def _unwrapped(layer: Layer):
    for unwrap in (*UNWRAP.values(), _bytes):
        yield from unwrap(layer)


def find(text: str, hints=frozenset(HINTS)):
    """(base findings, all findings as (kind, start, end, depth, via), layers unwrapped)."""
    base = scan(text, hints)
    found = {(k, s, e): (0, "") for k, s, e in base}
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = []
    if hints & UNWRAP.keys():
        root = Layer.root(text)
        work = [iter(UNWRAP[name](root)) for name in UNWRAP.keys() & hints]
    layers = 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(layer.data[0] if layer.data else layer.text.encode("utf-8", "surrogatepass"), digest_size=16,
                               key=repr((bool(layer.data), layer.first[:1], layer.last[-1:])).encode()[:64]).digest()
        if mark in seen or not layer.text:
            continue
        seen.add(mark)
        layers += 1
        for kind, s, e in scan(layer.text):
            span = (kind, *layer.span(s, e))
            rank = (len(layer.via), ">".join(layer.via))
            found[span] = min(found.get(span, rank), rank)
        work.append(_unwrapped(layer))
    order = sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))
    return base, [(*span, *how) for span, how in order], layers


def joined(spans) -> str:
    """kind:start:end by start, then kind."""
    order = sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


def _found(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("depth", pa.int32()), ("via", pa.string())]))
    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        hits = {k: pc.match_substring_regex(text, pattern=p).to_numpy(zero_copy_only=False) for k, p in HINTS.items()}
        some = np.logical_or.reduce(list(hits.values()))
        base, found, layers = [[]] * batch.num_rows, [[]] * batch.num_rows, [0] * batch.num_rows
        for i in np.flatnonzero(some):
            base[i], found[i], layers[i] = find(text[int(i)].as_py(), frozenset(k for k, v in hits.items() if v[i]))
        count = lambda k: pa.array([sum(x[0] == k for x in b) for b in base], pa.int64())
        names = ("kind", "start", "end", "depth", "via")
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *map(count, KINDS), pa.array([joined(b) for b in base]),
             pa.array([joined([x[:3] for x in f]) for f in found]),
             pa.array([[dict(zip(names, x)) for x in f] for f in found], kind), pa.array(layers, pa.int32())],
            ["row", "n_assign", "n_access", "n_hex", "base", "spans", "findings", "layers"])


def secrets(docs: DataFrame) -> DataFrame:
    """Per input row: the row as a struct, base counts, base and all spans, findings with their layers."""
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return rows.mapInArrow(_found, f"row {rows.schema['row'].dataType.simpleString()}, n_assign long, n_access long, "
                           f"n_hex long, base string, spans string, findings {FINDINGS}, layers int")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span of their text replaced by ``mark``;
    overlapping spans become one mark, n_chars follows the new text."""
    got = secrets(docs)
    clear = F.aggregate(
        F.transform("findings", lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e"))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, f: F.when(f["e"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.when(f["s"] >= acc["at"], F.concat(
                F.substr("row.text", acc["at"] + 1, f["s"] - acc["at"]), F.lit(mark))).otherwise("")).alias("out"),
            f["e"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substr("row.text", acc["at"] + 1)))
    new = F.when(F.size("findings") > 0, clear).otherwise(F.col("row.text"))
    keep = [F.col("new").alias(c) if c == "text" else
            F.when(F.size("findings") > 0, F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return got.withColumn("new", new).select(*keep)
