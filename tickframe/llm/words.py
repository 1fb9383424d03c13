"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow column.

A chunk of texts is one byte array.  Word borders come from a byte class
table, word hashes from a polynomial prefix sum modulo 2^64, so no Python
object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII bytes that are no letter or digit.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: ASCII bytes that are no letter.
NON_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads sums over all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string()).fill_null("")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def fold_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


def separators(data: np.ndarray, ascii_class: np.ndarray) -> np.ndarray:
    """``ascii_class`` plus Latin-1 signs (U+0080-U+00BF) and general punctuation."""
    sep = ascii_class[data]
    if len(data) > 2:
        c2 = np.flatnonzero(data[:-1] == 0xC2)
        sep[c2] = sep[c2 + 1] = True
        e2 = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
        sep[e2] = sep[e2 + 1] = sep[e2 + 2] = True
    return sep


def spans(sep: np.ndarray, offsets: np.ndarray):
    """Words as maximal runs without separators inside one text: (start, end, text index)."""
    n = len(sep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    first = word.copy()
    first[1:] &= sep[:-1] | border[1:n]
    last = word.copy()
    last[:-1] &= sep[1:] | border[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span: the sum of T[byte] * base^place, mixed."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(n, _BASE), out=total[1:])
    return mix((total[end] - total[start]) * powers(n + 1, _INVERSE)[start])


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and how many each text has.

    ``counts`` holds the words per text.  A text with fewer words has its
    whole sequence as one; one without words has none.
    """
    n = len(words)
    ends = np.cumsum(counts)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    sums = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        if len(sums):
            sums += words[j:j + len(sums)] * _U(pow(_BASE, j + 1, 1 << 64))
    first = ends - counts
    total = int(per.sum())
    place = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first, per)
    out = np.zeros(total, np.uint64)
    full = np.repeat(counts >= size, per)
    out[full] = mix(sums[place[full]])
    begins = np.cumsum(per) - per
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[first[i]:ends[i]]
        whole = (w * powers(len(w) + 1, _BASE)[1:]).sum(dtype=np.uint64, keepdims=True)
        out[begins[i]] = mix(whole + _U(len(w) * 0x632BE59BD9B4E01))[0]
    return out, per
