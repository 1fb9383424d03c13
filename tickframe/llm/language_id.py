"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language has a
probability for every piece; the likelihood of a word is the sum over all its
segmentations into pieces, computed by a forward algorithm, and the likelihood
of a text is the product over its words (runs of letters, lower-cased, with a
leading space as in the vocabulary).  Piece probabilities are fitted by
expectation maximisation: each round counts the expected use of pieces over
all segmentations of the training words (forward-backward) in Spark tasks.

The fit uses about ``MAX_TRAIN_DOCS`` documents per language, chosen by a hash
of doc_id; every text is scored whole.  Runs of more than ``MAX_WORD`` bytes
are scored as consecutive runs of that length.  A text that is null or has no
letter is ``und`` with score 0, as is every text if no language was learned.
Ties go to the smaller language name; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.common import held_out, slices, small_batches, staged

VOCABULARY = "byte_bpe_50k.json"
MAX_TRAIN_DOCS = 2_000
MAX_PIECE, MAX_WORD = 12, 64
ROUNDS = 4
#: Pseudo-count of every piece in every language.
SMOOTH = 0.01
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SLOTS = 20
_CHUNK = 4 << 20


def pieces(path: str = VOCABULARY, longest: int = MAX_PIECE) -> list[bytes]:
    """The pieces of letters, with or without a leading space, in vocabulary order."""
    if "/" not in path:
        import public_tokenizers
        path = public_tokenizers.path(path)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    found = []
    for piece in sorted(vocab, key=vocab.get):
        raw = bytes(byte[c] for c in piece if c in byte)
        rest = raw.removeprefix(b" ")
        if len(raw) == 1 or len(raw) <= longest and all(b >= 128 or 97 <= b <= 122 for b in rest):
            found.append(raw)
    return list(dict.fromkeys(found))


class Pieces:
    """Hash table of pieces for whole columns of byte strings."""

    def __init__(self, found: list[bytes]):
        self.n = len(found)
        self.longest = max(map(len, found))
        h = np.array([self._hash(p) for p in found], np.uint64)
        self.keys = np.zeros((4, 1 << _SLOTS), np.uint64)
        self.ids = np.full((4, 1 << _SLOTS), self.n, np.int32)
        slot = (words.mix(h) >> _U(64 - _SLOTS)).astype(np.int64)
        self.depth = 0
        left = np.arange(self.n)
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            now = left[first]
            self.keys[self.depth, slot[now]], self.ids[self.depth, slot[now]] = h[now], now
            left = np.setdiff1d(left, now)
            self.depth += 1

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in reversed(piece):
            h = (h * int(_BASE) + b + 1) % (1 << 64)
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        slot = (words.mix(h) >> _U(64 - _SLOTS)).astype(np.int64)
        out = np.where(self.keys[0, slot] == h, self.ids[0, slot], self.n)
        for d in range(1, self.depth):
            out = np.where(self.keys[d, slot] == h, self.ids[d, slot], out)
        return out

    def ends(self, text: np.ndarray):
        """ids[l - 1][:, t - l]: the piece text[:, t - l:t] (``n`` where there is none)."""
        width = text.shape[1]
        code = text.astype(np.uint64) + _U(1)
        out, h = [], np.zeros((len(text), width + 1), np.uint64)
        for size in range(1, min(self.longest, width) + 1):
            # the hash of text[:, s:s + size], from that of text[:, s + 1:s + size]
            h = code[:, :width - size + 1] + h[:, 1:width - size + 2] * _BASE
            out.append(self.lookup(h))
        return out


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(word indices, matrix of b' ' + word) per word length."""
    size = end - start
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cut) if len(order) else []:
        n = int(size[group[0]])
        text = np.full((len(group), n + 1), 32, np.uint8)
        text[:, 1:] = data[start[group][:, None] + np.arange(n)]
        yield group, text


def runs(data: np.ndarray, offsets: np.ndarray):
    """(start, end, text index) of the letter runs, long ones in parts."""
    start, end, text = words.spans(words.separators(data, words.NON_LETTER), offsets)
    parts = -(-(end - start) // MAX_WORD)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(end, parts)
        start = np.repeat(start, parts) + nth * MAX_WORD
        end, text = np.minimum(start + MAX_WORD, stop), np.repeat(text, parts)
    return start, end, text


def forward(ids, prob: np.ndarray, rows: int, width: int):
    """Scaled forward sums: alpha[t][row, language] and the log scale that was taken off."""
    k = prob.shape[1]
    alpha = [np.ones((rows, k))]
    scale = np.zeros((rows, k))
    for t in range(1, width + 1):
        a = np.zeros((rows, k))
        for size in range(1, min(t, len(ids)) + 1):
            a += alpha[t - size] * prob[ids[size - 1][:, t - size]]
        alpha.append(a)
        if t % 16 == 0:
            m = np.maximum(a, 1e-300)
            for j in range(max(0, t - len(ids) + 1), t + 1):
                alpha[j] = alpha[j] / m
            scale += np.log(m)
    return alpha, scale


def log_likelihood(table: Pieces, prob: np.ndarray, data, start, end) -> np.ndarray:
    """log P(word | language) for every word and language."""
    out = np.zeros((len(start), prob.shape[1]))
    for group, text in by_length(data, start, end):
        for a in range(0, len(group), 8192):
            part = text[a:a + 8192]
            alpha, scale = forward(table.ends(part), prob, len(part), part.shape[1])
            out[group[a:a + 8192]] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
    return out


def expected(table: Pieces, prob: np.ndarray, data, start, end, count) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words (one language)."""
    got = np.zeros(table.n + 1)
    for group, text in by_length(data, start, end):
        for a in range(0, len(group), 8192):
            part = text[a:a + 8192]
            width, n = part.shape[1], len(part)
            ids = table.ends(part)
            p = prob[:, 0]
            f, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            f[0], b[width] = 1, 1
            for t in range(1, width + 1):
                for size in range(1, min(t, len(ids)) + 1):
                    f[t] += f[t - size] * p[ids[size - 1][:, t - size]]
            for t in range(width - 1, -1, -1):
                for size in range(1, min(width - t, len(ids)) + 1):
                    b[t] += b[t + size] * p[ids[size - 1][:, t]]
            w = count[group[a:a + 8192]] / np.maximum(f[width], 1e-300)
            for size in range(1, len(ids) + 1):
                for s in range(width - size + 1):
                    i = ids[size - 1][:, s]
                    got += np.bincount(i, f[s] * b[s + size] * p[i] * w, table.n + 1)
    return got[:-1]


def _training_words(batches):
    for batch in batches:
        for part in slices(batch, "text", _CHUNK):
            data, off = words.text_bytes(part.column("text"))
            low = words.fold_latin(data)
            start, end, text = runs(data, off)
            lang = part.column("lang").to_numpy(zero_copy_only=False)[text]
            if not len(start):
                continue
            h = words.hashes(low, start, end)
            _, at = np.unique(lang.astype(str), return_inverse=True)
            _, first, n = np.unique(words.mix(h + at.astype(np.uint64)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[first], pa.string()), pa.array([low[s:e].tobytes() for s, e in zip(start[first], end[first])], pa.binary()),
                 pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def _expected_uses(shared, vocabulary, names):
    def run(batches):
        table = Pieces(pieces(vocabulary))
        prob = shared.value
        got = np.zeros((len(names), table.n))
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist())
            count = batch.column("n").to_numpy().astype(float)
            raw = batch.column("word").to_pylist()
            data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
            for k, name in enumerate(names):
                mine = np.flatnonzero(lang == name)
                got[k] += expected(table, prob[:, k:k + 1], data, off[mine], off[mine + 1], count[mine])
        k, i = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(got[k, i])], ["lang", "piece", "uses"])
    return run


def training_rows(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(lang, text) of about ``max_docs`` rows per language outside the held-out fold."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.join(F.broadcast(share), "lang").filter(draw * F.col("docs") < max_docs).select("lang", "text")


def fit(docs: DataFrame, *, vocabulary: str = VOCABULARY, max_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS):
    """(language names, piece probabilities as an array of pieces x languages)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = staged(training_rows(docs, max_docs).mapInArrow(_training_words, "lang string, word binary, n long")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    table = Pieces(pieces(vocabulary))
    prob = np.full((table.n + 1, len(names)), 1.0 / table.n)
    prob[-1] = 0
    for _ in range(rounds if names else 0):
        uses = (rows.mapInArrow(_expected_uses(spark.sparkContext.broadcast(prob), vocabulary, names), "lang long, piece long, uses double")
                .groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas())
        got = np.full((table.n + 1, len(names)), SMOOTH)
        got[uses.piece, uses.lang] += uses.uses
        got[-1] = 0
        prob = got / got.sum(0)
    return names, prob


def _predict(shared, vocabulary):
    def run(batches):
        names, prob = shared.value
        table = Pieces(pieces(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                n = part.num_rows
                data, off = words.text_bytes(part.column("text"))
                start, end, text = runs(data, off)
                total = np.zeros((n, max(len(names), 1)))
                if len(start) and names:
                    low = words.fold_latin(data)
                    _, first, which = np.unique(words.hashes(low, start, end), return_index=True, return_inverse=True)
                    each = log_likelihood(table, prob, low, start[first], end[first])[which]
                    for k in range(len(names)):
                        total[:, k] = np.bincount(text, each[:, k], n)
                letter = pc.match_substring_regex(part.column("text").cast(pa.large_string()).fill_null(""), pattern=r"\p{L}")
                sure = letter.to_numpy(zero_copy_only=False) & bool(names)
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([names[b] if s else "und" for b, s in zip(best, sure)], pa.string()),
                     pa.array(np.where(sure, score, 0.0))], ["row", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, lang_pred, score): each input row as a struct, its language and the
    probability of that language among the learned ones."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(tuple(model)), vocabulary), schema)
