"""Phrase collocations by mergeable Misra-Gries summaries.

Texts are split at ``.,;:!?`` and line breaks into pieces and those at spaces
and tabs into words; only A-Z are lowered.  All counts are per language.

Pass 1 deals every phrase of 1 to ``max_words`` words by its hash into
partitions.  Each chunk of texts sends one exact summary (fingerprints and
counts) per partition; a partition merges them into one Misra-Gries summary:
counters add up, and beyond the capacity the next largest count is taken off
all counters.  The capacity is ``SLACK`` times the partition's mass divided by
the threshold, so what is taken off stays below the threshold by the bound of
Misra and Gries, and no phrase that reaches the threshold is lost.  A partition
heavier than its share keeps more counters instead of losing one.

Pass 2 counts exactly: the survivors' fingerprints, one bitmap of a bounded
size, tell which phrases to count.  Each task sends their texts and counts, again
one summary per partition, and partitions add them up by text.  Other phrases that
meet a survivor's bit are counted too and leave when the exact counts are filtered.

A phrase is scored by f(phrase) / (f(first part) + f(rest)) at its worst cut;
phrases that nearly always stand in one longer phrase leave.

Null text counts as empty, null language as ``und``.  Repeated rows count as
often as they occur; ties are broken by phrase.  Other columns are ignored; an
empty table gives no row.  Long texts are cut between pieces, which no phrase
crosses, into sections; only one piece beyond ``SECTION`` bytes is held whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import lean, parts, slices, small_batches, staged
from tickframe.llm.words import _BASE, LOWER, hashes, mix, text_bytes

MIN_COUNT, MAX_WORDS, TOP, SCALE, NESTED = 30, 4, 2000, 2_000_000, 80
#: Counters per partition over mass / threshold; phrases of a partition, about.
SLACK, PART_MASS = 8, 16 << 20
#: Most partitions (as a power of two) and bits of the survivors' bitmap (64 MB).
MOST_PARTS, MOST_BITS = 16, 1 << 29
#: Bytes of text handled at once; different phrases held by a counting task; salts of a language's final ranking.
SECTION, HELD, SALTS = 4 << 20, 400_000, 16
UNKNOWN = "und"
PHRASES = ["lang", "n_words", "phrase", "f"]

_PIECE, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[*(ord(c) for c in ".,;:!?"), 10, 11, 12, 13]] = True
_SPACE[[9, 32]] = True
_U = np.uint64


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sections(batches):
    """(languages, language of each text, bytes, offsets), about ``SECTION`` bytes each."""
    for batch in batches:
        for part in slices(batch, "text", SECTION):
            langs = part.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            data, offsets = text_bytes(part.column("text"))
            data = LOWER[data]
            if len(data) <= 2 * SECTION:
                yield names, of, data, offsets
                continue
            for i in range(len(of)):  # a long text: cut it after the first piece's end beyond each section
                a = int(offsets[i])
                cuts = np.flatnonzero(_PIECE[data[a:int(offsets[i + 1])]]) + 1
                while a < offsets[i + 1]:
                    k = int(np.searchsorted(cuts, a - offsets[i] + SECTION))
                    b = int(offsets[i] + cuts[k]) if k < len(cuts) else int(offsets[i + 1])
                    yield names, of[i:i + 1], data[a:b], np.array([0, b - a])
                    a = b


class Words:
    """Word spans of a section, and which neighbours share a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, of: np.ndarray):
        piece = _PIECE[data]
        word = ~(piece | _SPACE[data])
        n = len(data)
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1] | border[1:n]
            last[:-1] &= ~word[1:] | border[1:n]
        self.data, self.start, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.piece = np.cumsum(piece | border[:n])[self.start]
        self.lang = of[np.searchsorted(offsets, self.start, side="right") - 1]

    def phrases(self, n: int) -> np.ndarray:
        """The first word of every phrase of ``n`` words."""
        m = max(len(self.start) - n + 1, 0)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1:n - 1 + m])

    def hashed(self, names: list[str], max_words: int):
        """(n, first words, 64-bit hashes) for 1 to ``max_words`` words."""
        word = hashes(self.data, self.start, self.end)
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], _U)[self.lang]
        total = salt.copy()
        for n in range(1, max_words + 1):
            at = self.phrases(n)
            total = total[:len(word) - n + 1] if len(word) >= n else total[:0]
            if len(total):
                total = total + word[n - 1:] * _U(pow(_BASE, n, 1 << 64))
            yield n, at, mix(total[at] + _U(n))


def _sizes(max_words):
    def run(batches):
        out = {}
        for names, of, data, offsets in sections(batches):
            w = Words(data, offsets, of)
            for n in range(1, max_words + 1):
                for name, count in zip(names, np.bincount(w.lang[w.phrases(n)], minlength=len(names)).tolist()):
                    got = out.setdefault(name, [0, 0])
                    got[0] += count * (n == 1)
                    got[1] += count
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(out), pa.string()), "words": pa.array([v[0] for v in out.values()], pa.int64()),
                                          "mass": pa.array([v[1] for v in out.values()], pa.int64())})
    return run


def summarise(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, counts)."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.diff(np.append(edge, len(keys)))


def _summaries(bits, max_words):
    def run(batches):
        for names, of, data, offsets in sections(batches):
            keys = np.concatenate([h for _, _, h in Words(data, offsets, of).hashed(names, max_words)])
            keys, counts = summarise(keys >> _U(32 - bits))  # partition and 32 bits within it
            cuts = np.searchsorted(keys, np.arange((1 << bits) + 1).astype(_U) << _U(32))
            prints, counts = keys.astype(np.uint32), np.minimum(counts, (1 << 31) - 1).astype(np.uint32)
            rows = ([], [])
            for p in np.flatnonzero(np.diff(cuts)):
                span = slice(cuts[p], cuts[p + 1])
                once = counts[span] == 1
                rows[0].append(int(p))
                rows[1].append(b"".join([np.uint32(once.sum()).tobytes(), prints[span][once].tobytes(), prints[span][~once].tobytes(),
                                         counts[span][~once].tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], ["part", "summary"])
    return run


class MisraGries:
    """A summary of at most ``capacity`` counters: each counter is at most
    ``taken`` below its key's count.  Never takes off ``threshold`` or more; it
    rather keeps more counters, which can only happen where the mass exceeds
    capacity * threshold.  Counts are held at 2^31."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = max(capacity, 1), threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys.astype(_U) << _U(32)) | counts.astype(_U))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        rows = np.concatenate([(self.keys.astype(_U) << _U(32)) | self.counts.astype(_U), *self.waiting])
        self.waiting, self.size = [], 0
        rows.sort()
        keys = (rows >> _U(32)).astype(np.uint32)
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat((rows & _U(0xFFFFFFFF)).astype(np.int64), edge) if len(edge) else np.zeros(0, np.int64)
        keys = keys[edge]
        while len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            if self.taken + off >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += off
            keep = counts > off
            keys, counts = keys[keep], counts[keep] - off
        self.keys, self.counts = keys, np.minimum(counts, (1 << 31) - 1)

    def survivors(self) -> np.ndarray:
        """Every key whose count can have reached the threshold."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def _survivors(capacity, threshold, width):
    """One bitmap of 2^width bits per partition."""
    def run(batches):
        held: dict[int, MisraGries] = {}
        for batch in batches:
            for p, summary in zip(batch.column("part").to_pylist(), batch.column("summary")):
                v = np.frombuffer(summary.as_buffer(), np.uint32)
                once, more = v[1:1 + v[0]], v[1 + v[0]:].reshape(2, -1)
                mg = held.setdefault(p, MisraGries(capacity, threshold))
                mg.add(once, np.ones(len(once), np.uint32))
                mg.add(*more)
        for p in list(held):
            mask = np.zeros(1 << width, bool)
            mask[held.pop(p).survivors() >> np.uint32(32 - width)] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(mask, bitorder="little").tobytes()])], ["part", "bits"])
    return run


def _counted(shared, bits, width, max_words):
    def run(batches):
        bitmap = shared.value
        keys, slots = np.zeros(0, _U), np.zeros(0, np.int64)
        counts, rows = np.zeros(0, np.int64), []

        def flush():  # one summary per partition: its phrases with their counts
            if not rows:
                return
            lang, n, phrase = zip(*(rows[i] for i in slots.tolist()))
            found = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.string()),
                                                pa.array(counts[slots], pa.int64())], PHRASES)
            cuts = np.append(np.searchsorted(keys, np.arange(1 << bits).astype(_U) << _U(64 - bits)), len(keys))
            for p in np.flatnonzero(np.diff(cuts)):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, found.schema) as stream:
                    stream.write_batch(found.slice(cuts[p], cuts[p + 1] - cuts[p]))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["part", "summary"])

        for names, of, data, offsets in sections(batches):
            words = Words(data, offsets, of)
            raw, start, end = data.tobytes(), words.start, words.end
            for n, at, h in words.hashed(names, max_words):
                place = h >> _U(64 - bits - width)
                hit = np.flatnonzero(bitmap[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1)
                order = hit[np.argsort(h[hit], kind="stable")]
                sorted_h = h[order]
                edge = np.flatnonzero(np.append(True, sorted_h[1:] != sorted_h[:-1])) if len(order) else np.zeros(0, np.int64)
                found, first = sorted_h[edge], at[order[edge]]
                count = np.diff(np.append(edge, len(order)))
                where = np.searchsorted(keys, found)
                known = np.zeros(len(found), bool)
                inside = where < len(keys)
                known[inside] = keys[where[inside]] == found[inside]
                counts[slots[where[known]]] += count[known]
                new = np.flatnonzero(~known)
                for i, lang in zip(first[new].tolist(), words.lang[first[new]].tolist()):
                    rows.append((names[lang], n, b" ".join([raw[start[j]:end[j]] for j in range(i, i + n)]).decode()))
                slots = np.insert(slots, where[new], np.arange(len(counts), len(counts) + len(new)))
                keys = np.insert(keys, where[new], found[new])
                counts = np.concatenate([counts, count[new]])
            if len(rows) > HELD:
                yield from flush()
                keys, slots = np.zeros(0, _U), np.zeros(0, np.int64)
                counts, rows = np.zeros(0, np.int64), []
        yield from flush()
    return run


def _merged(min_count):
    """Exact counts of a partition's phrases by their text, from all tasks' summaries."""
    def added(tables):
        got = pa.concat_tables(tables).group_by(PHRASES[:3]).aggregate([("f", "sum")])
        return got.select([*PHRASES[:3], "f_sum"]).rename_columns(PHRASES)

    def run(batches):
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for p, summary in zip(batch.column("part").to_pylist(), batch.column("summary")):
                tables = held.setdefault(p, [])
                tables.append(pa.ipc.open_stream(summary.as_buffer()).read_all())
                if sum(t.num_rows for t in tables[1:]) > max(HELD, tables[0].num_rows):
                    held[p] = [added(tables)]
        for p in list(held):
            exact = added(held.pop(p))
            yield from exact.filter(pc.greater_equal(exact.column("f"), min_count)).combine_chunks().to_batches(max_chunksize=1 << 15)
    return run


def frequent_phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, n_words, phrase, f) of all phrases of up to ``max_words`` words
    with f >= min_count, stored; (lang, n): all words of each language)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs)
    sizes = staged(rows.mapInArrow(lean(_sizes(max_words)), "lang string, words long, mass long"), "phrase-sizes")
    mass = sizes.agg(F.sum("mass")).first()[0] or 1
    bits = min(MOST_PARTS, max(6, math.ceil(math.log2(mass / PART_MASS + 1))))
    total_bits = min(MOST_BITS, 1 << math.ceil(math.log2(4 * mass / min_count + 64)))
    width = max(3, int(math.log2(total_bits)) - bits)
    capacity = math.ceil(SLACK * mass / (1 << bits) / min_count) + 1
    found = (rows.mapInArrow(lean(_summaries(bits, max_words)), "part int, summary binary")
             .repartition(parts(spark), "part")
             .mapInArrow(lean(_survivors(capacity, min_count, width)), "part int, bits binary"))
    bitmap = np.zeros((1 << bits, 1 << (width - 3)), np.uint8)
    for r in staged(found, "phrase-bits").toLocalIterator():  # 64 MB in all at most, whatever the corpus
        bitmap[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.ravel())
    exact = (rows.mapInArrow(lean(_counted(shared, bits, width, max_words)), "part int, summary binary")
             .repartition(parts(spark), "part")
             .mapInArrow(lean(_merged(min_count)), "lang string, n_words int, phrase string, f long"))
    return staged(exact, "phrases"), sizes.groupBy("lang").agg(F.sum("words").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """Each candidate (two words or more) with its worst cut: a, l, r, score."""
    parts_of = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    words = F.split("phrase", " ")
    cuts = (phrases.filter("n_words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
            .select("lang", "phrase", "n_words", F.col("f").alias("a"), "k",
                    F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("right")))
    cuts = (cuts.join(parts_of.select("lang", F.col("part").alias("left"), F.col("part_f").alias("l")), ["lang", "left"])
            .join(parts_of.select("lang", F.col("part").alias("right"), F.col("part_f").alias("r")), ["lang", "right"]))
    score = F.expr(f"(cast(a AS decimal(19,0)) * cast({SCALE} AS decimal(10,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    return (cuts.withColumn("score", score).groupBy("lang", "phrase", "n_words", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score"))


def not_nested(candidates: DataFrame, phrases: DataFrame, share: int = NESTED) -> DataFrame:
    """The candidates without those that a longer candidate holds in ``share`` percent of their places or more."""
    words = F.split("phrase", " ")
    longer = (phrases.filter("n_words > 2")
              .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
              .select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    exact = lambda c, m: F.col(c).cast("decimal(19,0)") * F.lit(m).cast("decimal(10,0)")
    return (candidates.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (exact("longer", 100) < exact("a", share))).drop("longer"))


def collocations(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``max_words`` words."""
    phrases, totals = frequent_phrases(docs, min_count=min_count, max_words=max_words)
    kept = not_nested(scored(phrases), phrases)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rank = F.row_number()
    if top is not None:  # the best of each salt first: a language's candidates never meet in one task
        kept = (kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
                .withColumn("_r", rank.over(Window.partitionBy("lang", "_salt").orderBy(*best))).filter(F.col("_r") <= top))
    ranked = kept.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
