"""Toxicity: maximum-scoring segment search over token log-odds.

Fit
    Token log-odds between toxic and clean labelled documents, with a
    Dirichlet prior split by class size, in ``2**HASH_BITS`` hash buckets (a
    fixed model size, whatever the vocabulary).  Five sixths of the training
    rows give the counts, the others the calibration.
Scan
    Each text's tokens get ``log-odds - drift``; one linear pass (Ruzzo and
    Tompa) finds every maximal-scoring segment of the whole text.
Calibration
    Best segment scores of clean texts follow an extreme-value (Gumbel) law:
    lambda solves E[exp(lambda * s)] = 1, location and scale come from clean
    calibration rows.  A segment is significant when its expected number of
    chance hits is at most ``alpha``.  The standardised excess of all segments
    above the clean mode is added up and turned into a probability by a logistic curve.

The fit uses at most about ``MAX_TRAIN_ROWS`` labelled rows, chosen by a hash
of doc_id; all other statistics and all scores cover every row and the whole
text.  Null and empty texts have no token and get the curve's lowest score.
Repeated rows give repeated results; an empty table gives an empty result;
without labels of both classes every score is the share of toxic labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.common import lean, held_out, slices, small_batches

#: Bound of the labelled sample that the model is fitted on.
MAX_TRAIN_ROWS = 40_000
HASH_BITS = 18
#: Prior pseudo-tokens per bucket, split between the classes by their size.
PRIOR = 3.0
#: Log-odds taken off each token, so that chance segments stay short.
DRIFT = 1.5
ALPHA = 0.01
_STEP = 0.05
_RANGE = 400

PASSAGES = "array<struct<start:int,end:int,score:double,evalue:double>>"


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    lam: float
    location: float
    scale: float
    intercept: float
    slope: float
    alpha: float = ALPHA


def tokens(column):
    """(bucket, start byte, end byte, text index) of the lower-cased letter/digit runs."""
    data, off = words.text_bytes(column)
    low = words.fold_latin(data)
    start, end, text = words.spans(words.separators(data, words.PUNCT), off)
    bucket = (words.hashes(low, start, end) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    return data, bucket, start, end, text


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) in linear time.

    Neighbouring tokens of one sign are joined first: a maximal segment never
    splits a run of positive tokens.
    """
    pos = scores > 0
    if not pos.any():
        return []
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], pos, [False]]).astype(np.int8)))
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = float(cum[a]), float(cum[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right))
                break
            a, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - le) for a, b, le, r in found]


def _count_tokens(batches):
    n = 1 << HASH_BITS
    got = np.zeros((2, n), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            _, bucket, _, _, text = tokens(part.column("text"))
            y = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[text]
            for c in (0, 1):
                got[c] += np.bincount(bucket[y == c], minlength=n)
    keep = np.flatnonzero(got.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(got[0][keep]), pa.array(got[1][keep])],
                                     ["bucket", "clean", "toxic"])


def log_odds(clean: np.ndarray, toxic: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-odds per bucket under Dirichlet priors proportional to class size."""
    n0, n1 = float(clean.sum()), float(toxic.sum())
    if not n0 or not n1:
        return np.zeros(len(clean))
    s0, s1 = prior * n0 / (n0 + n1), prior * n1 / (n0 + n1)
    return np.log((toxic + s1) / n1) - np.log((clean + s0) / n0)


def _histogram(weights):
    """Counts of token scores of clean texts, in steps of ``_STEP``."""
    w = weights.value

    def run(batches):
        got = np.zeros(2 * _RANGE + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, bucket, _, _, _ = tokens(part.column("text"))
                bins = np.clip(np.rint((w[bucket] - DRIFT) / _STEP), -_RANGE, _RANGE).astype(np.int64) + _RANGE
                got += np.bincount(bins, minlength=len(got))
        keep = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(keep - _RANGE), pa.array(got[keep])], ["bin", "n"])
    return run


def solve_lambda(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda * s)] = 1 (1.0 where there is none)."""
    if not len(score) or (score * share).sum() >= 0 or score.max() <= 0:
        return 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * score, 500))).sum()) - 1
    high = 1.0
    while value(high) < 0:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _evidence(parts_of, model):
    """Per text: normalised best score, evidence, and the significant segments in bytes."""
    data, bucket, start, end, text = tokens(parts_of)
    score = model.weights[bucket] - DRIFT
    rows = len(parts_of)
    ends = np.searchsorted(text, np.arange(rows), side="right")
    begins = np.searchsorted(text, np.arange(rows), side="left")
    best, total, passages = np.full(rows, np.nan), np.zeros(rows), [()] * rows
    active = np.zeros(rows, bool)
    active[text[score > 0]] = True
    best[begins < ends] = -np.log(ends - begins)[begins < ends]
    for i in np.flatnonzero(active):
        a, n = int(begins[i]), int(ends[i] - begins[i])
        found = segments(score[a:a + n])
        norm = [model.lam * s - math.log(n) for _, _, s in found]
        best[i] = max(norm)
        kept = []
        for (f, e, s), y in zip(found, norm):
            z = (y - model.location) / model.scale
            evalue = math.exp(min(-z, 700.0))
            total[i] += max(z, 0.0)
            if evalue <= model.alpha:
                kept.append((int(start[a + f]), int(end[a + e - 1]), s, evalue))
        passages[i] = kept
    return data, best, total, passages


def _calibrate(shared):
    def run(batches):
        model = ToxicityModel(**shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                _, best, total, _ = _evidence(part.column("text"), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic").cast(pa.int32()), pa.array(best, from_pandas=True),
                     pa.array(np.rint(np.log1p(total) / _STEP).astype(np.int32))], ["toxic", "best", "bin"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted two-parameter logistic fit with a slight ridge (Newton)."""
    b = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (n * (y - p)) - 0.01 * b
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(text, toxic, calibrate): labelled rows outside the held-out fold.

    The label table is cut to about ``max_rows`` ids by a hash before it is
    broadcast, so neither the broadcast nor the fit grows with the corpus.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < (1 << 20) * max_rows // n)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(known), "doc_id")
            .select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(6)) == 0).alias("calibrate")))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Learn the model from rows outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = training_rows(docs, labels, max_rows)
    train, calib = rows.filter(~F.col("calibrate")).drop("calibrate"), rows.filter("calibrate").drop("calibrate")
    counts = (train.mapInArrow(lean(_count_tokens), "bucket long, clean long, toxic long")
              .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas())
    clean, toxic = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    clean[counts.bucket], toxic[counts.bucket] = counts.clean, counts.toxic
    weights = log_odds(clean, toxic).astype(np.float32)
    hist = (calib.filter("toxic = 0").mapInArrow(lean(_histogram(spark.sparkContext.broadcast(weights))), "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).toPandas())
    lam = solve_lambda(hist.bin.to_numpy() * _STEP, hist.n.to_numpy() / max(hist.n.sum(), 1))
    draft = ToxicityModel(weights, lam, 0.0, 1.0, 0.0, 1.0)
    cells = calib.mapInArrow(lean(_calibrate(spark.sparkContext.broadcast(vars(draft)))), "toxic int, best double, bin int")
    m = cells.filter("toxic = 0").agg(F.avg("best").alias("m"), F.stddev_samp("best").alias("s")).first()
    scale = max((m["s"] or 1.0) * math.sqrt(6) / math.pi, 1e-3)
    location = (m["m"] or 0.0) - np.euler_gamma * scale
    draft = ToxicityModel(weights, lam, float(location), float(scale), 0.0, 1.0)
    bins = (calib.mapInArrow(lean(_calibrate(spark.sparkContext.broadcast(vars(draft)))), "toxic int, best double, bin int")
            .groupBy("bin").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).toPandas())
    y, n = bins.y.to_numpy(float), bins.n.to_numpy(float)
    if not 0 < y.sum() < n.sum():
        share = float((toxic.sum() > 0) and (y.sum() / max(n.sum(), 1)))
        a, b = math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0
    else:
        a, b = _logistic(bins.bin.to_numpy() * _STEP, y / n, n)
    return ToxicityModel(weights, lam, float(location), float(scale), a, b)


def _score(shared):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                               ("evalue", pa.float64())]))

    def run(batches):
        model = ToxicityModel(**shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                data, _, total, passages = _evidence(part.column("text"), model)
                z = model.intercept + model.slope * np.log1p(total)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                _, off = words.text_bytes(part.column("text"))
                found = [[{"start": int(points[s] - points[off[i]]), "end": int(points[e] - points[off[i]]),
                           "score": float(v), "evalue": float(p)} for s, e, v, p in rows]
                         for i, rows in enumerate(passages)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(1 / (1 + np.exp(-z))), pa.array(found, kind)],
                    ["row", "score", "passages"])
    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(row, score, passages): each input row as a struct, its score from 0 to
    1, and its significant passages (code points, end exclusive)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, passages {PASSAGES}"
    return rows.mapInArrow(lean(_score(spark.sparkContext.broadcast(vars(model)))), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """Documents whose score stays under ``threshold``, with their columns."""
    return score(docs, fit(docs, labels)).filter(F.col("score") < threshold).select("row.*")
