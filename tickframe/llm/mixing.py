"""Temperature mixing of sources to target weights.

Source token shares p are raised to an exponent and normalised: weights
w = p^a / sum(p^a).  The exponent is bisected until the weights meet a target
entropy (a share of the largest possible, from below 1) or a limit on how
often a source may be repeated.  All sums over sources are Spark aggregations
on the table of sources; only a few numbers reach the driver.

Weights become rows by budgeted block permutations: a source's documents are
dealt into blocks by hash, each pass goes through the blocks, and through the
documents of a block, in a new pseudo-random order, and the source gives
documents until its token budget is spent.  A document that would pass the
budget is left out and the source goes on with the next ones that fit.
``progress`` is the place of a document in its source's budget: sorted by it,
every stretch of the result has the target weights.  ``realised`` is the share
of the given tokens that the source got, beside its ``weight``.

A null source counts as source ''.  Null and empty texts have no tokens; a
source without tokens has no weight and its documents are left out of a
budgeted mix.  Repeated rows are separate documents; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import words
from tickframe.llm.common import lean, lean_group, slices, small_batches, staged

MAX_REPEATS = 2.0
#: Tokens of a block, and the largest number of blocks of a source.
BLOCK_TOKENS, MAX_BLOCKS = 1 << 20, 4096
#: Exponents tried in one aggregation; rounds of refinement.
GRID, ROUNDS = 17, 8
SEED = 17


def _counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = words.text_bytes(part.column("text"))
            _, _, text = words.spans(words.SPACE[data], off)
            n = np.bincount(text, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source")), pa.array(n)],
                                             ["doc_id", "source", "tokens"])


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): white-space separated words of every whole text."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
            .mapInArrow(lean(_counts), "doc_id long, source string, tokens long"))


def _refine(shares: DataFrame, accept) -> float:
    """The smallest exponent in [0, 1] that ``accept`` takes, by repeated grids.

    ``accept(a, z, zl, most)`` gets sum(p^a), sum(p^a ln p) and max(p^(a-1)).
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        cols = []
        for k, a in enumerate(grid):
            power = F.pow("p", F.lit(a))
            cols += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("p")).alias(f"l{k}"),
                     F.max(F.pow("p", F.lit(a - 1))).alias(f"m{k}"), F.min(F.pow("p", F.lit(a - 1))).alias(f"s{k}")]
        got = shares.agg(*cols).first()
        fits = [k for k in range(GRID) if got["z0"] and accept(grid[k], got[f"z{k}"], got[f"l{k}"], got[f"m{k}"], got[f"s{k}"])]
        if not fits:
            return 1.0
        if fits[0] == 0:
            return grid[0]
        low, high = grid[fits[0] - 1], grid[fits[0]]
    return high


def weights(counts: DataFrame, *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
            cover: bool = False) -> DataFrame:
    """(source, source_tokens, share, exponent, weight, repeats) per source.

    The flattest weights (smallest exponent) within the limits.  ``repeats``
    is how often a source's tokens are given: the budget is all tokens, or
    with ``cover`` the least budget that gives every document once or more.
    ``entropy`` (0 to 1) asks for the flattest weights whose entropy is at
    most that share of ln(number of sources).
    """
    sources = staged(counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).filter("source_tokens > 0"), "sources")
    total, n = sources.agg(F.sum("source_tokens"), F.count(F.lit(1))).first()
    shares = sources.withColumn("share", F.col("source_tokens") / F.lit(float(total or 1)))
    p = shares.select(F.col("share").alias("p"))
    repeats = lambda z, most, least: most / least if cover else most / z
    exponent = _refine(p, lambda a, z, zl, most, least: (max_repeats is None or repeats(z, most, least) <= max_repeats * (1 + 1e-12)) and (
        entropy is None or math.log(z) - a * zl / z <= entropy * math.log(max(n, 2)) + 1e-12))
    z, least = p.agg(F.sum(F.pow("p", F.lit(exponent))), F.min(F.pow("p", F.lit(exponent - 1)))).first()
    scale = least if cover else z
    return shares.select("source", "source_tokens", "share", F.lit(exponent).alias("exponent"),
                         (F.pow("share", F.lit(exponent)) / F.lit(z or 1.0)).alias("weight"),
                         (F.pow("share", F.lit(exponent - 1)) / F.lit(scale or 1.0)).alias("repeats"))


GIVEN = "doc_id long, source string, tokens long, weight double, exponent double, epoch int, block long, progress double"


def _greedy(table: pa.Table) -> pa.Table:
    """The documents of one block, in order, that still fit into what is left of the budget."""
    table = table.sort_by([("end", "ascending"), ("doc_id", "ascending")])
    budget, left = table.column("budget")[0].as_py(), table.column("left")[0].as_py()
    take, progress = [], []
    for i, n in enumerate(table.column("tokens").to_pylist()):
        if n <= left:
            take.append(i)
            progress.append((budget - left) / budget)
            left -= n
    got = table.take(pa.array(take, pa.int64()))
    return got.select(GIVEN.replace(",", "").split()[:-2:2]).append_column("progress", pa.array(progress, pa.float64()))


def _filled(rest: DataFrame, left: DataFrame) -> list:
    """Parts of ``rest``, the documents behind the first that passes its source's
    budget, that fit into what is ``left`` (source, left, done) of it.

    A round takes from each source the next block that has a document that fits;
    what is left soon is less than any document.
    """
    out = []
    while True:
        fits = rest.join(left, "source").filter((F.col("tokens") <= F.col("left")) & (F.col("end") > F.col("done")))
        nearest = staged(fits.groupBy("source").agg(F.min_by("block", "end").alias("block")), "nearest")
        if nearest.isEmpty():
            return out
        block = staged(fits.join(nearest, ["source", "block"]), "block")
        got = staged(block.groupBy("source").applyInArrow(lean_group(_greedy), GIVEN), "filled")
        out.append(got)
        spent = got.groupBy("source").agg(F.sum("tokens").alias("spent"))
        left = staged(block.groupBy("source", "left").agg(F.max("end").alias("done")).join(spent, "source")
                      .select("source", (F.col("left") - F.col("spent")).alias("left"), "done"), "left")


def realise(counts: DataFrame, weighted: DataFrame, *, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, weight, exponent, epoch, block, progress, realised):
    one row for each time a document is given."""
    mark = lambda *c: F.xxhash64(F.lit(seed), *c)
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_tokens") / BLOCK_TOKENS))).cast("long")
    budget = F.round(F.col("repeats") * F.col("source_tokens")).cast("long")
    docs = (counts.join(weighted, "source").withColumn("budget", budget)
            .withColumn("block", F.pmod(mark("source", "doc_id"), blocks)))
    passes = F.ceil(F.col("budget") / F.col("source_tokens")).cast("int")
    docs = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0)))))
    order = Window.partitionBy("source", "epoch").orderBy(mark("epoch", "block"), "block")
    cells = (docs.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("block_tokens"))
             .withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                         - F.col("block_tokens")).drop("block_tokens"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(mark("epoch", "doc_id"), "doc_id", "tokens").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.col("epoch") * F.col("source_tokens") + F.col("before") + F.sum("tokens").over(inside)
    placed = staged(docs.join(cells, ["source", "epoch", "block"]).withColumn("end", end)
                    .select("doc_id", "source", "tokens", "weight", "exponent", "epoch", "block", "budget", "end"), "placed")
    fits = (F.col("end") <= F.col("budget")) | (F.col("tokens") == 0)
    place = F.least(F.col("end") - F.col("tokens"), "budget") / F.greatest(F.col("budget"), F.lit(1))
    given = placed.filter(fits).select("doc_id", "source", "tokens", "weight", "exponent", "epoch", "block", place.alias("progress"))
    left = placed.groupBy("source", "budget").agg(F.sum(F.when(fits, F.col("tokens")).otherwise(0)).alias("spent"))
    left = left.select("source", (F.col("budget") - F.col("spent")).alias("left"), F.lit(0).cast("long").alias("done"))
    for part in _filled(placed.filter(~fits), staged(left.filter("left > 0"), "left")):
        given = given.unionByName(part)
    shares = staged(given.groupBy("source").agg(F.sum("tokens").alias("n")), "given")
    every = shares.agg(F.greatest(F.sum("n"), F.lit(1)).alias("every"))
    shares = shares.crossJoin(every).select("source", (F.col("n") / F.col("every")).alias("realised"))
    return given.join(shares, "source").select(*given.columns, "realised")


def mix(docs: DataFrame, *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
        cover: bool = False, seed: int = SEED) -> DataFrame:
    """The mix of (doc_id, source, text) rows."""
    counts = staged(token_counts(docs), "tokens")
    return realise(counts, weights(counts, max_repeats=max_repeats, entropy=entropy, cover=cover), seed=seed)


def repeated(docs: DataFrame, *, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents' rows, each as often as the covering mix gives it: every
    document once, those of small sources up to ``max_repeats`` times."""
    times = (mix(docs, max_repeats=max_repeats, cover=True, seed=seed).filter("epoch > 0")
             .groupBy("doc_id").agg(F.max("epoch").alias("_more")))
    got = docs.join(times, "doc_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)))))
    return got.select(*docs.columns)
