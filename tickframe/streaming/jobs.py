"""Structured Streaming jobs.

Each ``stream_*`` function maps a streaming DataFrame to a streaming
DataFrame.  ``run_to_table`` drives one through all available input and
returns the written table as a batch DataFrame (nothing is collected on the
driver).  Windowed aggregates run in update mode: every micro-batch writes
the windows that it changed under its own epoch folder (a repeated epoch
overwrites itself), and ``latest`` keeps each window's last version, so
windows that are still open at the end of the input are complete too.

A backlog of files need not be in time order: ``replay`` admits its files by
their first event time, a bounded number per trigger.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tickframe.functions import text as tx
from tickframe.session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

EPOCH = "epoch"
#: Files of a backlog that one trigger may read.
FILES_PER_TRIGGER = 64


def _ticks(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


def file_spans(spark: SparkSession, path: str, time: str) -> DataFrame:
    """First and last event time (seconds) of each file of a Parquet table.  One
    column is read, since files need not hold statistics; a file without any
    event time has nulls, one without rows is left out."""
    at = F.col(time).cast("timestamp").cast("double")
    return (spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.min(at).alias("first"), F.max(at).alias("last")))


def overlap(spans: DataFrame) -> DataFrame:
    """How far (seconds, one row) a file reaches back behind the last event of the
    files before it, when files are taken by their first event time."""
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    back = F.max("last").over(before) - F.col("first")
    return spans.select(back.alias("back")).agg(F.greatest(F.lit(0.0), F.ceil(F.max("back"))).cast("long").alias("seconds"))


def _pattern(base: str, files: list[str]) -> str:
    """A path pattern that matches exactly ``files`` under the folder ``base``."""
    names = [re.sub(r"([\\\[\]{}*?,^])", r"\\\1", os.path.relpath(f, base)) for f in files]
    return f"{base}/{{{','.join(names)}}}"


def replay(spark: SparkSession, path: str, job: Callable[[DataFrame, str], DataFrame], name: str, *, time: str,
           delay: str = "10 minutes", files: int = FILES_PER_TRIGGER, out: str | None = None) -> DataFrame:
    """All versions of the rows of ``job(raw stream, watermark delay)`` over the
    Parquet files at ``path``, ``files`` of them per trigger, oldest first.

    The watermark lags by ``delay`` and by what the files overlap in time, so no
    row of the backlog comes too late however the files are cut; state holds
    that much event time.  Each group of files is a run of one query with one
    checkpoint.  ``out`` names a folder to go on with; files that it has
    read are not read again.  The driver holds the files' names and times, as
    the file source does; an empty table gives no rows."""
    schema = spark.read.parquet(path).schema
    spans = file_spans(spark, path, time).persist()
    try:
        lag = overlap(spans).first().seconds or 0
        order = [r.file for r in spans.orderBy(F.col("first").asc_nulls_first(), "file").select("file").toLocalIterator()]
    finally:
        spans.unpersist()
    order = [(u.scheme, unquote(u.path) if not u.netloc else f"//{u.netloc}{unquote(u.path)}") for u in map(urlsplit, order)]
    out = out or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    base = os.path.commonpath([os.path.dirname(p) for _, p in order]) if order else ""
    rows = None
    for k in range(0, len(order), files):
        pattern = _pattern(base, [p for _, p in order[k:k + files]])
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{order[0][0]}:{pattern}")
        rows = job(raw, f"{delay} {lag} seconds")
        drive(rows, name, mode="update", out=out)
    if rows is None:
        return _versions(job(spark.createDataFrame([], schema), delay))
    return spark.read.schema(_versions(rows).schema).parquet(f"{out}/data")


def _versions(rows: DataFrame) -> DataFrame:
    return rows.withColumn(EPOCH, F.lit(0).cast("long"))


def replay_ticks(spark: SparkSession, sf_dir: str, job: Callable[..., DataFrame], name: str, **options: Any) -> DataFrame:
    """``replay`` of a tick job over the events table."""
    return replay(spark, f"{sf_dir}/events.parquet", lambda raw, delay: job(_ticks(raw), delay=delay), name, time="ts", **options)


def stream_bars(ticks: DataFrame, *, interval: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """ST1: ticks -> OHLCV tumbling bars; ticks later than the watermark are
    dropped; equal times are ordered by event_id."""
    t = ticks.withWatermark("ts", delay)
    at = F.struct("ts", "event_id")
    return (t.groupBy("symbol", F.window("ts", interval).alias("w"))
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
                 F.count(F.lit(1)).alias("ticks"))
            .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks"))


def stream_sliding_mean(ticks: DataFrame, *, length: str = "1 hour", slide: str = "15 minutes",
                        delay: str = "10 minutes") -> DataFrame:
    """ST2: sliding-window mean price and total volume per symbol."""
    t = ticks.withWatermark("ts", delay)
    return (t.groupBy("symbol", F.window("ts", length, slide).alias("w"))
            .agg(F.avg("price").alias("mean_price"), F.sum("volume").alias("volume"))
            .select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "mean_price", "volume"))


#: The state of a symbol: its two latest ticks.
_TWO_TICKS = "last_us long, last_id long, price double, previous_us long, previous_id long, previous_price double"


def _two_latest(batches: Iterator) -> Iterator:
    """Of each Arrow batch only the two latest ticks of a symbol."""
    for pdf in batches:
        yield pdf.sort_values(["us", "event_id"]).groupby("symbol", sort=False, dropna=False).tail(2)


def _advance(key: tuple, batches: Iterator, state: Any) -> Iterator:
    """The two latest ticks of one symbol: those in its state and the new ones."""
    import pandas

    ticks = []
    if state.exists:
        kept = state.get
        ticks = [kept[k:k + 3] for k in (0, 3) if kept[k] is not None]
    for pdf in batches:
        price = [None if pandas.isna(p) else float(p) for p in pdf["price"]]
        ticks += zip(map(int, pdf["us"]), map(int, pdf["event_id"]), price)
        ticks = sorted(ticks, key=lambda t: t[:2], reverse=True)[:2]
    last, previous = ticks[0], ticks[1] if len(ticks) > 1 else (None, None, None)
    state.update((*last, *previous))
    row = pandas.DataFrame([(*key, last[0], last[2], previous[2])], columns=["symbol", "last_us", "price", "previous_price"])
    yield row.astype({"price": "float64", "previous_price": "float64"})


def stream_snapshot(ticks: DataFrame, *, delay: str | None = None) -> DataFrame:
    """ST3: last price and % change vs the previous tick per symbol.

    The state of a symbol is its two latest ticks by (ts, event_id), in whatever
    order and trigger they arrive.  Each Arrow batch is cut to two ticks per
    symbol before the shuffle, so a hot symbol sends a few rows per task.  Ticks
    without a time are left out; equal ticks count as often as they come.  No
    tick is too late for it, so ``delay`` changes nothing."""
    kind = ticks.schema["symbol"].dataType.simpleString()
    rows = ticks.filter("ts IS NOT NULL").select("symbol", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"),
                                                 F.col("price").cast("double").alias("price"))
    got = (rows.mapInPandas(_two_latest, rows.schema).groupBy("symbol")
           .applyInPandasWithState(_advance, f"symbol {kind}, last_us long, price double, previous_price double", _TWO_TICKS, "update",
                                   GroupStateTimeout.NoTimeout))
    change = F.try_divide(F.col("price") - F.col("previous_price"), F.col("previous_price")) * 100.0
    return got.select("symbol", F.timestamp_micros("last_us").alias("last_ts"), "price", "previous_price", change.alias("change_percent"))


def news_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents parquet as a news stream with event time p_date."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # the stream source takes a single file only from a pattern
    d = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return d.select(F.col("doc_id").alias("guid"), F.expr("CAST(substr(source, 4) AS INT) % 10").alias("symbol"),
                    F.expr("substr(text, 1, 80)").alias("title"), F.expr("substr(text, 81)").alias("summary"),
                    F.expr("CAST(date_add(DATE'1995-01-02', CAST(doc_id % 2500 AS INT)) AS TIMESTAMP)").alias("p_date"))


def stream_deduplicated(news: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """ST4, first job: each guid once within the watermark (append mode)."""
    return news.withWatermark("p_date", delay).dropDuplicatesWithinWatermark(["guid"])


def stream_news_sentiment(news: DataFrame, *, length: str = "7 days", delay: str = "1 day",
                          positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """ST4, second job: articles scored (X2 on title + summary) and averaged
    per symbol and tumbling window."""
    d = news.withWatermark("p_date", delay).withColumn("_h", tx.headline_text(F.col("title"), F.col("summary")))
    d = tx.add_polarity(d, "_h", "score", positive, negative)
    return (d.groupBy("symbol", F.window("p_date", length).alias("w"))
            .agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("articles"))
            .select("symbol", F.col("w.start").alias("window_start"), "score", "articles"))


def drive(stream: DataFrame, name: str, *, mode: str, out: str | None = None) -> str:
    """Run ``stream`` until all available input is processed; the folder of the
    written table.  With ``out`` of an earlier run it goes on from its checkpoint."""
    out = out or f"{checkpoint_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    w = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{out}/data").start().awaitTermination()
    else:
        w.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/data/{EPOCH}={epoch}")).start().awaitTermination()
    return f"{out}/data"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """All versions of the rows of an update-mode ``stream``, with their ``epoch``."""
    schema = T.StructType([*stream.schema.fields, T.StructField(EPOCH, T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(drive(stream, name, mode="update"))


def latest(versions: DataFrame, *keys: str) -> DataFrame:
    """The last version of each row of an update-mode table."""
    rest = [c for c in versions.columns if c not in (*keys, EPOCH)]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), EPOCH).alias("_v")).select(*keys, "_v.*")
