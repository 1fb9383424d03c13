"""Helpers shared by the llm operators: shared folder, staged tables, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one of our own
    only where that is unset (local tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = tempfile.mkdtemp(prefix="tickframe-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the
    lineage, and survives lost executors.  ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickframe-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str):
    """``df`` with one row per ``key``, written as a table in buckets of ``key``
    in the shared folder: joins on the key move the other side only.  The table's
    name is given up when the block ends, so results must be staged before."""
    spark = df.sparkSession
    n, label = parts(spark), f"tickframe_{name}_{uuid.uuid4().hex}"
    (df.repartition(n, key).dropDuplicates([key]).write.bucketBy(n, key)
     .option("path", f"{shared_dir(spark)}/{label}").saveAsTable(label))
    try:
        yield spark.table(label)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {label}")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches to ``rows`` rows, so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task,
    and what it keeps counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A ``mapInArrow`` function that gives its memory back when it ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def lean_group(run):
    """An ``applyInArrow`` function that gives its memory back after each group."""
    def wrapped(table):
        try:
            return run(table)
        finally:
            give_back()
    return wrapped


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null text as empty; other columns are not read."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """Sub-batches of about ``max_bytes`` of text (one row at least)."""
    lens = batch.column(column).cast(pa.large_string()).fill_null("")
    lens = pc.binary_length(lens).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lens):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
