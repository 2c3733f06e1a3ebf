"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.session import ensure_checkpoint_dir


BATCH_BYTES = "4m"      # of rows that go to Python or come back at once
READ_ROWS = 512         # rows that a Parquet scan decodes at once
GROUP_BYTES = 8 << 20   # of a row group that is written, and read at once
KEPT_BYTES = 32 << 20   # of freed memory that a worker keeps for its next arrays
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
            "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches, unless it does so itself.  Spark's defaults are 64 MB
    of Arrow in each task, several times that as Python texts, and 4096 rows of a scan,
    whose texts lie in one array that doubles until they fit."""
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def give_back() -> None:
    """Called in a Python worker after a batch: what was freed goes back to the system.
    Workers that wait for their next task would hold it beside those that run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # not glibc
        pass


def keep_freed() -> None:
    """Called in a Python worker that makes arrays of some hundred KB over and over: up to
    ``KEPT_BYTES`` of freed memory stay with the process.  Otherwise each array's pages are
    given back and faulted in anew, which takes longer than the arithmetic."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, KEPT_BYTES)        # M_TRIM_THRESHOLD
        libc.mallopt(-3, KEPT_BYTES)        # M_MMAP_THRESHOLD
    except (AttributeError, OSError):   # not glibc
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a documents table, null texts as empty strings.  All
    other columns are left behind, so no name can clash with an operator's."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_of(f"`{text_col}`").alias("text"))


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def cut(df: DataFrame, *sort: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: the lineage ends there, so a lost executor re-reads the
    table instead of recomputing it, and values that depend on the order of
    rows are fixed from then on."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    # a task holds a row group of what it writes and of what it reads
    out.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash128(*cols: Column) -> Column:
    """16-byte key of the columns (md5 of their text forms)."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in cols])))


def pick(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])
