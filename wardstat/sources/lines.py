"""Lines of text files in one order: files by name, lines as they stand in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(line_no, value): every line of the files of ``path``, numbered from 0 through all
    files in the order of their paths.

    A file may be read in several pieces and files are packed into tasks by size, so
    the order in which Spark happens to read says nothing.  Lines are counted within a
    piece; the pieces, a row each, are put in order by path and offset, and their
    totals added up."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("at"))
    pieces = lines.groupBy("file", "offset").agg(F.min("at").alias("first"),
                                                 F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "offset").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "offset", "first",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "offset"]).select(
        (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")
