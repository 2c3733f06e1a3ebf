"""File sinks.

* ``write_csv``              — distributed CSV with header and codec.
* ``write_tables``           — every table of a dataset under ``<dir>/<table>``
                               (CSV or Parquet).
* ``write_single_csv``       — one CSV file (a header-only file for an empty
                               frame); for small results such as counts.
* ``write_partitioned_csv``  — one folder per value of a key column
                               (per-procedure scorecards).
* ``write_report_text``      — report lines (``render_report``) as text files in order.

Nothing is collected on the driver: even single-file outputs are written
by one task after Spark has done the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.dataset import OmopDataset
from wardstat.functions.dates import spark_pattern
from wardstat.sources.tables import escaped

# Codec names accepted by the CSV writer; "none"/"uncompressed" write plain text.
CSV_CODECS = ("none", "uncompressed", "bzip2", "deflate", "gzip", "lz4", "snappy")


def _codec(codec: str | None) -> str:
    if codec is None or str(codec).lower() in ("", "none"):
        return "none"
    c = str(codec).lower()
    if c not in CSV_CODECS:
        raise ValueError(f"unsupported CSV codec {codec!r}; choose one of {CSV_CODECS}")
    return c


def write_csv(df: DataFrame, path: str, codec: str | None = None,
              mode: str = "errorifexists", date_format: str = "%Y%m%d") -> None:
    """CSV with a header line that the loaders read back as it is: dates in
    ``date_format``, blanks kept, a null as an empty field and an empty text
    as a quoted one, line ends, quotes and backslashes escaped."""
    _csv_writer(_as_text(df), codec, mode, date_format).csv(path)


def _as_text(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*[escaped(F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) and f.name not in but
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _csv_writer(text: DataFrame, codec: str | None, mode: str, date_format: str):
    return (text.write.mode(mode).option("header", True).option("compression", _codec(codec))
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("dateFormat", spark_pattern(date_format)))


def write_tables(ds: OmopDataset, directory: str, codec: str | None = None,
                 fmt: str = "csv", mode: str = "errorifexists",
                 date_format: str = "%Y%m%d") -> None:
    base = directory.rstrip("/")
    for name, df in ds.items():
        if fmt == "csv":
            write_csv(df, f"{base}/{name}", codec, mode, date_format)
        elif fmt == "parquet":
            df.write.mode(mode).parquet(f"{base}/{name}")
        else:
            raise ValueError(f"unsupported table format {fmt!r}")


def write_single_csv(df: DataFrame, path: str, codec: str | None = None,
                     mode: str = "errorifexists", date_format: str = "%Y%m%d") -> None:
    """One CSV part file under ``path``; meant for small, already aggregated
    results (an empty frame still gets its header line)."""
    write_csv(df.repartition(1), path, codec, mode, date_format)


def write_partitioned_csv(df: DataFrame, path: str, key: str, codec: str | None = None,
                          mode: str = "errorifexists", date_format: str = "%Y%m%d",
                          order: Sequence = (), keys: DataFrame | Sequence[str] = ()) -> None:
    """``path/<key>=<value>/part-*.csv``: the rows of each value of ``key`` in the order of
    ``order``, in one file or, of a value with many rows, in several whose names follow
    the order.  Values of ``keys`` (a list, or a frame with a column ``key``) without a row
    get a file with the header only.  Read back with a schema in which the key is a
    string (Spark would else guess its type from the folder names)."""
    column = F.col(f"`{key}`")
    # by ranges of the key and the order: a value with a large share of the rows is
    # several tasks' work.  The sort comes last: the writer keeps it only if it sees
    # the key in front
    by_range = (_as_text(df, key).repartitionByRange(column, *order)
                .sortWithinPartitions(column, *order))
    _csv_writer(by_range, codec, mode, date_format).partitionBy(key).csv(path)
    if not isinstance(keys, DataFrame):
        if not keys:
            return
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` string")
    without = keys.select(column.cast("string")).distinct().join(
        df.select(column.cast("string")).distinct(), key, "left_anti")
    header = ",".join(f.name for f in df.schema.fields if f.name != key)
    (without.select(column, F.lit(header).alias("value")).write.mode("append")
     .option("compression", _codec(codec)).partitionBy(key).text(path))


def write_report_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``render_report`` output in its order as text: part files whose names
    follow the order, so that they read as the report one after the other.  A report
    of up to about a megabyte is one file; a larger one, of a large dictionary, is
    sorted and written by ranges in several tasks."""
    order = [F.col("proc_ord").asc_nulls_last(), "seq", "ord"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.mode(mode).text(path)
