"""OMOP table sources: CSV (plain or compressed) and Parquet, bound to the
fixed layouts of ``wardstat.schemas`` by header name.

* ``read_omop_csv``      — one table; columns matched by header name
                           (case-insensitive) file by file, missing columns
                           become typed nulls, extra columns are ignored.
* ``load_directory``     — every known table of a folder (local, HDFS, S3...),
                           one lazy read per table; unknown files are skipped.
* ``combine_yearly``     — concatenate per-year extracts with a YEAR column.

Malformed rows: a row is malformed when a non-blank declared field does not
convert to its type (dates with the configured format).  ``mode`` decides:
``DROPMALFORMED`` (default) drops such rows, ``PERMISSIVE`` keeps them with
the bad fields null, ``FAILFAST`` raises.  The rule is computed from the
fields themselves, so it does not depend on which columns a query reads;
columns whose type always converts need no check and are read only if wanted.
``malformed_counts`` says how many rows were left out.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.dataset import OmopDataset
from wardstat.functions.dates import parse_date
from wardstat.schemas import OMOP_TABLE_COLUMNS, table_schema
from wardstat.sources.headers import clean_name, read_layouts

log = logging.getLogger(__name__)

# File suffixes understood by Spark's CSV source through Hadoop codecs.
CSV_SUFFIXES = (".csv", ".csv.gz", ".csv.bz2", ".csv.lz4", ".csv.snappy", ".csv.deflate")
# Suffixes with no Hadoop codec: rejected instead of silently reading 0 rows.
UNSUPPORTED_SUFFIXES = (".csv.zip", ".csv.bzip2")

MALFORMED = "_malformed"

# Fixed values of the extracts' CSV form: a quoted empty field reads as this
# mark, and a text that starts with the escape mark has its line ends, quotes
# and backslashes written as percent codes (see sinks.files.write_csv).
EMPTY_MARK = "\x1aempty"
ESCAPE_MARK = "\x1a%"
ESCAPES = (("\n", "%0A"), ("\r", "%0D"), ('"', "%22"), ("\\", "%5C"))

_EXACT = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4}


def _typed(raw: Column, field: T.StructField, date_format: str) -> Column:
    if isinstance(field.dataType, T.DateType):
        return parse_date(raw, date_format)
    if isinstance(field.dataType, T.StringType):
        return unescaped(raw)
    return raw.try_cast(field.dataType)


def escaped(text: Column) -> Column:
    """A string in the extracts' CSV form."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    odd = text.startswith(ESCAPE_MARK[0])
    for char, code in ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(code))
        odd = odd | text.contains(char)
    return F.when(odd, F.concat(F.lit(ESCAPE_MARK), out)).otherwise(text)


def unescaped(text: Column) -> Column:
    out = F.substring(text, len(ESCAPE_MARK) + 1, 2 ** 31 - 1)
    for char, code in ESCAPES:
        out = F.replace(out, F.lit(code), F.lit(char))
    out = F.replace(out, F.lit("%25"), F.lit("%"))
    return (F.when(text == EMPTY_MARK, "").when(text.startswith(ESCAPE_MARK), out)
            .otherwise(text))


def _cannot_fail(source: T.DataType, target: T.DataType) -> bool:
    """Every value of ``source`` converts to ``target``: no check is needed, and
    a scan that does not want the column need not read it."""
    if source == target or isinstance(target, T.StringType):
        return True
    wide = _EXACT.get(type(source), 9) <= _EXACT.get(type(target), 0)
    return wide or (type(source) in _EXACT and isinstance(target, (T.FloatType, T.DoubleType)))


def _typed_columns(raw: DataFrame, table: str, date_format: str,
                   from_text: bool) -> tuple[list[Column], list[Column]]:
    """The table's columns over ``raw``, and for each that can fail whether it does."""
    schema = table_schema(table)
    # header names match case-insensitively, ignoring a byte-order mark and
    # surrounding blanks
    by_upper = {clean_name(c).upper(): c for c in raw.columns}
    cols, bad = [], []
    for f in schema.fields:
        src = by_upper.get(f.name.upper())
        if src is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        rc = F.col(f"`{src}`")
        source = raw.schema[src].dataType
        if source == f.dataType and not (from_text and isinstance(source, T.StringType)):
            typed = rc
        elif isinstance(source, T.StringType):
            blank = rc.isNull() | (rc == EMPTY_MARK) | (F.trim(rc) == "")
            typed = _typed(rc, f, date_format)
            if not isinstance(f.dataType, T.StringType):
                bad.append(~blank & typed.isNull())
        elif _cannot_fail(source, f.dataType):
            typed = rc.cast(f.dataType)
        else:
            typed = rc.try_cast(f.dataType)
            bad.append(rc.isNotNull() & typed.isNull())
        cols.append(typed.alias(f.name))
    return cols, bad


def can_lose_rows(raw: DataFrame, table: str) -> bool:
    """Whether rows of ``raw`` can be malformed at all."""
    return bool(_typed_columns(raw, table, "yyyyMMdd", False)[1])


def bind_columns(raw: DataFrame, table: str, date_format: str = "yyyyMMdd",
                 mode: str = "DROPMALFORMED", from_text: bool = False) -> DataFrame:
    """Bind a frame of raw (string or typed) columns to the table layout."""
    cols, bad = _typed_columns(raw, table, date_format, from_text)
    if not bad and mode.upper() in ("DROPMALFORMED", "PERMISSIVE", "FAILFAST"):
        return raw.select(*cols)
    flag = reduce(lambda a, b: a | b, bad) if bad else F.lit(False)
    out = raw.select(*cols, flag.alias(MALFORMED))
    mode = mode.upper()
    if mode == "DROPMALFORMED":
        return out.where(~F.col(MALFORMED)).drop(MALFORMED)
    if mode == "PERMISSIVE":
        return out.drop(MALFORMED)
    if mode == "FAILFAST":
        check = F.when(F.col(MALFORMED), F.raise_error(F.lit(f"malformed row in {table}")))
        return out.where(check.isNull()).drop(MALFORMED)
    if mode == "FLAG":
        return out
    raise ValueError(f"unknown mode {mode!r}")


def csv_frames(spark: SparkSession, path: str) -> list[DataFrame]:
    """The CSV files of ``path`` (file, folder or glob) as text columns, one frame per
    distinct header: columns are bound by each file's own header, however many
    files there are."""
    reader = spark.read.option("mode", "PERMISSIVE").option("emptyValue", EMPTY_MARK)
    return read_layouts(spark, path, reader)


def read_omop_csv(spark: SparkSession, path: str, table: str,
                  date_format: str = "yyyyMMdd", mode: str = "DROPMALFORMED") -> DataFrame:
    """Read a CSV table (file, folder or glob) whose files have a header line."""
    _check_suffix(path)
    return _bound_csv(spark, csv_frames(spark, path), table, date_format, mode)


def _bound_csv(spark: SparkSession, frames: Sequence[DataFrame], table: str, date_format: str,
               mode: str) -> DataFrame:
    parts = [bind_columns(raw, table, date_format, mode, from_text=True) for raw in frames]
    if not parts:       # no file has a line
        empty = spark.createDataFrame([], table_schema(table))
        return empty.withColumn(MALFORMED, F.lit(False)) if mode.upper() == "FLAG" else empty
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_omop_parquet(spark: SparkSession, path: str, table: str,
                      date_format: str = "yyyyMMdd", mode: str = "DROPMALFORMED") -> DataFrame:
    return bind_columns(spark.read.parquet(path), table, date_format, mode)


def malformed_rows(spark: SparkSession, path: str, table: str,
                   date_format: str = "yyyyMMdd") -> DataFrame:
    """The rows ``DROPMALFORMED`` would drop (for counting / inspection)."""
    df = read_omop_csv(spark, path, table, date_format, mode="FLAG")
    return df.where(F.col(MALFORMED)).drop(MALFORMED)


def _check_suffix(path: str) -> None:
    low = path.lower()
    for s in UNSUPPORTED_SUFFIXES:
        if low.endswith(s):
            raise ValueError(f"{path}: {s} files have no Hadoop codec; "
                             "recompress as .gz, .bz2, .lz4 or .snappy")


def table_name(file_name: str) -> str | None:
    """``person.csv.gz`` -> ``person``; None for files that are not tables."""
    low = file_name.lower()
    for s in sorted(CSV_SUFFIXES + UNSUPPORTED_SUFFIXES + (".parquet",), key=len, reverse=True):
        if low.endswith(s):
            return file_name[: len(file_name) - len(s)]
    return None


def list_entries(spark: SparkSession, directory: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is_directory) of a folder's entries via Hadoop FS."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(st.getPath().getName(), st.getPath().toString(), st.isDirectory())
            for st in fs.listStatus(path)]


def load_directory(spark: SparkSession, directory: str, date_format: str = "yyyyMMdd",
                   mode: str = "DROPMALFORMED") -> OmopDataset:
    """Every known OMOP table in ``directory``.  ``<table>.csv[.codec]`` and
    ``<table>.parquet`` files, and folders written by Spark with or without such a
    suffix, are read; other entries are skipped with a log message."""
    tables: dict[str, DataFrame] = {}
    flagged: dict[str, DataFrame] = {}
    dropping = mode.upper() == "DROPMALFORMED"
    for name, full, is_dir in sorted(list_entries(spark, directory)):
        if name.startswith((".", "_")):
            continue
        stem = table_name(name) or (name if is_dir else None)
        if stem is None or stem not in OMOP_TABLE_COLUMNS:
            log.warning("no OMOP layout for %s; skipped", name)
            continue
        if stem in tables:
            raise ValueError(f"two sources of table {stem!r} in {directory}: {name} and another")
        if name.lower().endswith(".parquet") or (is_dir and _is_parquet_dir(spark, full)):
            raw = spark.read.parquet(full)
            tables[stem] = bind_columns(raw, stem, date_format, mode)
            if dropping and can_lose_rows(raw, stem):
                flagged[stem] = bind_columns(raw, stem, date_format, "FLAG")
        else:
            _check_suffix(full)
            frames = csv_frames(spark, full)
            tables[stem] = _bound_csv(spark, frames, stem, date_format, mode)
            if dropping:
                flagged[stem] = _bound_csv(spark, frames, stem, date_format, "FLAG")
    return OmopDataset(tables, flagged)


def malformed_counts(ds: OmopDataset, tables: Sequence[str]) -> dict[str, int]:
    """Rows that ``DROPMALFORMED`` leaves out, by table: a pass of its own over each
    file table that has columns to check (``sources.staging`` counts them in a pass
    that is needed anyway).  A table that loses all its rows is an error (most likely
    the date format is another one)."""
    out = {}
    for name in tables:
        flags = ds.flagged.get(name)
        if flags is None:
            continue
        r = flags.agg(F.count(F.lit(1)).alias("n"),
                      F.count(F.when(F.col(MALFORMED), 1)).alias("bad")).first()
        out[name] = check_counts(name, r["n"], r["bad"])
    return out


def check_counts(name: str, n: int, bad: int) -> int:
    if n and n == bad:
        raise ValueError(f"all {n} rows of {name} are malformed; check the date format")
    return bad


def _is_parquet_dir(spark: SparkSession, path: str) -> bool:
    return any(n.endswith(".parquet") for n, _, d in list_entries(spark, path) if not d)


def combine_yearly(frames: Mapping[int | None, DataFrame]) -> DataFrame:
    """Concatenate per-year extracts, each prefixed with its ``YEAR`` (None
    gives a null year); columns are matched by name (a column missing in
    one year is null)."""
    parts = [df.select(F.lit(None if year is None else int(year)).cast("int").alias("YEAR"), "*")
             for year, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _all_text(raw: DataFrame, *but: str) -> DataFrame:
    return raw.select(*[F.col(f"`{c}`") if c in but else unescaped(F.col(f"`{c}`")).alias(c)
                        for c in raw.columns])


def _by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def read_yearly_csv(spark: SparkSession, paths: Mapping[int | None, str]) -> DataFrame:
    """``combine_yearly`` over CSV files with headers (all columns as text); files
    of one year may have different headers."""
    years = {y: [_all_text(raw) for raw in csv_frames(spark, p)] for y, p in paths.items()}
    filled = {y: reduce(_by_name, frames) for y, frames in years.items() if frames}
    if not filled:
        return spark.createDataFrame([], "YEAR int")
    return combine_yearly(filled)


def read_yearly_folder(spark: SparkSession, folder: str, column: str = "year") -> DataFrame:
    """A folder of yearly CSV extracts (``<folder>/year=2008/*.csv``) as one table with its
    ``YEAR`` in front (null for the folder of rows without one), all other columns as text
    and matched by name.  The years come from the folders' names by partition
    discovery: a scan per distinct header, not per year, and a filter on YEAR reads
    only its folders.  A column of the files named as the partition is left out."""
    reader = spark.read.option("mode", "PERMISSIVE").option("emptyValue", EMPTY_MARK)
    frames = read_layouts(spark, folder.rstrip("/"), reader,
                          T.StructField(column, T.IntegerType()))
    if not frames:
        return spark.createDataFrame([], "YEAR int")
    both = reduce(_by_name, [_all_text(raw, column) for raw in frames])
    rest = [F.col(f"`{c}`") for c in both.columns if c != column]
    return both.select(F.col(column).alias("YEAR"), *rest)
