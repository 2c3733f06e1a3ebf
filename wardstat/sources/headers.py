"""The header catalogue of a set of CSV files.

``header_lines``  — (file, header): the first line that is not blank of each file,
                    read where the executors read files: a task per file, which
                    ends at its first line, so the files are not read through.
``csv_layouts``   — the files grouped by their columns: one entry per distinct
                    list of column names, whatever the number of files.
``read_layouts``  — one frame of text columns per layout.

Files without a line are in no layout.  The driver gets a row per distinct header
line with the paths of its files, no more than Spark itself holds when it lists
the files of a scan.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: With a file's cost as large as a partition, every file is a partition of its own.
ONE_FILE = str(1 << 60)
#: Lines of a file that are read after its header at most.
SHORT = 1000


class Layout(NamedTuple):
    names: tuple[str, ...]      # column names as in the header, stripped
    files: tuple[str, ...]      # paths as a reader takes them


def as_path(uri: str) -> str:
    """A file's URI as a path for a reader: decoded, with glob characters quoted."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def clean_name(name: str) -> str:
    """A header name without a byte-order mark and surrounding blanks."""
    return name.strip().lstrip("﻿").strip()


def _first_line(rows: Iterator[Row]) -> Iterator[Row]:
    for r in rows:
        if r[1].strip():
            yield r
            break
    # a short file is read to its end: only then is the Python worker used again
    for _ in islice(rows, SHORT):
        pass


def header_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, header) of every file of ``path`` (files, folders or globs) that has a
    line; ``file`` is the URI that ``_metadata.file_path`` gives."""
    # a session of its own: its split sizes hold for this scan only
    apart = spark.newSession()
    apart.conf.set("spark.sql.files.maxPartitionBytes", ONE_FILE)
    apart.conf.set("spark.sql.files.openCostInBytes", ONE_FILE)
    lines = apart.read.text(path).select("_metadata.file_path", "value")
    # a task ends with its first line, which no built-in operator does per partition
    return spark.createDataFrame(lines.rdd.mapPartitions(_first_line),
                                 "file string, header string")


def csv_layouts(spark: SparkSession, path: str | Sequence[str]) -> list[Layout]:
    """The files of ``path`` by the names of their columns, in the order of the names."""
    by_line = header_lines(spark, path).groupBy("header").agg(
        F.array_sort(F.collect_set("file")).alias("files"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in by_line.collect():
        names = tuple(clean_name(n) for n in next(csv.reader([r["header"].lstrip("﻿")])))
        found.setdefault(names, []).extend(as_path(f) for f in r["files"])
    return [Layout(names, tuple(sorted(files))) for names, files in sorted(found.items())]


def read_layouts(spark: SparkSession, path: str | Sequence[str],
                 reader: DataFrameReader | None = None,
                 partition: T.StructField | None = None) -> list[DataFrame]:
    """The CSV files of ``path`` as text columns, a frame per layout.  A name that a
    header repeats (in any case) is its first column; columns without a name are left
    out.  ``partition`` is the partition column of a folder with ``name=value`` folders
    in it; it comes last, and hides a column of the files that has its name."""
    layouts = csv_layouts(spark, path)
    out = []
    for layout in layouts:
        # columns by position: the catalogue knows the header of each of the files
        first: dict[str, int] = {}
        for k, name in enumerate(layout.names):
            if name and (partition is None or name.upper() != partition.name.upper()):
                first.setdefault(name.upper(), k)
        wanted = {k: layout.names[k] for k in first.values()}
        fields = [T.StructField(wanted.get(k, f"_p{k}"), T.StringType())
                  for k in range(len(layout.names))]
        names = list(wanted.values())
        base = (reader if reader is not None else spark.read).option("header", True)
        if partition is not None:
            fields.append(partition)
            names.append(partition.name)
            base = base.option("basePath", path)
        files = [path] if len(layouts) == 1 and isinstance(path, str) else list(layout.files)
        frame = base.schema(T.StructType(fields)).csv(files)
        out.append(frame.select(*[F.col("`" + name.replace("`", "``") + "`") for name in names]))
    return out
