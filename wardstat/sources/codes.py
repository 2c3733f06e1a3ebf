"""Code dictionaries (procedure -> list of codes) and code descriptions.

A dictionary is a small DataFrame ``(procedure, proc_ord, ord, code)``:
``proc_ord`` keeps the order procedures were declared in, ``ord`` the
position of the code inside its list.  Repeated codes in one list are kept
(they are listed and summed twice in reports); filters use the distinct
``(procedure, code)`` pairs.

Its row count is known when it is built, so joins broadcast it only when
that count is under ``MAX_BROADCAST_ENTRIES`` and fall back to a shuffle
join above it.  Then the events are sieved first (``narrowed``): a Bloom filter of the
codes, of bounded size, drops nearly all other events in the scan, before they
are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.functions.sieve import Sieve, bits_for
from wardstat.sources.lines import ordered_lines

MAX_BROADCAST_ENTRIES = 500_000

_ARROW_TYPES = {"procedure": pa.string(), "proc_ord": pa.int64(), "ord": pa.int32(),
                "code": pa.string(), "branch": pa.string()}


def local_frame(spark: SparkSession, rows, names: Sequence[str]) -> DataFrame:
    """A small driver-side table as a local relation (Arrow): it is planned
    as a literal scan, broadcast without a job, and two frames built from
    the same rows are the same plan (so persisted results built on them are
    found again by Spark's cache)."""
    rows = list(rows)
    cols = list(zip(*rows)) if rows else [() for _ in names]
    table = pa.table({n: pa.array(list(c), type=_ARROW_TYPES[n]) for n, c in zip(names, cols)})
    return spark.createDataFrame(table)




@dataclass(frozen=True)
class CodeDictionary:
    """``df`` holds every entry; ``n_entries`` is its row count.

    Dictionaries up to ``MAX_BROADCAST_ENTRIES`` entries are kept as local
    relations (``rows``): their derived views (distinct pairs, codes,
    procedures) are built on the driver and broadcast, so they add no
    shuffle stage.  Larger ones stay distributed and join by shuffle.
    """
    df: DataFrame
    n_entries: int
    rows: tuple | None = None
    max_broadcast: int | None = None    # entries; None: MAX_BROADCAST_ENTRIES

    @property
    def _spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def is_small(self) -> bool:
        limit = MAX_BROADCAST_ENTRIES if self.max_broadcast is None else self.max_broadcast
        return self.n_entries <= limit

    def _local(self, data, names) -> DataFrame:
        return F.broadcast(local_frame(self._spark, data, names))

    def entries(self) -> DataFrame:
        """All entries, repeated codes included, ready to join."""
        return F.broadcast(self.df) if self.is_small else self.df

    def pairs(self) -> DataFrame:
        """Distinct (procedure, code) pairs for filtering events."""
        if self.rows is not None:
            seen = dict.fromkeys((r[0], r[3]) for r in self.rows)
            return self._local(seen, ["procedure", "code"])
        return self.df.select("procedure", "code").distinct()

    def tagged_pairs(self, tag: str, other: "CodeDictionary | None" = None,
                     other_tag: str | None = None) -> DataFrame:
        """Distinct (procedure, code, branch) of this dictionary tagged
        ``tag`` and optionally of ``other`` tagged ``other_tag``: one join
        side that routes each event to every list it belongs to."""
        parts = [(self, tag)] + ([(other, other_tag)] if other is not None else [])
        if all(d.rows is not None for d, _ in parts):
            seen = dict.fromkeys((r[0], r[3], t) for d, t in parts for r in d.rows)
            return self._local(seen, ["procedure", "code", "branch"])
        out = None
        for d, t in parts:
            x = d.df.select("procedure", "code", F.lit(t).alias("branch"))
            out = x if out is None else out.unionByName(x)
        return out.distinct()

    def codes(self) -> DataFrame:
        """Distinct codes of all procedures."""
        if self.rows is not None:
            return self._local(((c,) for c in dict.fromkeys(r[3] for r in self.rows)),
                               ["code"])
        return self.df.select("code").distinct()

    def procedure_names(self) -> list[str] | None:
        if self.rows is None:
            return None
        return list(dict.fromkeys(r[0] for r in self.rows))

    def restrict_to(self, other: "CodeDictionary") -> "CodeDictionary":
        """Keep only procedures that also appear in ``other``."""
        mine, theirs = self.procedure_names(), other.procedure_names()
        if mine is not None and theirs is not None:
            keep = set(theirs)
            rows = tuple(r for r in self.rows if r[0] in keep)
            return _local_dictionary(self._spark, rows)
        kept = self.df.join(F.broadcast(other.df.select("procedure"))
                            if other.is_small else other.df.select("procedure").distinct(),
                            "procedure", "left_semi")
        return CodeDictionary(kept, self.n_entries, None, self.max_broadcast)


def narrowed(events: DataFrame, column: str, dictionaries: Sequence[CodeDictionary]) -> DataFrame:
    """``events`` without most rows whose code is in none of ``dictionaries``, where a
    shuffle join follows; a dictionary that is broadcast needs none.  The join still
    decides: the sieve lets some other codes through."""
    if all(d.is_small for d in dictionaries):
        return events
    entries = sum(d.n_entries for d in dictionaries)
    codes = dictionaries[0].df.select("code")
    for d in dictionaries[1:]:
        codes = codes.union(d.df.select("code"))
    return events.where(Sieve(codes, bits_for(entries)).may_hold(events, [column]))


def codes_of(dictionaries: Sequence[CodeDictionary]) -> DataFrame:
    """Distinct codes of several dictionaries: a broadcast local relation
    when all of them are local, else a distributed distinct."""
    if dictionaries and all(d.rows is not None for d in dictionaries):
        codes = dict.fromkeys(r[3] for d in dictionaries for r in d.rows)
        return dictionaries[0]._local(((c,) for c in codes), ["code"])
    out = None
    for d in dictionaries:
        x = d.df.select("code")
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def _local_dictionary(spark: SparkSession, rows) -> CodeDictionary:
    rows = tuple(tuple(r) for r in rows)
    df = local_frame(spark, rows, ["procedure", "proc_ord", "ord", "code"])
    return CodeDictionary(df, len(rows), rows)


def dictionary_from_mapping(spark: SparkSession,
                            mapping: Mapping[str, Sequence[str]]) -> CodeDictionary:
    rows = [(proc, p_ord, i, code)
            for p_ord, (proc, codes) in enumerate(mapping.items())
            for i, code in enumerate(codes)]
    return _local_dictionary(spark, rows)


def read_code_dictionary(spark: SparkSession, path: str) -> CodeDictionary:
    """Read ``name = code,code,...`` lines.

    Lines without ``=`` and lines starting with ``#`` are skipped.  The key
    and the value are stripped; the value is split on ``,`` as is.  When a
    key repeats, its last line wins but it keeps its first position; of several
    files the lines of the one that comes later by name are later.
    """
    lines = ordered_lines(spark, path)
    kv = (lines.where(F.col("value").contains("=") & ~F.col("value").startswith("#"))
          .select(
              F.regexp_replace(F.substring_index("value", "=", 1), r"^\s+|\s+$", "")
              .alias("procedure"),
              F.regexp_replace(F.expr("substr(value, instr(value, '=') + 1)"),
                               r"^\s+|\s+$", "").alias("codes"),
              "line_no"))
    df = (kv.groupBy("procedure").agg(F.min("line_no").alias("proc_ord"),
                                      F.max_by("codes", "line_no").alias("codes"))
          .select("procedure", "proc_ord",
                  F.posexplode(F.split("codes", ",")).alias("ord", "code"))
          .select("procedure", "proc_ord", F.col("ord").cast("int"), "code"))
    # The file is a configuration list: counting it is one tiny scan and
    # gives the size that decides between a local (broadcast) dictionary and
    # a distributed one.
    n = df.count()
    if n <= MAX_BROADCAST_ENTRIES:
        return _local_dictionary(spark, [tuple(r) for r in df.collect()])
    return CodeDictionary(df, n)


def read_code_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Read ``code<blank>description`` lines into (code, description).

    The description is everything after the first blank, right-stripped
    (a padded short code keeps its leading blank).  On a repeated code the
    last line wins (of the last file by name).
    """
    lines = ordered_lines(spark, path)
    has_blank = F.instr("value", " ") > 0
    parsed = lines.select(
        F.when(has_blank, F.substring_index("value", " ", 1)).otherwise(F.col("value"))
        .alias("code"),
        F.when(has_blank, F.regexp_replace(F.expr("substr(value, instr(value, ' ') + 1)"),
                                           r"\s+$", ""))
        .otherwise(F.lit("")).alias("description"),
        "line_no")
    return parsed.groupBy("code").agg(
        F.max_by("description", "line_no").alias("description"))

