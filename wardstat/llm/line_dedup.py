"""Line dedup by a suffix array over sequences of line ids.

Lines that occur once can be in no repeated run, so the suffixes that are
sorted begin at lines that occur again.  Ranks are doubled: the rank of a
suffix by its first 2h lines follows from the pair of ranks, by h lines, at its
place and h places on.  A suffix alone with its first 2h lines has its final
place in the array and leaves, and every suffix that needs it beyond is alone
as well.  What remains at a step are the intervals of the array whose longest
common prefix is 2h lines or more; the first text position of an interval is
the copy that stays, the others are later copies.  The steps end when no
interval is left, after log2(longest repeated run).

Ranks are global: the distinct pairs are sorted by ranges and counted up with
one total per partition, so no class of equal lines meets in one task.

A run of lines is removed where an earlier copy of it exists, in order of
(doc_id, line), if it has ``min_lines`` lines (a power of two) or is one line of
``min_words`` words.  Documents whose text is the same as an earlier one's are
copies as a whole and are settled before the sort.

Lines are split at line feeds; a line without a word is no member of a run.
With ``blanks_break`` it ends a run and stays; without (as in op2 and the
pipeline) the sequences are those of the lines with a word, and a blank line
inside a removed run goes with it, while others stay.  Words are runs of characters that are not ASCII blanks.  Null texts stay
null.
Null ids come first; rows with one id are in the table's order.  Other columns
are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import cut, hash128

MIN_LINES = 2
MIN_WORDS = 50
ROW = "__row"
BLANKS = " \t\n\x0b\f\r"      # as \s of Spark's expressions


def counted_up(df: DataFrame, by: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with the total ``weight`` of the rows that come before each row in
    the order of ``by`` (distinct)."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = 0, TaskContext.get().partitionId()
        for pdf in batches:
            up = pdf[weight].cumsum()
            yield pdf.assign(**{name: total + up - pdf[weight], "_part": part})
            total += int(up.iloc[-1]) if len(up) else 0

    local = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)
                .mapInPandas(add, f"{types}, `{name}` long, _part int"))
    # one row per partition
    before, parts = 0, []
    for r in local.groupBy("_part").agg(F.sum(weight).alias("s")).orderBy("_part").collect():
        parts.append((r["_part"], before))
        before += r["s"]
    starts = df.sparkSession.createDataFrame(parts, "_part int, _before long")
    return (local.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"))


def _later(members: DataFrame, height: int) -> DataFrame:
    """Suffixes that are not the first of their class, with the run's length."""
    return members.where((F.col("first.row") != F.col("row")) | (F.col("first.i") != F.col("i"))
                         ).select("row", "i", F.lit(height).alias("h"), "words")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(row, i, h, words): h lines from line i on have an earlier copy, for the
    largest power of two h; ``words`` are those of line i.  ``lines``: row,
    doc_id, i, id, words, without the documents that are copies as a whole."""
    place = F.struct("doc_id", "row", "i")
    classes = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    ranked = cut(counted_up(classes.where("n > 1"), ["id"], "n", "r"))
    members = cut(lines.join(ranked.drop("n"), "id").drop("id"))
    found, h = [_later(members, 1)], 1
    while True:
        ahead = members.select("row", (F.col("i") - h).alias("i"), F.col("r").alias("r2"))
        pairs = cut(members.drop("first").join(ahead, ["row", "i"]))
        classes = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n"),
                                               F.min(place).alias("first")).where("n > 1")
        ranked = cut(counted_up(classes, ["r", "r2"], "n", "next"))
        if ranked.isEmpty():
            break
        h *= 2
        members = cut(pairs.join(ranked.drop("n"), ["r", "r2"])
                      .select("row", "doc_id", "i", "words", "first", F.col("next").alias("r")))
        found.append(_later(members, h))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("row", "i").agg(F.max("h").alias("h"), F.max("words").alias("words"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
                blanks_break: bool = True) -> DataFrame:
    """``row``: a struct of the columns of ``docs`` with the cleaned text, n_lines,
    removed: array of struct(start, end) of the removed lines (end exclusive),
    longest: the lines of the longest of them."""
    numbered = docs.select(F.monotonically_increasing_id().alias(ROW),
                           F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, doc_id = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`").cast("long")
    split = F.split(text, "\n", -1)
    if not blanks_break:
        split = F.filter(split, lambda x: x.rlike(r"\S"))
    exploded = numbered.where(text.isNotNull()).select(
        F.col(ROW).alias("row"), doc_id.alias("doc_id"), F.posexplode(split).alias("i", "line"))
    lines = cut(exploded.where(F.col("line").rlike(r"\S")).select(
        "row", "doc_id", "i", hash128(F.col("line")).alias("id"),
        F.regexp_count("line", F.lit(r"\S+")).alias("words")))
    # whole copies: of rows with the same text all but the first
    heads = cut(numbered.where(text.isNotNull()).select(
        F.col(ROW).alias("row"), doc_id.alias("doc_id"), hash128(text).alias("same")))
    first = cut(heads.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("first")))
    copies = cut(heads.join(first, "same").where(F.col("first.row") != F.col("row")).select("row"))
    runs = repeated_runs(lines.join(copies, "row", "left_anti"))
    runs = runs.where((F.col("h") >= min_lines) | (F.col("words") >= min_words)).select(
        "row", "i", F.when(F.col("h") >= min_lines, F.col("h")).otherwise(F.lit(1)).alias("h"))
    whole = lines.join(copies, "row").groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.max("words").alias("w"), F.max("i").alias("last"))
    whole = whole.where((F.col("n") >= min_lines) | (F.col("w") >= min_words)).select(
        "row", F.lit(0).alias("i"), (F.col("last") + 1).alias("h"))
    cuts = cut(runs.unionByName(whole).groupBy("row").agg(
        F.collect_list(F.struct("i", "h")).alias("cuts")).withColumnRenamed("row", ROW))
    # the same plan at every size: the texts are shuffled once
    joined = numbered.join(cuts.hint("merge"), ROW, "left")

    @F.pandas_udf("text string, n_lines long, removed array<struct<start int, end int>>, "
                  "longest long")
    def clean(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, cuts):
            if text is None:
                out.append((None, 0, [], 0))
                continue
            rows = text.split("\n")
            worded = [k for k, r in enumerate(rows) if r.strip(BLANKS)]
            if spans is None:
                out.append((text, len(worded), [], 0))
                continue
            at = range(len(rows)) if blanks_break else worded
            merged: list[list[int]] = []
            for a, b in sorted((at[s["i"]], at[s["i"] + s["h"] - 1] + 1) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            gone = {k for a, b in merged for k in range(a, b)}
            if blanks_break:
                gone &= set(worded)
            kept = "\n".join(r for k, r in enumerate(rows) if k not in gone)
            out.append((kept, len(worded), [{"start": a, "end": b} for a, b in merged],
                        max(b - a for a, b in merged)))
        return pd.DataFrame(out, columns=["text", "n_lines", "removed", "longest"])

    cleaned = joined.withColumn("c", clean(text, F.col("cuts")))
    return cleaned.select(
        F.struct(*[(F.col("c.text") if c == text_col else F.col(f"row.`{c}`")).alias(c)
                   for c in docs.columns]).alias("row"),
        F.col("c.n_lines").alias("n_lines"), F.col("c.removed").alias("removed"),
        F.col("c.longest").alias("longest"))


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_runs, longest_run, removed (spans
    of line numbers as start-end, end exclusive), text_sha256 of what is left."""
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"),
                                                         x["end"].cast("string")))
    return dedup_lines(docs, blanks_break=False).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines",
        F.size("removed").cast("long").alias("n_runs"), F.col("longest").alias("longest_run"),
        F.concat_ws(",", spans).alias("removed"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))
