"""Medical-code statistics and code reports.

* ``type_concept_count``   — rows per type concept of an event table.
* ``code_frequency``       — rows per code over conditions and procedures:
                             (SOURCE_VALUE, COUNT_CO, COUNT_PO, COUNT).
* ``code_report``          — one row per dictionary entry (repeats kept):
                             count of the code and its description.
* ``report_totals``        — per-procedure totals and the grand total
                             (``rollup``; grand total has a null procedure).
* ``readmission_code_count`` / ``readmission_code_report`` — the same for
                             complication codes of readmissions.
* ``render_report``        — the text layout of a report as ordered lines.

Reports only need the codes of the dictionary, so events are narrowed to
those codes *before* counting, by a broadcast semi join or, for a dictionary too
large to broadcast, a Bloom filter in the scan and a shuffle semi join; the
counted side is then bounded by the dictionary size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators.events import event_view, filter_by_codes
from wardstat.sources.codes import CodeDictionary, codes_of, narrowed

TYPE_COLUMN = {"condition": "CONDITION_TYPE_CONCEPT_ID", "procedure": "PROCEDURE_TYPE_CONCEPT_ID"}

# --- fixed values: the text layout of a code report ----------------------
REPORT_PROCEDURE_HEADER = "Procedure: "
REPORT_COLUMN_HEADER = "code, count, description"
REPORT_PROCEDURE_TOTAL = "Total Count For This procedure: "
REPORT_GRAND_TOTAL = "Total Count For All Procedures: "
# ---------------------------------------------------------------------------


def type_concept_count(events: DataFrame, kind: str) -> DataFrame:
    col = TYPE_COLUMN[kind]
    return events.groupBy(col).agg(F.count(F.lit(1)).alias("COUNT"))


def code_frequency(conditions: DataFrame, procedures: DataFrame,
                   condition_types: Sequence[int] | None = None,
                   procedure_types: Sequence[int] | None = None,
                   only_codes: CodeDictionary | None = None) -> DataFrame:
    """(SOURCE_VALUE, COUNT_CO, COUNT_PO, COUNT = COUNT_CO + COUNT_PO).

    Equivalent to a full outer join of the two per-table counts followed by
    ``fillna(0)``, done as one aggregation over the union: non-null codes of
    both tables merge, while a null code stays one row per table (a null
    join key never matches).  ``*_types`` restrict to primary type concepts;
    ``only_codes`` restricts to the codes of a dictionary.
    """
    parts = []
    for kind, df, types, tag in (("condition", conditions, condition_types, "C"),
                                 ("procedure", procedures, procedure_types, "P")):
        ev = event_view(df, kind)
        if types is not None:
            ev = filter_by_codes(ev, "TYPE_CONCEPT_ID", types)
        if only_codes is not None:
            ev = narrowed(ev, "SOURCE_VALUE", [only_codes])
            ev = ev.join(only_codes.codes().withColumnRenamed("code", "SOURCE_VALUE"),
                         "SOURCE_VALUE", "left_semi")
        parts.append(ev.select("SOURCE_VALUE", F.lit(tag).alias("_t")))
    u = parts[0].unionByName(parts[1])
    null_side = F.when(F.col("SOURCE_VALUE").isNull(), F.col("_t"))
    agg = u.groupBy("SOURCE_VALUE", null_side.alias("_null_side")).agg(
        F.count(F.when(F.col("_t") == "C", 1)).alias("COUNT_CO"),
        F.count(F.when(F.col("_t") == "P", 1)).alias("COUNT_PO"))
    return agg.select("SOURCE_VALUE", "COUNT_CO", "COUNT_PO",
                      (F.col("COUNT_CO") + F.col("COUNT_PO")).alias("COUNT"))


def _descriptions_for(dictionary: CodeDictionary, descriptions: DataFrame) -> DataFrame:
    """One description per dictionary code: narrowed to the dictionary's
    codes and reduced to one row per code (the largest text if a table has
    several; ``read_code_descriptions`` output already has one), so the
    lookup is bounded by the dictionary size and safe to broadcast."""
    d = (descriptions.select("code", "description")
         .join(dictionary.codes(), "code", "left_semi")
         .groupBy("code").agg(F.max("description").alias("description")))
    return F.broadcast(d) if dictionary.is_small else d


def _describe(entries: DataFrame, counts: DataFrame, descriptions: DataFrame | None,
              dictionary: CodeDictionary) -> DataFrame:
    """Dictionary entries with COUNT (missing -> 0) and DESCRIPTION (missing -> '').

    ``counts`` must have (code, COUNT) and be narrowed to dictionary codes;
    descriptions are narrowed here, so both lookups are bounded by the
    dictionary size and broadcast."""
    out = entries.join(F.broadcast(counts) if dictionary.is_small else counts, "code", "left")
    if descriptions is not None:
        out = out.join(_descriptions_for(dictionary, descriptions), "code", "left")
        desc = F.coalesce(F.col("description"), F.lit(""))
    else:
        desc = F.lit("")
    return out.select(
        "procedure", "proc_ord", "ord", "code",
        F.coalesce(F.col("COUNT"), F.lit(0).cast("bigint")).alias("COUNT"),
        desc.alias("DESCRIPTION"))


def code_report(dictionary: CodeDictionary, conditions: DataFrame, procedures: DataFrame,
                descriptions: DataFrame | None = None,
                condition_types: Sequence[int] | None = None,
                procedure_types: Sequence[int] | None = None) -> DataFrame:
    """(procedure, proc_ord, ord, code, COUNT, DESCRIPTION) for every
    dictionary entry; COUNT is the code's count over both event tables
    (optionally primary types only).  A code listed twice appears twice."""
    freq = code_frequency(conditions, procedures, condition_types, procedure_types,
                          only_codes=dictionary)
    counts = freq.where(F.col("SOURCE_VALUE").isNotNull()).select(
        F.col("SOURCE_VALUE").alias("code"), "COUNT")
    return _describe(dictionary.entries(), counts, descriptions, dictionary)


def code_counts(conditions: DataFrame, procedures: DataFrame,
                dictionaries: Sequence[CodeDictionary],
                condition_types: Sequence[int], procedure_types: Sequence[int]) -> DataFrame:
    """(code, COUNT, COUNT_PRIMARY) for every code of the given dictionaries,
    over both event tables, all types and primary types at once: one scan
    of each event table serves every code report of a run.  The result
    has at most one row per dictionary code."""
    codes = codes_of(dictionaries)
    parts = []
    for kind, df, types in (("condition", conditions, condition_types),
                            ("procedure", procedures, procedure_types)):
        ev = narrowed(event_view(df, kind), "SOURCE_VALUE", dictionaries).join(
            codes.withColumnRenamed("code", "SOURCE_VALUE"), "SOURCE_VALUE", "left_semi")
        parts.append(ev.select(F.col("SOURCE_VALUE").alias("code"),
                               F.col("TYPE_CONCEPT_ID").isin(list(types)).alias("_primary")))
    return parts[0].unionByName(parts[1]).groupBy("code").agg(
        F.count(F.lit(1)).alias("COUNT"),
        F.count(F.when(F.col("_primary"), 1)).alias("COUNT_PRIMARY"))


def code_report_from_counts(dictionary: CodeDictionary, counts: DataFrame,
                            descriptions: DataFrame | None = None,
                            primary: bool = False) -> DataFrame:
    """``code_report`` computed from ``code_counts`` output."""
    c = counts.select("code", F.col("COUNT_PRIMARY" if primary else "COUNT").alias("COUNT"))
    return _describe(dictionary.entries(), c, descriptions, dictionary)


def report_totals(report: DataFrame) -> DataFrame:
    """(procedure, TOTAL): one row per procedure and a grand total row whose
    procedure is null (``rollup``)."""
    return (report.rollup("procedure")
            .agg(F.sum("COUNT").cast("bigint").alias("TOTAL")))


def readmission_code_count(readmission_rows: DataFrame) -> DataFrame:
    """(procedure, SOURCE_VALUE, COUNT) of readmission rows."""
    return readmission_rows.groupBy("procedure", "SOURCE_VALUE").agg(
        F.count(F.lit(1)).alias("COUNT"))


def readmission_code_report(complications: CodeDictionary, readmission_rows: DataFrame,
                            descriptions: DataFrame | None = None) -> DataFrame:
    """Complication-code report: for every entry of the complication
    dictionary, the number of readmissions of that procedure with that code
    (0 for procedures that had no index stays)."""
    counts = readmission_code_count(readmission_rows).select(
        "procedure", F.col("SOURCE_VALUE").alias("code"), "COUNT")
    # Readmission codes come from the complication lists, so the counts are
    # bounded by the dictionary size.
    entries = complications.entries()
    out = entries.join(F.broadcast(counts) if complications.is_small else counts,
                       ["procedure", "code"], "left")
    if descriptions is not None:
        out = out.join(_descriptions_for(complications, descriptions), "code", "left")
        desc = F.coalesce(F.col("description"), F.lit(""))
    else:
        desc = F.lit("")
    return out.select(
        "procedure", "proc_ord", "ord", "code",
        F.coalesce(F.col("COUNT"), F.lit(0).cast("bigint")).alias("COUNT"),
        desc.alias("DESCRIPTION"))


def render_report(report: DataFrame) -> DataFrame:
    """The report as text lines ``(proc_ord, seq, ord, line)``; sorting by
    those columns gives the file layout:

    ``Procedure: p`` / ``code, count, description`` / ``code,count,descr``...
    / ``Total Count For This procedure: n`` / blank line, and finally
    ``Total Count For All Procedures: N``.
    """
    totals = report_totals(report)
    per_proc = report.select("procedure", "proc_ord").distinct()
    head = per_proc.select(
        "proc_ord", F.lit(0).alias("seq"), F.lit(0).alias("ord"),
        F.explode(F.array(F.concat(F.lit(REPORT_PROCEDURE_HEADER), F.col("procedure")),
                          F.lit(REPORT_COLUMN_HEADER))).alias("line"))
    head = head.withColumn(
        "ord", F.when(F.col("line").startswith(REPORT_PROCEDURE_HEADER), 0).otherwise(1))
    body = report.select(
        "proc_ord", F.lit(1).alias("seq"), "ord",
        F.concat_ws(",", "code", F.col("COUNT").cast("string"), "DESCRIPTION").alias("line"))
    tail = (totals.where(F.col("procedure").isNotNull()).join(per_proc, "procedure")
            .select("proc_ord", F.lit(2).alias("seq"), F.lit(0).alias("ord"),
                    F.explode(F.array(
                        F.concat(F.lit(REPORT_PROCEDURE_TOTAL),
                                 F.col("TOTAL").cast("string")),
                        F.lit(""))).alias("line")))
    tail = tail.withColumn("ord", F.when(F.col("line") == "", 1).otherwise(0))
    grand = (totals.where(F.col("procedure").isNull())
             .select(F.lit(None).cast("bigint").alias("proc_ord"), F.lit(3).alias("seq"),
                     F.lit(0).alias("ord"),
                     F.concat(F.lit(REPORT_GRAND_TOTAL),
                              F.coalesce(F.col("TOTAL"), F.lit(0)).cast("string")).alias("line")))
    return head.unionByName(body).unionByName(tail).unionByName(grand)
