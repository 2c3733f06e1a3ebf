"""Coded events and the hospital stays they fall into.

* ``event_view``          — uniform (PERSON_ID, EVENT_DATE, TYPE_CONCEPT_ID,
                            SOURCE_VALUE) projection of conditions or procedures.
* ``coded_events``        — events whose code is in a procedure's list (adds
                            ``procedure``), optionally primary-type only.
* ``place_in_visits``     — events inside a visit of the same person
                            (start and end day inclusive).
* ``inpatient_stays``     — distinct (person, visit date, provider, code) of
                            events placed in visits, for one event table.
* ``index_and_complication_stays`` — index stays (diagnosis codes, both
                            event tables, visit end) and complication stays
                            (complication codes, conditions, visit start) of
                            every procedure, from ONE join against the visits.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators.intervals import containment_join
from wardstat.sources.codes import CodeDictionary, narrowed
from wardstat.workspace import Workspace

# kind -> (event date, type concept, source value) columns
EVENT_COLUMNS = {
    "condition": ("CONDITION_START_DATE", "CONDITION_TYPE_CONCEPT_ID", "CONDITION_SOURCE_VALUE"),
    "procedure": ("PROCEDURE_DATE", "PROCEDURE_TYPE_CONCEPT_ID", "PROCEDURE_SOURCE_VALUE"),
}

STAY_COLUMNS = ["VISIT_START_DATE", "VISIT_END_DATE", "PROVIDER_ID"]


def event_view(events: DataFrame, kind: str) -> DataFrame:
    date_col, type_col, code_col = EVENT_COLUMNS[kind]
    return events.select(
        "PERSON_ID",
        F.col(date_col).alias("EVENT_DATE"),
        F.col(type_col).alias("TYPE_CONCEPT_ID"),
        F.col(code_col).alias("SOURCE_VALUE"),
    )


def filter_by_codes(df: DataFrame, column: str, codes: Sequence) -> DataFrame:
    """Rows whose ``column`` is in a short literal list (IN, pushed to scans)."""
    return df.where(F.col(column).isin(list(codes)))


def coded_events(events: DataFrame, kind: str, dictionary: CodeDictionary,
                 type_concepts: Sequence[int] | None = None) -> DataFrame:
    """(procedure, PERSON_ID, EVENT_DATE, SOURCE_VALUE) of events whose code
    is listed for ``procedure``; an event listed for two procedures appears
    once per procedure.  The dictionary side is size-checked and broadcast."""
    ev = event_view(events, kind)
    if type_concepts is not None:
        ev = filter_by_codes(ev, "TYPE_CONCEPT_ID", type_concepts)
    ev = narrowed(ev, "SOURCE_VALUE", [dictionary])
    pairs = dictionary.pairs().withColumnRenamed("code", "SOURCE_VALUE")
    return ev.join(pairs, "SOURCE_VALUE").select(
        "procedure", "PERSON_ID", "EVENT_DATE", "SOURCE_VALUE")


def visit_spans(visits: DataFrame, dedupe: bool = True) -> DataFrame:
    """(PERSON_ID, VISIT_START_DATE, VISIT_END_DATE, PROVIDER_ID); visit ids
    are not used (they are not unique in practice).

    With ``dedupe`` repeated spans are collapsed before the range join.  The
    partial aggregation runs map-side, so a person holding a large share
    of (repeated) visit rows reaches the join with distinct spans only and
    the pairs compared per (person, bucket) stay bounded.  Without it the
    duplicates are only removed after the join."""
    spans = visits.select("PERSON_ID", *STAY_COLUMNS)
    return spans.distinct() if dedupe else spans


def place_in_visits(points: DataFrame, visits: DataFrame, bucket_days: int = 28,
                    dedupe_visits: bool = True) -> DataFrame:
    """Events (any columns + PERSON_ID, EVENT_DATE) joined to every visit of
    the same person with VISIT_START_DATE <= EVENT_DATE <= VISIT_END_DATE."""
    return containment_join(points, visit_spans(visits, dedupe_visits), ["PERSON_ID"],
                            "EVENT_DATE", "VISIT_START_DATE", "VISIT_END_DATE",
                            bucket_days)


def inpatient_stays(events: DataFrame, kind: str, visits: DataFrame,
                    visit_date: str = "VISIT_END_DATE",
                    keys: Sequence[str] = (), bucket_days: int = 28) -> DataFrame:
    """Distinct (keys..., PERSON_ID, <visit_date>, PROVIDER_ID, SOURCE_VALUE)
    for events of one table that fall in a visit.  ``events`` is either a raw
    event table (``keys`` empty) or the output of ``coded_events``."""
    if "EVENT_DATE" not in events.columns:
        events = event_view(events, kind)
    pts = events.select(*keys, "PERSON_ID", "EVENT_DATE", "SOURCE_VALUE").distinct()
    placed = place_in_visits(pts, visits, bucket_days)
    return placed.select(*keys, "PERSON_ID", visit_date, "PROVIDER_ID", "SOURCE_VALUE").distinct()


class Stays(NamedTuple):
    index: DataFrame
    complications: DataFrame


def index_and_complication_stays(
        conditions: DataFrame, procedures: DataFrame, visits: DataFrame,
        diagnosis: CodeDictionary, complications: CodeDictionary,
        condition_types: Sequence[int], procedure_types: Sequence[int],
        bucket_days: int = 28, materialize: str = "persist",
        dedupe_visits: bool = True, persons: DataFrame | None = None,
        workspace: Workspace | None = None) -> "Stays":
    """Index stays and complication stays of every procedure.

    Index stays: (procedure, branch, PERSON_ID, VISIT_END_DATE, PROVIDER_ID,
    SOURCE_VALUE), distinct per branch (``C`` conditions, ``P`` procedures)
    and then concatenated, so a stay found through both tables counts twice.
    Complication stays: (procedure, PERSON_ID, VISIT_START_DATE, PROVIDER_ID,
    SOURCE_VALUE) from conditions only.  With ``persons`` only events of
    those persons are used.

    All three event sets are tagged and placed in visits by a single join,
    so the visit table is scanned and shuffled once.  With a ``workspace`` the
    de-duplicated placements are materialised once, as ``materialize`` says:
    index stays feed the provider counts, the readmission join and the death
    join, and complication stays come from the same placements.  ``persist``
    keeps them in memory and on disk (lost blocks are recomputed from
    lineage); ``checkpoint`` writes them to the session's checkpoint folder
    and cuts the lineage, so a lost executor costs only a re-read.  The
    workspace owns them; without one the plan stays lazy and nothing is kept.
    """
    def coded(df, kind, types, pairs, *lists):
        ev = filter_by_codes(event_view(df, kind), "TYPE_CONCEPT_ID", types)
        ev = narrowed(ev, "SOURCE_VALUE", lists)
        return ev.join(pairs.withColumnRenamed("code", "SOURCE_VALUE"), "SOURCE_VALUE").select(
            "procedure", "branch", "PERSON_ID", "EVENT_DATE", "SOURCE_VALUE")

    # Conditions are read once for both lists: each event is routed to every
    # (procedure, list) it belongs to by one broadcast join.
    cond = coded(conditions, "condition", condition_types,
                 diagnosis.tagged_pairs("C", complications, "X"), diagnosis, complications)
    proc = coded(procedures, "procedure", procedure_types, diagnosis.tagged_pairs("P"), diagnosis)
    points = cond.unionByName(proc).distinct()
    if persons is not None:
        # Restricting to a cohort after the code filter shuffles only the
        # coded events, never the whole event tables.
        points = points.join(persons.select("PERSON_ID").distinct(), "PERSON_ID", "left_semi")
    placed = (place_in_visits(points, visits, bucket_days, dedupe_visits)
              .select("procedure", "branch", "PERSON_ID", "VISIT_START_DATE", "VISIT_END_DATE",
                      "PROVIDER_ID", "SOURCE_VALUE")
              .distinct())
    if workspace is not None:
        placed = workspace.kept(placed, "placed", materialize)
    index = (placed.where(F.col("branch") != "X")
             .select("procedure", "branch", "PERSON_ID", "VISIT_END_DATE",
                     "PROVIDER_ID", "SOURCE_VALUE")
             .distinct())
    compl = (placed.where(F.col("branch") == "X")
             .select("procedure", "PERSON_ID", "VISIT_START_DATE",
                     "PROVIDER_ID", "SOURCE_VALUE")
             .distinct())
    return Stays(index, compl)
