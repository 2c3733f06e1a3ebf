"""Cohort selection: person filters and event-date bounds.

Every filter is a lazy DataFrame -> DataFrame function; ``build_cohort``
applies all requested filters together (they are ANDed) and returns a new
dataset.  Person-level existence tests are semi/anti joins on PERSON_ID
against a de-duplicated id set (partial aggregation shrinks it before the
shuffle, and the semi join never multiplies person rows).  The two that ask for
events also reduce repeated persons to one row, in the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.dataset import OmopDataset
from wardstat.schemas import EVENT_DATE_COLUMNS
from wardstat.specs import CohortSpec, as_date

# Gender source values of the person table.
MALE, FEMALE = "Male", "Female"


def filter_max_year_of_birth(person: DataFrame, year: int) -> DataFrame:
    return person.where(F.col("YEAR_OF_BIRTH") <= year)


def filter_min_year_of_birth(person: DataFrame, year: int) -> DataFrame:
    return person.where(F.col("YEAR_OF_BIRTH") >= year)


def exclude_gender(person: DataFrame, gender: str) -> DataFrame:
    """Drop persons of ``gender``; a null gender is dropped too (``!=``)."""
    return person.where(F.col("GENDER_SOURCE_VALUE") != gender)


def exclude_male(person: DataFrame) -> DataFrame:
    return exclude_gender(person, MALE)


def exclude_female(person: DataFrame) -> DataFrame:
    return exclude_gender(person, FEMALE)


def exclude_care_sites(person: DataFrame, sites: Sequence[int]) -> DataFrame:
    """Drop persons of the listed care sites; a null care site is kept."""
    c = F.col("CARE_SITE_ID")
    return person.where(~c.isin(list(sites)) | c.isNull())


def include_care_sites(person: DataFrame, sites: Sequence[int]) -> DataFrame:
    return person.where(F.col("CARE_SITE_ID").isin(list(sites)))


def filter_event_dates(ds: OmopDataset, start=None, end=None) -> OmopDataset:
    """Keep events starting on/after ``start`` and ending on/before ``end``
    in the six event tables that are present (a null end drops the row
    when ``end`` is set).  Bounds are dates or ``yyyyMMdd`` / ``yyyy-MM-dd``
    strings; blank or None means no bound."""
    start, end = as_date(start), as_date(end)
    changed = {}
    for table, (start_col, end_col) in EVENT_DATE_COLUMNS.items():
        if table not in ds:
            continue
        df = ds[table]
        if start is not None:
            df = df.where(F.col(start_col) >= F.lit(start))
        if end is not None:
            df = df.where(F.col(end_col) <= F.lit(end))
        changed[table] = df
    return ds.replace(**changed)


def _person_ids(df: DataFrame) -> DataFrame:
    return df.select("PERSON_ID").distinct()


def one_per_person(person: DataFrame) -> DataFrame:
    """One row per PERSON_ID: of a repeated person the row that is least by the other
    columns in their order (nulls first), the same in every run.  A null id is a
    person too."""
    rest = [c for c in person.columns if c != "PERSON_ID"]
    if not rest:
        return person.distinct()
    least = person.groupBy("PERSON_ID").agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[F.col(c) if c == "PERSON_ID" else F.col(f"_row.`{c}`")
                          for c in person.columns])


def with_visit(person: DataFrame, visits: DataFrame) -> DataFrame:
    """Persons with at least one visit, one row each."""
    return one_per_person(person.join(_person_ids(visits), "PERSON_ID", "left_semi"))


def inpatient_only(person: DataFrame, conditions: DataFrame, procedures: DataFrame,
                   condition_types: Sequence[int], procedure_types: Sequence[int]) -> DataFrame:
    """Persons with a primary-type condition or a primary-type procedure, one row each."""
    ids = (conditions.where(F.col("CONDITION_TYPE_CONCEPT_ID").isin(list(condition_types)))
           .select("PERSON_ID")
           .unionByName(procedures.where(F.col("PROCEDURE_TYPE_CONCEPT_ID")
                                         .isin(list(procedure_types))).select("PERSON_ID"))
           .distinct())
    return one_per_person(person.join(ids, "PERSON_ID", "left_semi"))


def exclude_dead(person: DataFrame, death: DataFrame) -> DataFrame:
    return person.join(_person_ids(death), "PERSON_ID", "left_anti")


def exclude_alive(person: DataFrame, death: DataFrame) -> DataFrame:
    return person.join(_person_ids(death), "PERSON_ID", "left_semi")


def cohort_person(ds: OmopDataset, spec: CohortSpec) -> DataFrame:
    """The person table after all person-level filters of ``spec``."""
    p = ds["person"]
    if spec.year_of_birth_max is not None:
        p = filter_max_year_of_birth(p, spec.year_of_birth_max)
    if spec.year_of_birth_min is not None:
        p = filter_min_year_of_birth(p, spec.year_of_birth_min)
    if spec.exclude_male:
        p = exclude_male(p)
    if spec.exclude_female:
        p = exclude_female(p)
    if spec.exclude_care_sites:
        p = exclude_care_sites(p, spec.exclude_care_sites)
    if spec.include_care_sites:
        p = include_care_sites(p, spec.include_care_sites)
    if spec.exclude_dead:
        p = exclude_dead(p, ds["death"])
    if spec.exclude_alive:
        p = exclude_alive(p, ds["death"])
    events = ds
    if spec.events_start_date is not None or spec.events_end_date is not None:
        events = filter_event_dates(ds, spec.events_start_date, spec.events_end_date)
    if spec.with_visit_only:
        p = with_visit(p, events["visit_occurrence"])
    if spec.inpatient_only:
        p = inpatient_only(p, events["condition_occurrence"], events["procedure_occurrence"],
                           spec.primary_condition_types, spec.primary_procedure_types)
    return p


def build_cohort(ds: OmopDataset, spec: CohortSpec) -> OmopDataset:
    """Dataset with the cohort's persons and date-bounded event tables.

    Event tables keep every person (person filters do not reach them); use
    ``restrict_to_persons`` to narrow them to the cohort.
    """
    out = ds
    if spec.events_start_date is not None or spec.events_end_date is not None:
        out = filter_event_dates(ds, spec.events_start_date, spec.events_end_date)
    return out.replace(person=cohort_person(ds, spec))


def restrict_to_persons(events: DataFrame, person: DataFrame) -> DataFrame:
    return events.join(_person_ids(person), "PERSON_ID", "left_semi")
