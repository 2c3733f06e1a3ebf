"""Parameters of the analysis.

``CohortSpec`` selects patients and bounds events in time;
``ReadmissionSpec`` configures the index-stay / readmission search.
Blank or ``None`` means "no filter" for every optional field.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# OMOP type concepts marking a primary inpatient diagnosis / procedure.
# The defaults of the analysis (condition, procedure).
PRIMARY_CONDITION_TYPES = (38000199, 38000200)
PRIMARY_PROCEDURE_TYPES = (38000250, 38000251)


def as_date(v) -> dt.date | None:
    if v is None or v == "":
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    s = str(v).strip()
    fmt = "%Y%m%d" if len(s) == 8 and s.isdigit() else "%Y-%m-%d"
    return dt.datetime.strptime(s, fmt).date()


def _as_int_list(v) -> tuple[int, ...]:
    if v is None or v == "":
        return ()
    if isinstance(v, str):
        return tuple(int(x) for x in v.split(",") if x.strip())
    return tuple(int(x) for x in v)


def _as_int(v) -> int | None:
    if v is None or (isinstance(v, str) and not v.strip()):
        return None
    return int(v)


@dataclass(frozen=True)
class CohortSpec:
    year_of_birth_min: int | None = None
    year_of_birth_max: int | None = None
    events_start_date: dt.date | None = None
    events_end_date: dt.date | None = None
    exclude_male: bool = False
    exclude_female: bool = False
    exclude_dead: bool = False
    exclude_alive: bool = False
    exclude_care_sites: tuple[int, ...] = ()
    include_care_sites: tuple[int, ...] = ()
    with_visit_only: bool = False
    inpatient_only: bool = False
    primary_condition_types: tuple[int, ...] = PRIMARY_CONDITION_TYPES
    primary_procedure_types: tuple[int, ...] = PRIMARY_PROCEDURE_TYPES

    def __post_init__(self):
        set_ = object.__setattr__
        set_(self, "year_of_birth_min", _as_int(self.year_of_birth_min))
        set_(self, "year_of_birth_max", _as_int(self.year_of_birth_max))
        set_(self, "events_start_date", as_date(self.events_start_date))
        set_(self, "events_end_date", as_date(self.events_end_date))
        set_(self, "exclude_care_sites", _as_int_list(self.exclude_care_sites))
        set_(self, "include_care_sites", _as_int_list(self.include_care_sites))
        set_(self, "primary_condition_types", _as_int_list(self.primary_condition_types))
        set_(self, "primary_procedure_types", _as_int_list(self.primary_procedure_types))
        if self.exclude_care_sites and self.include_care_sites:
            raise ValueError("exclude_care_sites and include_care_sites are mutually exclusive")
        if self.exclude_dead and self.exclude_alive:
            raise ValueError("exclude_dead and exclude_alive together select nobody")


@dataclass(frozen=True)
class ReadmissionSpec:
    readmission_days: int = 30
    primary_condition_types: tuple[int, ...] = PRIMARY_CONDITION_TYPES
    primary_procedure_types: tuple[int, ...] = PRIMARY_PROCEDURE_TYPES
    # Person filters of a cohort do not reach the scorecard unless asked.
    restrict_events_to_cohort: bool = False
    # A death dated before discharge still counts unless asked otherwise.
    death_after_discharge_only: bool = False
    # Width of the day buckets the range joins are keyed on.
    visit_bucket_days: int = 28
    # How the placed stays shared by the scorecard's consumers are kept:
    # "persist" (memory and disk, recomputed from lineage if an executor is
    # lost), "checkpoint" (written to spark.checkpoint.dir, lineage cut) or
    # "none" (recomputed by every consumer).
    materialize: str = "persist"
    # Collapse repeated visit spans before the range join (see visit_spans).
    dedupe_visits: bool = True

    def __post_init__(self):
        set_ = object.__setattr__
        set_(self, "primary_condition_types", _as_int_list(self.primary_condition_types))
        set_(self, "primary_procedure_types", _as_int_list(self.primary_procedure_types))
        set_(self, "readmission_days", int(self.readmission_days))
        if self.materialize not in ("persist", "checkpoint", "none"):
            raise ValueError(f"unknown materialize mode {self.materialize!r}")
        if self.visit_bucket_days < 1:
            raise ValueError("visit_bucket_days must be >= 1")
