"""Parameters of the registered queries over the driver tables.

The code dictionaries play the role of the diagnosis / complication
property files: part brands of the driver data act as medical codes.  They
exercise overlapping lists (``Brand#3`` in A and B), a repeated code
(``Brand#12`` twice in A), a procedure without complication list (C, skipped
by the scorecard) and a complication list without diagnosis list (D).
"""

from __future__ import annotations

import datetime as dt

from wardstat.specs import CohortSpec, ReadmissionSpec

DIAGNOSIS_CODES: dict[str, list[str]] = {
    "A": ["Brand#1", "Brand#2", "Brand#3"],
    "B": ["Brand#3", "Brand#4", "Brand#5", "Brand#6"],
    "C": ["Brand#7", "Brand#8"],
}
COMPLICATION_CODES: dict[str, list[str]] = {
    "A": ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15", "Brand#12"],
    "B": ["Brand#14", "Brand#15", "Brand#16", "Brand#17", "Brand#18", "Brand#19"],
    "D": ["Brand#20", "Brand#21"],
}

BIRTH_YEAR_MIN, BIRTH_YEAR_MAX = 1940, 1970
CARE_SITES = (1, 2, 3, 7, 11)
EVENTS_START = dt.date(1996, 1, 1)
EVENTS_END = dt.date(1999, 12, 31)
STREAM_START, STREAM_END = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
READMISSION_DAYS = 30

FULL_COHORT = CohortSpec(
    year_of_birth_min=1930, year_of_birth_max=1980,
    events_start_date=EVENTS_START, events_end_date=dt.date(2000, 12, 31),
    exclude_male=True, exclude_care_sites=(3, 7), exclude_dead=True,
    with_visit_only=True, inpatient_only=True,
)

# A registered query is one lazy plan: it persists nothing that would stay
# behind and change the plans of later queries.
READMISSION = ReadmissionSpec(readmission_days=READMISSION_DAYS, materialize="none")
READMISSION_COHORT_ONLY = ReadmissionSpec(readmission_days=READMISSION_DAYS, materialize="none",
                                          restrict_events_to_cohort=True)
READMISSION_AFTER_DISCHARGE = ReadmissionSpec(readmission_days=READMISSION_DAYS, materialize="none",
                                              death_after_discharge_only=True)
