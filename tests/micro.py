"""The hand-made micro fixture (rows that matter), as CSV text with the
layout's header names, plus the code lists the expectations use."""

from __future__ import annotations

import os

CONDITION = """PERSON_ID,CONDITION_START_DATE,CONDITION_END_DATE,CONDITION_TYPE_CONCEPT_ID,CONDITION_SOURCE_VALUE
1,20080908,20080908,38000200,7140
1,20100705,20100705,38000200,82002
1,20080918,20080918,38000201,71856
1,20080919,20080919,38000200,0389
2,20090510,20090510,38000200,20063
2,20100217,20100217,38000200,20063
2,20080509,20080509,45756836,82002
2,20100116,20100116,38000200,82002
3,20080112,20080112,38000200,72402
3,20090319,20090319,38000200,71696
3,20090420,20090420,38000200,0389
"""

PROCEDURE = """PERSON_ID,PROCEDURE_DATE,PROCEDURE_TYPE_CONCEPT_ID,PROCEDURE_SOURCE_VALUE
1,20090905,45756900,74000
1,20090812,45756900,00740
1,20080620,45756900,00740
2,20091220,45756900,00740
2,20090620,45756905,74000
3,20080324,45756900,74000
3,20080124,45756900,74000
"""

VISIT = """VISIT_OCCURRENCE_ID,PERSON_ID,VISIT_START_DATE,VISIT_END_DATE,PROVIDER_ID
182,1,20080908,20080916,23861
362,1,20080506,20080507,18442
183,1,20080918,20080922,23861
2,2,20090509,20090514,18025
542,2,20090916,20090924,21217
722,2,20090319,20090330,29084
724,3,20090319,20090330,29084
724,3,20090415,20090420,29084
"""

PERSON = """PERSON_ID,YEAR_OF_BIRTH,GENDER_SOURCE_VALUE,CARE_SITE_ID
1,1957,Female,
2,1934,Female,
3,1942,Male,
"""

DEATH = """PERSON_ID,DEATH_DATE
2,20090301
"""

# Two procedures' principal diagnosis codes as published for
# the analysis, and a complication list holding the fixture's complication.
DIAGNOSIS = {
    "81.07": ["72402", "7384", "72252", "7213", "72210", "72403", "75612", "73730", "72283"],
    "81.54": ["71536", "71596", "71516", "71696", "7140", "71589", "71526"],
}
COMPLICATIONS = {
    "81.07": ["0389", "99859"],
    "81.54": ["0389", "99859", "9974"],
}

DEV_CONDITION_TYPES = (38000199, 38000200)
DEV_PROCEDURE_TYPES = (38000250, 38000251)
MICRO_CONDITION_TYPES = (38000199,)
MICRO_PROCEDURE_TYPES = (38000250,)


def write_fixture(folder: str) -> str:
    files = {"condition_occurrence.csv": CONDITION, "procedure_occurrence.csv": PROCEDURE,
             "visit_occurrence.csv": VISIT, "person.csv": PERSON, "death.csv": DEATH,
             "notes.txt": "not a table\n", "unknown_table.csv": "A,B\n1,2\n"}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return folder
