"""End-to-end expectations on the micro fixture (loaded from CSV files)."""

import datetime as dt

import pytest

from tests import micro
from wardstat.operators import codes as C
from wardstat.operators import cohort as K
from wardstat.plans.scorecard import readmission_analysis
from wardstat.sources.codes import dictionary_from_mapping
from wardstat.sources.tables import load_directory
from wardstat.specs import CohortSpec, ReadmissionSpec

D = dt.date


@pytest.fixture(scope="module")
def ds(spark, tmp_path_factory):
    folder = micro.write_fixture(str(tmp_path_factory.mktemp("micro")))
    return load_directory(spark, folder)


@pytest.fixture(scope="module")
def dicts(spark):
    return (dictionary_from_mapping(spark, micro.DIAGNOSIS),
            dictionary_from_mapping(spark, micro.COMPLICATIONS))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_directory_skips_unknown_files(ds):
    assert sorted(ds) == ["condition_occurrence", "death", "person",
                          "procedure_occurrence", "visit_occurrence"]


def test_dev_type_lists(ds, dicts):
    spec = ReadmissionSpec(30, micro.DEV_CONDITION_TYPES, micro.DEV_PROCEDURE_TYPES)
    res = readmission_analysis(ds, *dicts, spec)
    assert rows(res.index_stays, "procedure", "PERSON_ID", "VISIT_END_DATE", "PROVIDER_ID",
                "SOURCE_VALUE") == [
        ("81.54", 1, D(2008, 9, 16), 23861, "7140"),
        ("81.54", 3, D(2009, 3, 30), 29084, "71696"),
    ]
    assert rows(res.complication_stays, "procedure", "PERSON_ID", "VISIT_START_DATE",
                "PROVIDER_ID", "SOURCE_VALUE") == [
        ("81.07", 1, D(2008, 9, 18), 23861, "0389"),
        ("81.07", 3, D(2009, 4, 15), 29084, "0389"),
        ("81.54", 1, D(2008, 9, 18), 23861, "0389"),
        ("81.54", 3, D(2009, 4, 15), 29084, "0389"),
    ]
    assert rows(res.readmissions, "procedure", "PERSON_ID", "VISIT_END_DATE", "PROVIDER_ID",
                "SOURCE_VALUE") == [
        ("81.54", 1, D(2008, 9, 16), 23861, "0389"),
        ("81.54", 3, D(2009, 3, 30), 29084, "0389"),
    ]
    assert res.deaths.count() == 0
    assert rows(res.scorecard, "procedure", "PROVIDER_ID", "PROCEDURE_COUNT",
                "READMISSION_COUNT", "DEATH_COUNT", "COMPLICATION_COUNT", "PERCENTAGE") == [
        ("81.54", 23861, 1, 1, 0, 1, 1.0),
        ("81.54", 29084, 1, 1, 0, 1, 1.0),
    ]


def test_micro_type_lists_give_nothing(ds, dicts):
    spec = ReadmissionSpec(30, micro.MICRO_CONDITION_TYPES, micro.MICRO_PROCEDURE_TYPES)
    res = readmission_analysis(ds, *dicts, spec)
    assert res.index_stays.count() == 0
    assert res.scorecard.count() == 0


def test_type_concept_counts(ds):
    assert rows(C.type_concept_count(ds["condition_occurrence"], "condition"),
                "CONDITION_TYPE_CONCEPT_ID", "COUNT") == [
        (38000200, 9), (38000201, 1), (45756836, 1)]
    assert rows(C.type_concept_count(ds["procedure_occurrence"], "procedure"),
                "PROCEDURE_TYPE_CONCEPT_ID", "COUNT") == [(45756900, 6), (45756905, 1)]


def test_code_frequency(ds):
    got = {r["SOURCE_VALUE"]: (r["COUNT_CO"], r["COUNT_PO"], r["COUNT"]) for r in
           C.code_frequency(ds["condition_occurrence"], ds["procedure_occurrence"]).collect()}
    assert got == {
        "0389": (2, 0, 2), "72402": (1, 0, 1), "71696": (1, 0, 1), "7140": (1, 0, 1),
        "82002": (3, 0, 3), "71856": (1, 0, 1), "20063": (2, 0, 2),
        "74000": (0, 4, 4), "00740": (0, 3, 3),
    }


def test_inpatient_only_persons(ds):
    spec = CohortSpec(inpatient_only=True, primary_condition_types=micro.DEV_CONDITION_TYPES,
                      primary_procedure_types=micro.DEV_PROCEDURE_TYPES)
    assert rows(K.build_cohort(ds, spec)["person"], "PERSON_ID") == [(1,), (2,), (3,)]
    spec = CohortSpec(inpatient_only=True, primary_condition_types=micro.MICRO_CONDITION_TYPES,
                      primary_procedure_types=micro.MICRO_PROCEDURE_TYPES)
    assert K.build_cohort(ds, spec)["person"].count() == 0


def test_dead_and_alive(ds):
    assert rows(K.build_cohort(ds, CohortSpec(exclude_dead=True))["person"], "PERSON_ID") == [
        (1,), (3,)]
    assert rows(K.build_cohort(ds, CohortSpec(exclude_alive=True))["person"], "PERSON_ID") == [
        (2,)]


def test_code_report_on_fixture(ds, dicts):
    diag, _ = dicts
    rep = C.code_report(diag, ds["condition_occurrence"], ds["procedure_occurrence"])
    got = {(r["procedure"], r["code"]): r["COUNT"] for r in rep.collect()}
    assert got[("81.54", "7140")] == 1 and got[("81.54", "71696")] == 1
    assert got[("81.07", "72402")] == 1 and got[("81.07", "7384")] == 0
    totals = {r["procedure"]: r["TOTAL"] for r in C.report_totals(rep).collect()}
    assert totals == {"81.07": 1, "81.54": 2, None: 3}
