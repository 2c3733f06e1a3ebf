"""Registered queries: one per operator of the analysis, over the driver
tables presented as OMOP tables (``wardstat.sources.adapter``).

Every query reads the whole tables; ``wardstat.plans.oracle`` holds the
equivalent SQL for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.operators import codes as C
from wardstat.operators import cohort as K
from wardstat.operators.events import coded_events, filter_by_codes, inpatient_stays
from wardstat.operators.intervals import containment_join
from wardstat.operators.readmission import provider_event_count
from wardstat.plans import params as P
from wardstat.plans.file_queries import FILE_QUERIES
from wardstat.plans.scorecard import readmission_analysis
from wardstat.sources.adapter import load_code_descriptions, load_driver_dataset
from wardstat.sources.codes import CodeDictionary, dictionary_from_mapping
from wardstat.specs import CohortSpec

PERSON_COLS = ["PERSON_ID", "YEAR_OF_BIRTH", "GENDER_SOURCE_VALUE", "CARE_SITE_ID"]


def _ds(spark, sf_dir):
    """The driver tables as OMOP tables."""
    return load_driver_dataset(spark, sf_dir)


def _descriptions(spark, sf_dir):
    return load_code_descriptions(spark, sf_dir)


def _dicts(spark):
    return (dictionary_from_mapping(spark, P.DIAGNOSIS_CODES),
            dictionary_from_mapping(spark, P.COMPLICATION_CODES))


def _analysis(spark, sf_dir, spec=P.READMISSION, cohort_spec: CohortSpec | None = None):
    ds = _ds(spark, sf_dir)
    diag, compl = _dicts(spark)
    if cohort_spec is not None:
        ds = K.build_cohort(ds, cohort_spec)
    return readmission_analysis(ds, diag, compl, spec, ds["person"])


# --- cohort -----------------------------------------------------------------

def cohort_birth_year(spark, sf_dir):
    p = _ds(spark, sf_dir)["person"]
    p = K.filter_max_year_of_birth(p, P.BIRTH_YEAR_MAX)
    return K.filter_min_year_of_birth(p, P.BIRTH_YEAR_MIN).select(PERSON_COLS)


def cohort_exclude_male(spark, sf_dir):
    return K.exclude_male(_ds(spark, sf_dir)["person"]).select(PERSON_COLS)


def cohort_exclude_female(spark, sf_dir):
    return K.exclude_female(_ds(spark, sf_dir)["person"]).select(PERSON_COLS)


def cohort_exclude_sites(spark, sf_dir):
    return K.exclude_care_sites(_ds(spark, sf_dir)["person"], P.CARE_SITES).select(PERSON_COLS)


def cohort_include_sites(spark, sf_dir):
    return K.include_care_sites(_ds(spark, sf_dir)["person"], P.CARE_SITES).select(PERSON_COLS)


def _dated(spark, sf_dir):
    return K.filter_event_dates(_ds(spark, sf_dir), P.EVENTS_START, P.EVENTS_END)


def cohort_event_dates_condition(spark, sf_dir):
    return _dated(spark, sf_dir)["condition_occurrence"].select(
        "CONDITION_OCCURRENCE_ID", "PERSON_ID", "CONDITION_START_DATE", "CONDITION_END_DATE")


def cohort_event_dates_procedure(spark, sf_dir):
    return _dated(spark, sf_dir)["procedure_occurrence"].select(
        "PROCEDURE_OCCURRENCE_ID", "PERSON_ID", "PROCEDURE_DATE")


def cohort_event_dates_visit(spark, sf_dir):
    return _dated(spark, sf_dir)["visit_occurrence"].select(
        "VISIT_OCCURRENCE_ID", "PERSON_ID", "VISIT_START_DATE", "VISIT_END_DATE")


def cohort_with_visit(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return K.with_visit(ds["person"], ds["visit_occurrence"]).select(PERSON_COLS)


def cohort_inpatient_only(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return K.inpatient_only(ds["person"], ds["condition_occurrence"], ds["procedure_occurrence"],
                            P.READMISSION.primary_condition_types,
                            P.READMISSION.primary_procedure_types).select(PERSON_COLS)


def cohort_exclude_dead(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return K.exclude_dead(ds["person"], ds["death"]).select(PERSON_COLS)


def cohort_exclude_alive(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return K.exclude_alive(ds["person"], ds["death"]).select(PERSON_COLS)


def cohort_repeated_persons(spark, sf_dir):
    """Persons of whom a second row says another birth year and no care site: inpatients,
    one row each."""
    ds = _ds(spark, sf_dir)
    person = ds["person"].select(PERSON_COLS)
    again = person.withColumns({"YEAR_OF_BIRTH": F.col("YEAR_OF_BIRTH") + F.col("PERSON_ID") % 3 - 1,
                                "CARE_SITE_ID": F.lit(None).cast(person.schema["CARE_SITE_ID"].dataType)})
    return K.inpatient_only(person.unionByName(again), ds["condition_occurrence"],
                            ds["procedure_occurrence"], P.READMISSION.primary_condition_types,
                            P.READMISSION.primary_procedure_types).select(PERSON_COLS)


def cohort_full(spark, sf_dir):
    return K.build_cohort(_ds(spark, sf_dir), P.FULL_COHORT)["person"].select(PERSON_COLS)


# --- code statistics ----------------------------------------------------------

def condition_type_count(spark, sf_dir):
    return C.type_concept_count(_ds(spark, sf_dir)["condition_occurrence"], "condition")


def procedure_type_count(spark, sf_dir):
    return C.type_concept_count(_ds(spark, sf_dir)["procedure_occurrence"], "procedure")


def code_filter(spark, sf_dir):
    co = _ds(spark, sf_dir)["condition_occurrence"]
    return filter_by_codes(co, "CONDITION_SOURCE_VALUE", P.DIAGNOSIS_CODES["A"]).select(
        "CONDITION_OCCURRENCE_ID", "PERSON_ID", "CONDITION_SOURCE_VALUE")


def code_frequency(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return C.code_frequency(ds["condition_occurrence"], ds["procedure_occurrence"])


def code_frequency_primary(spark, sf_dir):
    ds = _ds(spark, sf_dir)
    return C.code_frequency(ds["condition_occurrence"], ds["procedure_occurrence"],
                            P.READMISSION.primary_condition_types,
                            P.READMISSION.primary_procedure_types)


def _report(spark, sf_dir, which: str, primary: bool):
    ds = _ds(spark, sf_dir)
    diag, compl = _dicts(spark)
    types = {}
    if primary:
        types = dict(condition_types=P.READMISSION.primary_condition_types,
                     procedure_types=P.READMISSION.primary_procedure_types)
    return C.code_report(diag if which == "diagnosis" else compl,
                         ds["condition_occurrence"], ds["procedure_occurrence"],
                         _descriptions(spark, sf_dir), **types)


def code_report_all(spark, sf_dir):
    return _report(spark, sf_dir, "diagnosis", False)


def code_report_sieved(spark, sf_dir):
    """The report by the way of a dictionary too large to broadcast: events are sieved
    by a Bloom filter of its codes, then joined by shuffles."""
    ds = _ds(spark, sf_dir)
    small = _dicts(spark)[0]
    large = CodeDictionary(small.df, small.n_entries, max_broadcast=0)
    return C.code_report(large, ds["condition_occurrence"], ds["procedure_occurrence"],
                         _descriptions(spark, sf_dir))


def code_report_primary(spark, sf_dir):
    return _report(spark, sf_dir, "diagnosis", True)


def complication_code_report_all(spark, sf_dir):
    return _report(spark, sf_dir, "complication", False)


def complication_code_report_primary(spark, sf_dir):
    return _report(spark, sf_dir, "complication", True)


def code_report_totals(spark, sf_dir):
    return C.report_totals(_report(spark, sf_dir, "diagnosis", False))


def code_report_lines(spark, sf_dir):
    return C.render_report(_report(spark, sf_dir, "diagnosis", True))


# --- stays, readmissions, scorecard --------------------------------------------

def _stays_of(spark, sf_dir, kind):
    ds = _ds(spark, sf_dir)
    diag, _ = _dicts(spark)
    table = "condition_occurrence" if kind == "condition" else "procedure_occurrence"
    types = (P.READMISSION.primary_condition_types if kind == "condition"
             else P.READMISSION.primary_procedure_types)
    ev = coded_events(ds[table], kind, diag, types)
    return inpatient_stays(ev, kind, ds["visit_occurrence"], "VISIT_END_DATE",
                           keys=["procedure"], bucket_days=P.READMISSION.visit_bucket_days)


def inpatient_stays_condition(spark, sf_dir):
    return _stays_of(spark, sf_dir, "condition")


def inpatient_stays_procedure(spark, sf_dir):
    return _stays_of(spark, sf_dir, "procedure")


def events_in_long_periods(spark, sf_dir):
    """Conditions inside the periods, years long, from a person's first visit to a
    group of providers to the last, counted by period."""
    ds = _ds(spark, sf_dir)
    group = F.coalesce(F.col("PROVIDER_ID") % 3, F.lit(3).cast("bigint"))
    periods = ds["visit_occurrence"].groupBy("PERSON_ID", group.alias("PROVIDERS")).agg(
        F.min("VISIT_START_DATE").alias("FROM_DATE"), F.max("VISIT_END_DATE").alias("TO_DATE"))
    events = ds["condition_occurrence"].select(
        "PERSON_ID", F.col("CONDITION_START_DATE").alias("EVENT_DATE"))
    return (containment_join(events, periods, ["PERSON_ID"], "EVENT_DATE", "FROM_DATE", "TO_DATE",
                             P.READMISSION.visit_bucket_days)
            .groupBy("PERSON_ID", "PROVIDERS", "FROM_DATE", "TO_DATE")
            .agg(F.count(F.lit(1)).alias("EVENTS")))


def index_stays(spark, sf_dir):
    return _analysis(spark, sf_dir, P.READMISSION).index_stays


def complication_stays(spark, sf_dir):
    return _analysis(spark, sf_dir, P.READMISSION).complication_stays


def readmissions(spark, sf_dir):
    return _analysis(spark, sf_dir).readmissions


def deaths_after_stay(spark, sf_dir):
    return _analysis(spark, sf_dir, P.READMISSION).deaths


def provider_event_count_q(spark, sf_dir):
    return provider_event_count(_analysis(spark, sf_dir, P.READMISSION).index_stays)


def provider_scorecard(spark, sf_dir):
    return _analysis(spark, sf_dir).scorecard


def provider_scorecard_cohort_only(spark, sf_dir):
    return _analysis(spark, sf_dir, P.READMISSION_COHORT_ONLY, P.FULL_COHORT).scorecard


def provider_scorecard_after_discharge(spark, sf_dir):
    return _analysis(spark, sf_dir, P.READMISSION_AFTER_DISCHARGE).scorecard


def readmission_code_count(spark, sf_dir):
    return C.readmission_code_count(_analysis(spark, sf_dir).readmissions)


def readmission_code_report(spark, sf_dir):
    _, compl = _dicts(spark)
    return C.readmission_code_report(compl, _analysis(spark, sf_dir).readmissions,
                                     _descriptions(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cohort_birth_year": cohort_birth_year,
    "cohort_exclude_male": cohort_exclude_male,
    "cohort_exclude_female": cohort_exclude_female,
    "cohort_exclude_sites": cohort_exclude_sites,
    "cohort_include_sites": cohort_include_sites,
    "cohort_event_dates_condition": cohort_event_dates_condition,
    "cohort_event_dates_procedure": cohort_event_dates_procedure,
    "cohort_event_dates_visit": cohort_event_dates_visit,
    "cohort_with_visit": cohort_with_visit,
    "cohort_inpatient_only": cohort_inpatient_only,
    "cohort_exclude_dead": cohort_exclude_dead,
    "cohort_exclude_alive": cohort_exclude_alive,
    "cohort_repeated_persons": cohort_repeated_persons,
    "cohort_full": cohort_full,
    "condition_type_count": condition_type_count,
    "procedure_type_count": procedure_type_count,
    "code_filter": code_filter,
    "code_frequency": code_frequency,
    "code_frequency_primary": code_frequency_primary,
    "code_report_all": code_report_all,
    "code_report_sieved": code_report_sieved,
    "code_report_primary": code_report_primary,
    "complication_code_report_all": complication_code_report_all,
    "complication_code_report_primary": complication_code_report_primary,
    "code_report_totals": code_report_totals,
    "code_report_lines": code_report_lines,
    "inpatient_stays_condition": inpatient_stays_condition,
    "inpatient_stays_procedure": inpatient_stays_procedure,
    "events_in_long_periods": events_in_long_periods,
    "index_stays": index_stays,
    "complication_stays": complication_stays,
    "readmissions": readmissions,
    "deaths_after_stay": deaths_after_stay,
    "provider_event_count": provider_event_count_q,
    "provider_scorecard": provider_scorecard,
    "provider_scorecard_cohort_only": provider_scorecard_cohort_only,
    "provider_scorecard_after_discharge": provider_scorecard_after_discharge,
    "readmission_code_count": readmission_code_count,
    "readmission_code_report": readmission_code_report,
    **FILE_QUERIES,
}
