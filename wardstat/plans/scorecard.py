"""The readmission analysis as one Spark plan, and the batch run that
writes its outputs.

``readmission_analysis`` returns lazy DataFrames and keeps nothing, unless it is
given a ``Workspace`` to own what it materialises.  ``run`` is the batch entry
point: it reads each file table once, computes the type-concept counts, the
cohort, the scorecard and the five code reports, and writes them under one
output folder; whatever it keeps meanwhile is gone when it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardstat.dataset import OmopDataset
from wardstat.operators import codes as C
from wardstat.operators.cohort import build_cohort
from wardstat.operators.events import index_and_complication_stays
from wardstat.operators.readmission import (deaths_after_stay, provider_scorecard,
                                            readmissions)
from wardstat.session import ensure_checkpoint_dir
from wardstat.sinks.files import (write_csv, write_partitioned_csv, write_report_text,
                                  write_single_csv, write_tables)
from wardstat.sources.codes import CodeDictionary
from wardstat.sources.staging import observe_malformed, stage_tables
from wardstat.specs import CohortSpec, ReadmissionSpec
from wardstat.workspace import Workspace

#: Columns of the tables that a run reads.
RUN_COLUMNS = {
    "person": ("PERSON_ID", "YEAR_OF_BIRTH", "GENDER_SOURCE_VALUE", "CARE_SITE_ID"),
    "visit_occurrence": ("PERSON_ID", "VISIT_START_DATE", "VISIT_END_DATE", "PROVIDER_ID"),
    "condition_occurrence": ("PERSON_ID", "CONDITION_START_DATE", "CONDITION_END_DATE",
                             "CONDITION_TYPE_CONCEPT_ID", "CONDITION_SOURCE_VALUE"),
    "procedure_occurrence": ("PERSON_ID", "PROCEDURE_DATE", "PROCEDURE_TYPE_CONCEPT_ID",
                             "PROCEDURE_SOURCE_VALUE"),
    "death": ("PERSON_ID", "DEATH_DATE"),
}


@dataclass(frozen=True)
class ReadmissionResult:
    index_stays: DataFrame
    complication_stays: DataFrame
    readmissions: DataFrame
    deaths: DataFrame
    scorecard: DataFrame


def readmission_analysis(ds: OmopDataset, diagnosis: CodeDictionary,
                         complications: CodeDictionary,
                         spec: ReadmissionSpec = ReadmissionSpec(),
                         cohort_person: DataFrame | None = None,
                         workspace: Workspace | None = None) -> ReadmissionResult:
    """Index stays, complication stays, readmissions, deaths and the provider
    scorecard for every procedure that has both a diagnosis and a
    complication list (others are skipped).  With a ``workspace`` the stays
    they share are kept there as ``spec.materialize`` says."""
    conditions = ds["condition_occurrence"]
    procedures = ds["procedure_occurrence"]
    persons = None
    if spec.restrict_events_to_cohort:
        persons = cohort_person if cohort_person is not None else ds["person"]
    # Only procedures with both lists are analysed.
    diag = diagnosis.restrict_to(complications)
    compl_codes = complications.restrict_to(diagnosis)
    index, compl = index_and_complication_stays(
        conditions, procedures, ds["visit_occurrence"], diag, compl_codes,
        spec.primary_condition_types, spec.primary_procedure_types,
        spec.visit_bucket_days, spec.materialize, spec.dedupe_visits, persons, workspace)
    readm = readmissions(index, compl, spec.readmission_days)
    deaths = deaths_after_stay(index, ds["death"], spec.readmission_days,
                               spec.death_after_discharge_only)
    card = provider_scorecard(index, readm, deaths)
    return ReadmissionResult(index, compl, readm, deaths, card)


def run(ds: OmopDataset, diagnosis: CodeDictionary, complications: CodeDictionary,
        out_dir: str, cohort_spec: CohortSpec = CohortSpec(),
        spec: ReadmissionSpec = ReadmissionSpec(materialize="checkpoint"),
        descriptions: DataFrame | None = None, mode: str = "errorifexists",
        extract_dir: str | None = None, extract_codec: str | None = None,
        extract_date_format: str = "%Y%m%d") -> dict:
    """Batch run: writes every output under ``out_dir`` and returns the number of
    persons in the cohort and of the malformed rows by table.

    Each file table is parsed once: its good rows go to a Parquet table in the
    run's workspace (the columns that are needed), and the same pass counts the
    malformed ones.  By default the shared stays are written there too, so a lost
    executor late in the run does not recompute the event scans.  The workspace is
    removed at the end, also after a failure.

    With ``extract_dir`` the cohort's tables are also written there as CSV
    (``extract_codec``, dates in ``extract_date_format``), and the cohort
    size is observed during that write instead of costing a separate pass."""
    out = out_dir.rstrip("/")
    spark = ds["person"].sparkSession
    # What can fail for its settings fails before anything is written.
    ensure_checkpoint_dir(spark)
    with Workspace(spark, "run") as work:
        return _run(ds, diagnosis, complications, out, cohort_spec, spec, descriptions, mode,
                    extract_dir, extract_codec, extract_date_format, work)


def _run(ds, diagnosis, complications, out, cohort_spec, spec, descriptions, mode, extract_dir,
         extract_codec, extract_date_format, work: Workspace) -> dict:
    ds, malformed = stage_tables(ds, RUN_COLUMNS, work, whole=extract_dir is not None)
    for kind in ("condition", "procedure"):
        write_single_csv(C.type_concept_count(ds[f"{kind}_occurrence"], kind)
                         .orderBy(F.desc("COUNT")), f"{out}/{kind}_type_concept_count", mode=mode)

    # The cohort size is part of the run's report.
    if extract_dir is not None:
        ds, counted = observe_malformed(ds, [t for t in ds if t not in malformed])
        cohort = build_cohort(ds, cohort_spec)
        seen = Observation("cohort")
        observed = cohort["person"].observe(seen, F.count(F.lit(1)).alias("persons"))
        write_tables(cohort.replace(person=observed), extract_dir, extract_codec, mode=mode,
                     date_format=extract_date_format)
        n_persons = seen.get["persons"]
        malformed.update(counted())
    else:
        cohort = build_cohort(ds, cohort_spec)
        n_persons = cohort["person"].count()

    res = readmission_analysis(cohort, diagnosis, complications, spec, cohort["person"], work)
    # The window join runs once: the scorecard, the list and the report of
    # readmissions all read its rows.
    readm = work.persisted(res.readmissions)
    card = work.persisted(provider_scorecard(res.index_stays, readm, res.deaths))
    analysed = diagnosis.restrict_to(complications).df.select("procedure")
    write_partitioned_csv(card, f"{out}/scorecard", "procedure", mode=mode, keys=analysed,
                          order=[F.desc("PROCEDURE_COUNT"), "PROVIDER_ID"])
    # in order, so the files do not depend on how the dictionaries were joined
    write_csv(readm.repartitionByRange(*readm.columns).sortWithinPartitions(*readm.columns),
              f"{out}/readmissions", mode=mode)

    # One pass over the event tables counts every listed code, for all types
    # and for primary types; the four code reports are small joins on it.
    counts = work.persisted(C.code_counts(
        cohort["condition_occurrence"], cohort["procedure_occurrence"],
        [diagnosis, complications], spec.primary_condition_types,
        spec.primary_procedure_types))
    reports = {
        "procedure_count_all": C.code_report_from_counts(diagnosis, counts, descriptions),
        "procedure_count_primary": C.code_report_from_counts(
            diagnosis, counts, descriptions, primary=True),
        "readmission_count_all": C.code_report_from_counts(
            complications, counts, descriptions),
        "readmission_count_primary": C.code_report_from_counts(
            complications, counts, descriptions, primary=True),
        "readmission_event_code_count": C.readmission_code_report(
            complications, readm, descriptions),
    }
    for name, rep in reports.items():
        # a report is a row per dictionary entry; rendering reads it several times
        write_report_text(C.render_report(work.persisted(rep)), f"{out}/{name}", mode=mode)
    return {"persons": n_persons, "malformed": malformed}
