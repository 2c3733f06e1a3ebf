"""Batch entry point.

    spark-submit --conf spark.checkpoint.dir=hdfs:///tmp/ckpt \\
        -m wardstat --data hdfs:///omop --diagnosis diag.properties \\
        --complications readmission.properties --out hdfs:///results/run1 \\
        --inpatient-only --birth-year-min 1900 --birth-year-max 1990

(or ``python -m wardstat ...`` locally).  The session is taken with
``getOrCreate()``, so master, memory and shuffle settings come from the
launcher.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from wardstat.plans.scorecard import run
from wardstat.sources.codes import read_code_descriptions, read_code_dictionary
from wardstat.sources.tables import load_directory
from wardstat.specs import (PRIMARY_CONDITION_TYPES, PRIMARY_PROCEDURE_TYPES, CohortSpec,
                            ReadmissionSpec)


def _ints(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wardstat", description=__doc__.split("\n\n")[0])
    p.add_argument("--data", required=True, help="folder of OMOP tables (CSV or Parquet)")
    p.add_argument("--diagnosis", required=True, help="procedure = codes file (index stays)")
    p.add_argument("--complications", required=True, help="procedure = codes file (readmissions)")
    p.add_argument("--descriptions", help="code<blank>description file")
    p.add_argument("--out", required=True, help="output folder (must not exist)")
    p.add_argument("--date-format", default="%Y%m%d")
    p.add_argument("--birth-year-min", type=int)
    p.add_argument("--birth-year-max", type=int)
    p.add_argument("--events-start")
    p.add_argument("--events-end")
    p.add_argument("--exclude-male", action="store_true")
    p.add_argument("--exclude-female", action="store_true")
    p.add_argument("--exclude-dead", action="store_true")
    p.add_argument("--exclude-alive", action="store_true")
    p.add_argument("--exclude-care-sites", type=_ints, default=())
    p.add_argument("--include-care-sites", type=_ints, default=())
    p.add_argument("--inpatient-only", action="store_true")
    p.add_argument("--with-visit-only", action="store_true")
    p.add_argument("--primary-condition-types", type=_ints, default=PRIMARY_CONDITION_TYPES)
    p.add_argument("--primary-procedure-types", type=_ints, default=PRIMARY_PROCEDURE_TYPES)
    p.add_argument("--readmission-days", type=int, default=30)
    p.add_argument("--restrict-events-to-cohort", action="store_true")
    p.add_argument("--death-after-discharge-only", action="store_true")
    p.add_argument("--visit-bucket-days", type=int, default=ReadmissionSpec.visit_bucket_days)
    p.add_argument("--materialize", choices=("persist", "checkpoint", "none"),
                   default="checkpoint")
    p.add_argument("--keep-repeated-visits", action="store_true",
                   help="skip removing repeated visit spans before the join")
    p.add_argument("--extract-dir", help="also write the cohort's tables here (CSV)")
    p.add_argument("--extract-codec", help="gzip, bzip2, lz4, snappy, deflate or none")
    return p.parse_args(argv)


def main(argv=None) -> dict:
    a = parse_args(argv)
    spark = SparkSession.builder.appName("wardstat").getOrCreate()
    cohort = CohortSpec(
        year_of_birth_min=a.birth_year_min, year_of_birth_max=a.birth_year_max,
        events_start_date=a.events_start, events_end_date=a.events_end,
        exclude_male=a.exclude_male, exclude_female=a.exclude_female,
        exclude_dead=a.exclude_dead, exclude_alive=a.exclude_alive,
        exclude_care_sites=a.exclude_care_sites, include_care_sites=a.include_care_sites,
        inpatient_only=a.inpatient_only, with_visit_only=a.with_visit_only,
        primary_condition_types=a.primary_condition_types,
        primary_procedure_types=a.primary_procedure_types)
    spec = ReadmissionSpec(
        readmission_days=a.readmission_days,
        primary_condition_types=a.primary_condition_types,
        primary_procedure_types=a.primary_procedure_types,
        restrict_events_to_cohort=a.restrict_events_to_cohort,
        death_after_discharge_only=a.death_after_discharge_only,
        visit_bucket_days=a.visit_bucket_days, dedupe_visits=not a.keep_repeated_visits,
        materialize=a.materialize)
    ds = load_directory(spark, a.data, date_format=a.date_format)
    descr = read_code_descriptions(spark, a.descriptions) if a.descriptions else None
    info = run(ds, read_code_dictionary(spark, a.diagnosis),
               read_code_dictionary(spark, a.complications), a.out, cohort, spec, descr,
               extract_dir=a.extract_dir, extract_codec=a.extract_codec,
               extract_date_format=a.date_format)
    print(json.dumps(info))
    return info


if __name__ == "__main__":
    main()
