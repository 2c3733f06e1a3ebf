"""Registered queries of sources and sinks: whole driver tables are written in
the form in question into the session's checkpoint folder and read back.

Reading back needs the files, so these queries write when they are built;
``bench.py`` counts building as part of a query's time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.dataset import OmopDataset
from wardstat.operators import codes as C
from wardstat.operators import cohort as K
from wardstat.plans import params as P
from wardstat.sinks.files import (write_csv, write_partitioned_csv, write_report_text,
                                  write_single_csv, write_tables)
from wardstat.sources.adapter import load_driver_dataset
from wardstat.sources.codes import read_code_descriptions, read_code_dictionary
from wardstat.sources.lines import ordered_lines
from wardstat.sources.tables import load_directory, read_omop_csv, read_yearly_folder
from wardstat.workspace import Workspace, scratch_folder

VISIT_COLS = ["VISIT_OCCURRENCE_ID", "PERSON_ID", "VISIT_START_DATE", "VISIT_END_DATE",
              "PROVIDER_ID"]
PERSON_COLS = ["PERSON_ID", "YEAR_OF_BIRTH", "GENDER_SOURCE_VALUE", "CARE_SITE_ID"]
EXTRACTED = {
    "person": PERSON_COLS,
    "visit_occurrence": VISIT_COLS,
    "condition_occurrence": ["CONDITION_OCCURRENCE_ID", "PERSON_ID", "CONDITION_START_DATE",
                             "CONDITION_END_DATE", "CONDITION_SOURCE_VALUE"],
    "procedure_occurrence": ["PROCEDURE_OCCURRENCE_ID", "PERSON_ID", "PROCEDURE_DATE",
                             "PROCEDURE_SOURCE_VALUE"],
    "death": ["PERSON_ID", "DEATH_DATE"],
}


def _folder(spark, name: str) -> str:
    """A new folder that goes when the driver ends; the rows are read after the query."""
    return f"{scratch_folder(spark, name)}/data"


def _extract(table: str):
    """A table of the full cohort written as gzip CSV, then loaded by header name."""
    def query(spark, sf_dir) -> DataFrame:
        cohort = K.build_cohort(load_driver_dataset(spark, sf_dir), P.FULL_COHORT)
        folder = _folder(spark, "extract")
        write_tables(OmopDataset({table: cohort[table]}), folder, codec="gzip")
        return load_directory(spark, folder)[table].select(EXTRACTED[table])

    return query


def extract_text(spark, sf_dir) -> DataFrame:
    """Texts with blanks, line ends, quotes, and empty ones, in an extract."""
    person = load_driver_dataset(spark, sf_dir)["person"]
    k = F.col("PERSON_ID")
    odd = (F.when(k % 6 == 0, " padded ").when(k % 6 == 1, "")
           .when(k % 6 == 2, "two\nlines").when(k % 6 == 3, 'say "a\\b", 100%')
           .when(k % 6 == 4, F.concat(F.lit("x,"), k.cast("string"))))
    folder = _folder(spark, "extract-text")
    write_csv(person.select("PERSON_ID", odd.alias("PERSON_SOURCE_VALUE")), f"{folder}/person")
    return load_directory(spark, folder)["person"].select("PERSON_ID", "PERSON_SOURCE_VALUE")


def yearly_combine(spark, sf_dir) -> DataFrame:
    """Orders written as one CSV extract per order year (a single partitioned
    write), then recombined with a YEAR column."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    rows = orders.select(F.year("o_orderdate").alias("year"),
                         F.col("o_orderkey").cast("string").alias("o_orderkey"),
                         F.col("o_custkey").cast("string").alias("o_custkey"),
                         "o_orderstatus", "o_orderpriority",
                         F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    folder = _folder(spark, "yearly")
    rows.write.partitionBy("year").option("header", True).csv(folder)
    # rows without a date sit in Spark's default partition folder: a null YEAR
    return read_yearly_folder(spark, folder)


def csv_header_drift(spark, sf_dir) -> DataFrame:
    """Visits in two sets of CSV files with other columns and another order."""
    visits = load_driver_dataset(spark, sf_dir)["visit_occurrence"].select(VISIT_COLS)
    odd = F.col("VISIT_OCCURRENCE_ID") % 2 == 1
    folder = _folder(spark, "drift")
    write_csv(visits.where(odd), f"{folder}/a")
    write_csv(visits.where(~odd).select(*VISIT_COLS[::-1], F.lit("z").alias("EXTRA")),
              f"{folder}/b")
    return read_omop_csv(spark, f"{folder}/*", "visit_occurrence", "%Y%m%d").select(VISIT_COLS)


def csv_many_files(spark, sf_dir) -> DataFrame:
    """Visits in 280 CSV files of three layouts, beside files without a line and of
    blank lines; the empty ones come first in the folder."""
    visits = load_driver_dataset(spark, sf_dir)["visit_occurrence"].select(VISIT_COLS)
    third = F.pmod(F.xxhash64("VISIT_OCCURRENCE_ID"), F.lit(3))
    folder = _folder(spark, "many")
    spark.createDataFrame([], "value string").write.text(f"{folder}/a-empty")
    (spark.range(0, 20, 1, 20).select(F.lit("").alias("value"))
     .write.text(f"{folder}/b-blank"))
    for name, rest, columns in (("c", 0, VISIT_COLS), ("d", 1, VISIT_COLS[::-1]),
                                ("e", 2, ["EXTRA", *VISIT_COLS[2:], *VISIT_COLS[:2]])):
        part = visits.withColumn("EXTRA", F.lit("x")).where(third == rest)
        write_csv(part.select(*columns).repartition(90), f"{folder}/{name}")
    return read_omop_csv(spark, f"{folder}/*", "visit_occurrence", "%Y%m%d").select(VISIT_COLS)


def csv_malformed_drop(spark, sf_dir) -> DataFrame:
    """Visits of which a rule on the key breaks a date or an id."""
    visits = load_driver_dataset(spark, sf_dir)["visit_occurrence"]
    k = F.col("VISIT_OCCURRENCE_ID")
    text = visits.select(
        k, F.when(k % 11 == 3, F.concat(F.lit("p"), F.col("PERSON_ID"))).otherwise(
            F.col("PERSON_ID").cast("string")).alias("PERSON_ID"),
        F.date_format("VISIT_START_DATE", "yyyyMMdd").alias("VISIT_START_DATE"),
        F.when(k % 13 == 0, F.date_format("VISIT_END_DATE", "yyyy-MM-dd"))
        .otherwise(F.date_format("VISIT_END_DATE", "yyyyMMdd")).alias("VISIT_END_DATE"),
        "PROVIDER_ID")
    folder = _folder(spark, "malformed")
    write_csv(text, folder)
    return read_omop_csv(spark, folder, "visit_occurrence", "%Y%m%d").select(VISIT_COLS)


def code_dictionary_file(spark, sf_dir) -> DataFrame:
    """A dictionary file of part keys by type and brand, read as codes."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    folder = _folder(spark, "dictionary")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")),
                                     lambda x: x.cast("string")), ",")
    (part.groupBy("p_type", "p_brand").agg(codes.alias("codes"))
     .select(F.concat_ws(" = ", F.concat_ws("/", "p_type", "p_brand"), "codes"))
     .toDF("value").write.text(folder))
    return read_code_dictionary(spark, folder).df.select("procedure", "ord", "code")


def code_descriptions_file(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    folder = _folder(spark, "descriptions")
    (part.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name", F.lit(" ")))
     .toDF("value").write.text(folder))
    return read_code_descriptions(spark, folder)


def code_dictionary_override(spark, sf_dir) -> DataFrame:
    """Two dictionary files; the second, larger one has the last line of each key that it
    repeats, but a key keeps its first place, here the number of its first line."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    folder = _folder(spark, "override")

    def lines(key, codes, name):
        listed = part.select(key.alias("k"), codes.alias("code")).groupBy("k").agg(
            F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
        (listed.repartition(1).sortWithinPartitions("k")
         .select(F.concat_ws(" = ", "k", "codes").alias("value"))
         .write.text(f"{folder}/{name}"))

    brand, kind = F.col("p_brand"), F.col("p_type")
    lines(F.concat(F.lit("brand "), brand), kind, "a")
    lines(F.explode(F.array(F.concat(F.lit("brand "), brand), F.concat(F.lit("type "), kind))),
          F.col("p_partkey").cast("string"), "b")
    return read_code_dictionary(spark, f"{folder}/*").df


def code_descriptions_override(spark, sf_dir) -> DataFrame:
    """Descriptions of brands in two files: the last line of the last file wins."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    folder = _folder(spark, "texts")
    line = F.concat_ws(" ", "p_brand", "p_name").alias("value")
    part.repartition(1).sortWithinPartitions(F.desc("p_partkey")).select(line).write.text(
        f"{folder}/a")
    part.repartition(1).sortWithinPartitions("p_partkey").select(line).write.text(f"{folder}/b")
    return read_code_descriptions(spark, f"{folder}/*")


def single_csv(spark, sf_dir) -> DataFrame:
    """Type counts as a single CSV file."""
    ds = load_driver_dataset(spark, sf_dir)
    folder = _folder(spark, "single")
    write_single_csv(C.type_concept_count(ds["condition_occurrence"], "condition"), folder)
    return (spark.read.schema("CONDITION_TYPE_CONCEPT_ID BIGINT, COUNT BIGINT")
            .option("header", True).csv(folder))


def cohort_size(spark, sf_dir) -> DataFrame:
    cohort = K.build_cohort(load_driver_dataset(spark, sf_dir), P.FULL_COHORT)
    return cohort["person"].agg(F.count(F.lit(1)).alias("persons"))


def scorecard_files(spark, sf_dir) -> DataFrame:
    """The scorecard, a file per procedure (one of a procedure without stays),
    read back with the procedure as text."""
    from wardstat.plans.queries import provider_scorecard
    folder = _folder(spark, "scorecard")
    with Workspace(spark) as work:      # ranges and keys are found before the write
        card = work.written(provider_scorecard(spark, sf_dir), "card")
        write_partitioned_csv(card, folder, "procedure", keys=["A", "B", "none"],
                              order=[F.desc("PROCEDURE_COUNT"), "PROVIDER_ID"])
    columns = [f for f in card.schema.fields if f.name != "procedure"]
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    return (spark.read.schema(f"{layout}, procedure STRING").option("header", True).csv(folder))


def report_text_file(spark, sf_dir) -> DataFrame:
    """The text report as a file, with its line numbers."""
    from wardstat.plans.queries import code_report_lines
    folder = _folder(spark, "report")
    with Workspace(spark) as work:
        write_report_text(work.written(code_report_lines(spark, sf_dir), "lines"), folder)
    return ordered_lines(spark, folder).select(F.col("line_no").cast("int").alias("line_no"),
                                               F.col("value").alias("line"))


def _event_dates(table: str, start: str, end: str, key: str):
    """The stream's events as an event table of persons, bounded by dates."""
    def query(spark, sf_dir) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
        day = F.to_date("ts")
        columns = {key: F.col("event_id"), "PERSON_ID": F.col("user_id"), start: day}
        if end != start:
            columns[end] = F.when(F.col("event_id") % 5 != 0,
                                  F.date_add(day, (F.col("event_id") % 4).cast("int")))
        ds = OmopDataset({table: events.select(*[c.alias(n) for n, c in columns.items()])})
        return K.filter_event_dates(ds, P.STREAM_START, P.STREAM_END)[table]

    return query


FILE_QUERIES = {
    "cohort_extract_person": _extract("person"),
    "cohort_extract_visit": _extract("visit_occurrence"),
    "cohort_extract_condition": _extract("condition_occurrence"),
    "cohort_extract_procedure": _extract("procedure_occurrence"),
    "cohort_extract_death": _extract("death"),
    "extract_text": extract_text,
    "yearly_combine": yearly_combine,
    "csv_header_drift": csv_header_drift,
    "csv_many_files": csv_many_files,
    "csv_malformed_drop": csv_malformed_drop,
    "code_dictionary_file": code_dictionary_file,
    "code_descriptions_file": code_descriptions_file,
    "code_dictionary_override": code_dictionary_override,
    "code_descriptions_override": code_descriptions_override,
    "single_csv": single_csv,
    "cohort_size": cohort_size,
    "scorecard_files": scorecard_files,
    "report_text_file": report_text_file,
    "event_dates_measurement": _event_dates("measurement", "MEASUREMENT_DATE", "MEASUREMENT_DATE",
                                            "MEASUREMENT_ID"),
    "event_dates_observation": _event_dates("observation", "OBSERVATION_DATE", "OBSERVATION_DATE",
                                            "OBSERVATION_ID"),
    "event_dates_device": _event_dates("device_exposure", "DEVICE_EXPOSURE_START_DATE",
                                       "DEVICE_EXPOSURE_END_DATE", "DEVICE_EXPOSURE_ID"),
}
