"""Sources and sinks: header-bound CSV, malformed rows, codecs, directory
loading, code dictionaries and descriptions, writers, yearly combine."""

import datetime as dt
import gzip
import os

import pytest

from wardstat.dataset import OmopDataset
from wardstat.operators import codes as C
from wardstat.sinks.files import (write_csv, write_partitioned_csv, write_report_text,
                                  write_single_csv, write_tables)
from wardstat.sources.codes import read_code_descriptions, read_code_dictionary
from wardstat.sources.headers import csv_layouts, header_lines
from wardstat.sources.lines import ordered_lines
from wardstat.sources.tables import (combine_yearly, load_directory, malformed_counts,
                                     malformed_rows, read_omop_csv, read_yearly_csv,
                                     read_yearly_folder, table_name)


def write(path, text, gz=False):
    opener = gzip.open if gz else open
    with opener(path, "wt") as f:
        f.write(text)
    return path


def test_header_bound_by_name(spark, tmp_dir):
    # other column order, an extra column, a missing declared column
    p = write(os.path.join(tmp_dir, "care_site.csv"),
              "CARE_SITE_NAME,PLACE_OF_SERVICE_CONCEPT_ID,CARE_SITE_ID,LOCATION_ID\n"
              "Ward A,8940,7,3\n")
    df = read_omop_csv(spark, p, "care_site")
    r = df.collect()[0]
    assert df.columns[:3] == ["CARE_SITE_ID", "LOCATION_ID", "ORGANIZATION_ID"]
    assert (r.CARE_SITE_ID, r.LOCATION_ID, r.ORGANIZATION_ID, r.PLACE_OF_SERVICE_CONCEPT_ID) == (
        7, 3, None, 8940)


def test_malformed_rows_dropped_whatever_is_read(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "death.csv"),
              "PERSON_ID,DEATH_DATE,DEATH_TYPE_CONCEPT_ID\n"
              "1,20090301,38003566\n"
              "x2,20090302,38003566\n"     # bad id
              "3,2009-03-03,38003566\n"    # wrong date format
              "4,,38003566\n")             # blank date is fine (null)
    df = read_omop_csv(spark, p, "death")
    assert sorted(r.PERSON_ID for r in df.collect()) == [1, 4]
    assert df.select("DEATH_TYPE_CONCEPT_ID").count() == 2
    assert df.count() == 2
    assert malformed_rows(spark, p, "death").count() == 2
    kept = read_omop_csv(spark, p, "death", mode="PERMISSIVE")
    assert kept.count() == 4
    iso = read_omop_csv(spark, p, "death", date_format="%Y-%m-%d")
    assert [r.DEATH_DATE for r in iso.where("PERSON_ID = 3").collect()] == [dt.date(2009, 3, 3)]
    with pytest.raises(Exception):
        read_omop_csv(spark, p, "death", mode="FAILFAST").collect()


def test_codes_keep_leading_zeros(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "condition_occurrence.csv"),
              "PERSON_ID,CONDITION_START_DATE,CONDITION_SOURCE_VALUE\n1,20080101,00845\n")
    assert read_omop_csv(spark, p, "condition_occurrence").collect()[0].CONDITION_SOURCE_VALUE == "00845"


def test_directory_with_codecs(spark, tmp_dir):
    write(os.path.join(tmp_dir, "person.csv.gz"),
          "PERSON_ID,YEAR_OF_BIRTH\n1,1950\n2,1960\n", gz=True)
    write(os.path.join(tmp_dir, "death.csv"), "PERSON_ID,DEATH_DATE\n2,20100101\n")
    write(os.path.join(tmp_dir, "readme.txt"), "hello\n")
    ds = load_directory(spark, tmp_dir)
    assert sorted(ds) == ["death", "person"]
    assert ds["person"].count() == 2
    assert table_name("visit_occurrence.csv.snappy") == "visit_occurrence"
    assert table_name("notes.txt") is None


def test_unsupported_codec_is_rejected(spark, tmp_dir):
    write(os.path.join(tmp_dir, "person.csv.zip"), "not really zip")
    with pytest.raises(ValueError):
        load_directory(spark, tmp_dir)


def test_round_trip_tables(spark, tmp_dir):
    person = spark.createDataFrame([(1, 1950, None)],
                                   "PERSON_ID long, YEAR_OF_BIRTH int, CARE_SITE_ID long")
    death = spark.createDataFrame([(1, dt.date(2010, 5, 6))], "PERSON_ID long, DEATH_DATE date")
    out = os.path.join(tmp_dir, "cohort")
    # dates are written in the loaders' default format: read back as they are
    write_tables(OmopDataset({"person": person, "death": death}), out, codec="gzip")
    back = load_directory(spark, out)
    assert back["death"].collect()[0].DEATH_DATE == dt.date(2010, 5, 6)
    assert back["person"].collect()[0].YEAR_OF_BIRTH == 1950
    pq = os.path.join(tmp_dir, "cohort_pq")
    write_tables(OmopDataset({"death": death}), pq, fmt="parquet")
    iso = os.path.join(tmp_dir, "cohort_iso")
    write_tables(OmopDataset({"death": death}), iso, date_format="%Y-%m-%d")
    assert load_directory(spark, iso, date_format="%Y-%m-%d")["death"].collect()[0].DEATH_DATE == \
        dt.date(2010, 5, 6)
    assert load_directory(spark, pq)["death"].collect()[0].DEATH_DATE == dt.date(2010, 5, 6)
    with pytest.raises(Exception):  # default mode refuses to overwrite
        write_tables(OmopDataset({"death": death}), out)


def test_single_file_and_partitioned(spark, tmp_dir):
    empty = spark.createDataFrame([], "PROVIDER_ID long, PROCEDURE_COUNT long")
    single = os.path.join(tmp_dir, "empty")
    write_single_csv(empty, single)
    parts = [f for f in os.listdir(single) if f.startswith("part-")]
    assert len(parts) == 1
    with open(os.path.join(single, parts[0])) as f:
        assert f.read().strip() == "PROVIDER_ID,PROCEDURE_COUNT"
    card = spark.createDataFrame([("A", 1, 2), ("B", 3, 4)],
                                 "procedure string, PROVIDER_ID long, PROCEDURE_COUNT long")
    by = os.path.join(tmp_dir, "card")
    write_partitioned_csv(card, by, "procedure")
    assert sorted(d for d in os.listdir(by) if d.startswith("procedure=")) == [
        "procedure=A", "procedure=B"]
    write_csv(card, os.path.join(tmp_dir, "plain"), codec="gzip")
    with pytest.raises(ValueError):
        write_csv(card, os.path.join(tmp_dir, "bad"), codec="zip")


def test_code_dictionary_file(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "diag.properties"),
              "# comment = with equals\n"
              "\n"
              "label without equals\n"
              "51.23 = 57400,0389, 5770\n"
              "60.5 = 185\n"
              "51.23 = 0389,0389\n")
    d = read_code_dictionary(spark, p)
    got = sorted((r.procedure, r.ord, r.code) for r in d.df.collect())
    # last line of a repeated key wins; repeated codes are kept
    assert got == [("51.23", 0, "0389"), ("51.23", 1, "0389"), ("60.5", 0, "185")]
    order = {r.procedure: r.proc_ord for r in d.df.collect()}
    assert order["51.23"] < order["60.5"]  # keeps its first position
    assert d.n_entries == 3 and d.rows is not None


def test_code_descriptions_file(spark, tmp_dir):
    p = write(os.path.join(tmp_dir, "descr.txt"),
              "0389  Septicemia NOS   \n7140 Rheumatoid arthritis\nBARE\n7140 Second wins\n")
    got = {r.code: r.description for r in read_code_descriptions(spark, p).collect()}
    assert got == {"0389": " Septicemia NOS", "7140": "Second wins", "BARE": ""}


def test_lines_are_in_the_order_of_files_and_places(spark, tmp_dir):
    # the later file is the larger one, and is read first
    write(os.path.join(tmp_dir, "a.txt"), "K = 1\nA = 1\n")
    write(os.path.join(tmp_dir, "b.txt"), "".join(f"Z{k} = {k}\n" for k in range(2000))
          + "K = 2,3\n")
    write(os.path.join(tmp_dir, "c.txt"), "")
    small = spark.newSession()
    for size in ("1k", "100m"):      # many pieces of a file, and one
        small.conf.set("spark.sql.files.maxPartitionBytes", size)
        small.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [(r.line_no, r.value) for r in
               ordered_lines(small, tmp_dir).orderBy("line_no").collect()]
        want = [line for name in "abc" for line in
                open(os.path.join(tmp_dir, f"{name}.txt")).read().splitlines()]
        assert got == list(enumerate(want))
        d = read_code_dictionary(small, tmp_dir)
        rows = {(r.procedure, r.code): r.proc_ord for r in d.df.collect()}
        assert ("K", "1") not in rows and rows["K", "2"] == rows["K", "3"] == 0
        assert rows["A", "1"] == 1 and rows["Z0", "0"] == 2
    folder = os.path.join(tmp_dir, "texts")
    os.makedirs(folder)
    write(os.path.join(folder, "a"), "K first\n")
    write(os.path.join(folder, "b"), "K second\n" + "X x\n" * 500 + "K last\n")
    write(os.path.join(folder, "c"), "Y y\n")
    got = {r.code: r.description for r in read_code_descriptions(small, folder).collect()}
    assert got == {"K": "last", "X": "x", "Y": "y"}


def test_report_text_file(spark, tmp_dir):
    from wardstat.sources.codes import dictionary_from_mapping
    cond = spark.createDataFrame([(1, dt.date(2009, 1, 1), 1, "0100")],
                                 "PERSON_ID long, CONDITION_START_DATE date, "
                                 "CONDITION_TYPE_CONCEPT_ID long, CONDITION_SOURCE_VALUE string")
    proc = spark.createDataFrame([], "PERSON_ID long, PROCEDURE_DATE date, "
                                     "PROCEDURE_TYPE_CONCEPT_ID long, PROCEDURE_SOURCE_VALUE string")
    rep = C.code_report(dictionary_from_mapping(spark, {"P": ["0100"]}), cond, proc)
    out = os.path.join(tmp_dir, "report")
    write_report_text(C.render_report(rep), out)
    part = [f for f in os.listdir(out) if f.startswith("part-")][0]
    with open(os.path.join(out, part)) as f:
        assert f.read().splitlines() == [
            "Procedure: P", "code, count, description", "0100,1,",
            "Total Count For This procedure: 1", "", "Total Count For All Procedures: 1"]


def test_yearly_combine(spark, tmp_dir):
    paths = {}
    for year, extra in ((2008, ""), (2009, ",X")):
        paths[year] = write(os.path.join(tmp_dir, f"benef_{year}.csv"),
                            f"BENE_ID,SEX{extra.replace(',X', ',EXTRA')}\n"
                            f"A{year},1{extra}\n")
    df = read_yearly_csv(spark, paths)
    assert df.columns[0] == "YEAR"
    got = sorted((r.YEAR, r.BENE_ID, r.EXTRA) for r in df.collect())
    assert got == [(2008, "A2008", None), (2009, "A2009", "X")]
    one = combine_yearly({2010: spark.range(2)})
    assert [r.YEAR for r in one.collect()] == [2010, 2010]


def test_yearly_folder(spark, tmp_dir):
    for year, text in (("2008", "ID,SEX\nA,1\nB,\n"), ("2009", "SEX,ID,year\n2,C,1900\n"),
                       ("2010", ""), ("__HIVE_DEFAULT_PARTITION__", "ID,SEX\nD,3\n")):
        os.makedirs(os.path.join(tmp_dir, f"year={year}"))
        write(os.path.join(tmp_dir, f"year={year}", "part 1.csv"), text)
    df = read_yearly_folder(spark, tmp_dir)
    assert df.columns == ["YEAR", "ID", "SEX"]
    assert sorted(map(tuple, df.collect()), key=str) == [
        (2008, "A", "1"), (2008, "B", None), (2009, "C", "2"), (None, "D", "3")]
    # a scan per layout, and a year's filter reads its folder only
    plan = df.where("YEAR = 2009")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "PartitionFilters: [isnotnull(year" in plan
    empty = os.path.join(tmp_dir, "year=2010")
    assert read_yearly_folder(spark, empty).count() == 0
    assert read_yearly_csv(spark, {2010: empty}).count() == 0


def test_extra_and_missing_columns_do_not_drop_rows(spark, tmp_dir):
    # a fifth column the layout does not declare, and a missing declared one
    p = write(os.path.join(tmp_dir, "observation_period.csv"),
              "OBSERVATION_PERIOD_ID,PERSON_ID,OBSERVATION_PERIOD_START_DATE,"
              "OBSERVATION_PERIOD_END_DATE,PERIOD_TYPE_CONCEPT_ID\n"
              "1,1,20080101,20101231,44814722\n2,2,20080101,20101231,44814722\n")
    assert read_omop_csv(spark, p, "observation_period").count() == 2
    p = write(os.path.join(tmp_dir, "drug_era.csv"),
              "DRUG_ERA_ID,PERSON_ID,DRUG_CONCEPT_ID,DRUG_ERA_START_DATE,DRUG_ERA_END_DATE,"
              "DRUG_EXPOSURE_COUNT,GAP_DAYS\n1,1,19019073,20080101,20080130,2,0\n")
    r = read_omop_csv(spark, p, "drug_era").collect()[0]
    assert (r.DRUG_EXPOSURE_COUNT, r.DRUG_TYPE_CONCEPT_ID) == (2, None)


def test_header_with_byte_order_mark_and_blanks(spark, tmp_dir):
    p = os.path.join(tmp_dir, "person.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("PERSON_ID, year_of_birth \n7,1950\n")
    r = read_omop_csv(spark, p, "person").collect()[0]
    assert (r.PERSON_ID, r.YEAR_OF_BIRTH) == (7, 1950)


def test_each_file_is_bound_by_its_own_header(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "death")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), "PERSON_ID,DEATH_DATE,DEATH_TYPE_CONCEPT_ID,"
          "CAUSE_CONCEPT_ID\n1,20090301,11,111\n")
    write(os.path.join(folder, "b.csv"), "CAUSE_CONCEPT_ID,DEATH_TYPE_CONCEPT_ID,PERSON_ID,"
          "DEATH_DATE\n222,22,2,20090302\n")
    write(os.path.join(folder, "empty.csv"), "")
    got = sorted((r.PERSON_ID, r.DEATH_TYPE_CONCEPT_ID, r.CAUSE_CONCEPT_ID)
                 for r in load_directory(spark, tmp_dir)["death"].collect())
    assert got == [(1, 11, 111), (2, 22, 222)]


@pytest.mark.parametrize("n_files", [30, 260])
def test_any_number_of_files_binds_each_by_its_header(spark, tmp_dir, n_files):
    folder = os.path.join(tmp_dir, "death")
    os.makedirs(folder)
    want = []
    for k in range(n_files):
        name = os.path.join(folder, f"{k:04d} [part] 100%.csv")
        if k < 3 or k % 10:
            write(name, "\n \n" if k % 4 == 1 else "")
        elif k % 20:
            write(name, f"PERSON_ID,DEATH_DATE,CAUSE_CONCEPT_ID\n{k},20090301,{k + 1}\n")
            want.append((k, k + 1))
        else:
            write(name, f"\n\"cause_concept_id\",EXTRA, PERSON_ID,person_id,\n{k + 1},a,{k},7,\n")
            want.append((k, k + 1))
    ds = load_directory(spark, tmp_dir)
    assert sorted((r.PERSON_ID, r.CAUSE_CONCEPT_ID) for r in ds["death"].collect()) == want
    assert malformed_counts(ds, ["death"]) == {"death": 0}


def test_header_catalogue(spark, tmp_dir):
    for k in range(5):
        write(os.path.join(tmp_dir, f"{k}.csv"), "A,B\n1,2\n" if k % 2 else "B, A \n" * (k > 0))
    assert sorted(r.header for r in header_lines(spark, tmp_dir).collect()) == [
        "A,B", "A,B", "B, A ", "B, A "]
    layouts = csv_layouts(spark, tmp_dir)
    assert [(x.names, [os.path.basename(f) for f in x.files]) for x in layouts] == [
        (("A", "B"), ["1.csv", "3.csv"]), (("B", "A"), ["2.csv", "4.csv"])]
    # a job per read, not per file, and a file is read to its first line only
    big = write(os.path.join(tmp_dir, "big.csv"), "A\n" + "1\n" * 200_000)
    assert [x.names for x in csv_layouts(spark, big)] == [("A",)]
    empty = os.path.join(tmp_dir, "none")
    os.makedirs(empty)
    write(os.path.join(empty, "a.csv"), "")
    assert csv_layouts(spark, empty) == [] and read_omop_csv(spark, empty, "death").count() == 0
    assert malformed_rows(spark, empty, "death").count() == 0


def test_two_sources_of_a_table_are_an_error(spark, tmp_dir):
    write(os.path.join(tmp_dir, "person.csv"), "PERSON_ID\n1\n")
    write(os.path.join(tmp_dir, "person.csv.gz"), "PERSON_ID\n2\n", gz=True)
    with pytest.raises(ValueError, match="person"):
        load_directory(spark, tmp_dir)


def test_malformed_rows_are_counted(spark, tmp_dir):
    write(os.path.join(tmp_dir, "death.csv"),
          "PERSON_ID,DEATH_DATE\n1,20090301\nx,20090301\n3,2009-01-01\n")
    write(os.path.join(tmp_dir, "person.csv"), "PERSON_ID\n1\n")
    assert malformed_counts(load_directory(spark, tmp_dir), ["death", "person"]) == {
        "death": 2, "person": 0}
    iso = os.path.join(tmp_dir, "iso")
    os.makedirs(iso)
    write(os.path.join(iso, "death.csv"), "PERSON_ID,DEATH_DATE\n1,2009-03-01\n")
    with pytest.raises(ValueError, match="date format"):
        malformed_counts(load_directory(spark, iso), ["death"])


def test_loaded_parquet_reads_only_the_columns_wanted(spark, tmp_dir):
    visit = spark.createDataFrame(
        [(1, 2, dt.date(2009, 1, 1), "x")],
        "VISIT_OCCURRENCE_ID long, PERSON_ID long, VISIT_START_DATE date, VISIT_SOURCE_VALUE string")
    write_tables(OmopDataset({"visit_occurrence": visit}), tmp_dir + "/t", fmt="parquet")
    one = load_directory(spark, tmp_dir + "/t")["visit_occurrence"].select("PERSON_ID")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<PERSON_ID:bigint>" in plan and "PushedFilters: []" in plan


@pytest.mark.parametrize("codec", ["none", "bzip2", "deflate", "gzip", "lz4", "snappy"])
def test_extract_reads_back_as_it_is(spark, tmp_dir, codec):
    texts = [" 0389 ", "two\nlines", "", None, 'a "quoted" \\ one', "\r", "x,y", "ends\\",
             "\x1a%odd", "100%0A", "plain"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "PERSON_ID long, PERSON_SOURCE_VALUE string")
    write_tables(OmopDataset({"person": df}), tmp_dir + "/x", codec=codec)
    back = load_directory(spark, tmp_dir + "/x")["person"]
    assert sorted((r.PERSON_ID, r.PERSON_SOURCE_VALUE) for r in back.collect()) == rows


def test_one_file_per_key_in_order(spark, tmp_dir):
    card = spark.createDataFrame([("81.10", k, k % 7) for k in range(50)] + [("60.5", 1, 1)],
                                 "procedure string, PROVIDER_ID long, PROCEDURE_COUNT long")
    out = os.path.join(tmp_dir, "card")
    write_partitioned_csv(card.repartition(4), out, "procedure", keys=["81.10", "60.29"],
                          order=["PROCEDURE_COUNT", "PROVIDER_ID"])
    for key, n in (("81.10", 51), ("60.5", 2), ("60.29", 1)):
        parts = [f for f in os.listdir(f"{out}/procedure={key}") if f.startswith("part-")]
        assert len(parts) == 1
        with open(f"{out}/procedure={key}/{parts[0]}") as f:
            lines = f.read().splitlines()
        assert len(lines) == n and lines[0] == "PROVIDER_ID,PROCEDURE_COUNT"
        if n == 51:
            counts = [tuple(map(int, x.split(",")))[::-1] for x in lines[1:]]
            assert counts == sorted(counts)


def read_parts(folder):
    return [open(os.path.join(folder, f)).read().splitlines() for f in sorted(os.listdir(folder))
            if f.startswith("part-")]


def test_hot_key_is_several_ordered_files(spark, tmp_dir):
    n = 4000
    card = spark.range(n).selectExpr("if(id % 10 = 0, concat('k', id % 30), 'hot') as procedure",
                                     "id as PROVIDER_ID", "id * 7919 % 4001 as PROCEDURE_COUNT")
    out = os.path.join(tmp_dir, "card")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(conf, "false")       # as if every range were a full partition
        write_partitioned_csv(card, out, "procedure", order=["PROCEDURE_COUNT", "PROVIDER_ID"],
                              keys=spark.createDataFrame([("hot",), ("none",), ("none",)],
                                                         "procedure string"))
    finally:
        spark.conf.unset(conf)
    assert sorted(os.listdir(out))[-5:] == ["procedure=hot", "procedure=k0", "procedure=k10",
                                           "procedure=k20", "procedure=none"]
    parts = read_parts(f"{out}/procedure=hot")
    assert len(parts) > 1 and all(p[0] == "PROVIDER_ID,PROCEDURE_COUNT" for p in parts)
    rows = [tuple(map(int, x.split(",")))[::-1] for p in parts for x in p[1:]]
    assert rows == sorted(rows) and len(rows) == 3600
    assert read_parts(f"{out}/procedure=none") == [["PROVIDER_ID,PROCEDURE_COUNT"]]
    back = spark.read.option("header", True).csv(out)
    assert back.count() == n


def test_large_report_is_ordered_part_files(spark, tmp_dir):
    from wardstat.sources.codes import dictionary_from_mapping
    lists = {f"P{k}": [f"c{i}" for i in range(k % 40)] for k in range(60)}
    cond = spark.range(500).selectExpr("id as PERSON_ID", "date'2009-01-01' as CONDITION_START_DATE",
                                       "1 as CONDITION_TYPE_CONCEPT_ID",
                                       "concat('c', id % 50) as CONDITION_SOURCE_VALUE")
    proc = cond.limit(0).selectExpr("PERSON_ID", "CONDITION_START_DATE as PROCEDURE_DATE",
                                    "CONDITION_TYPE_CONCEPT_ID as PROCEDURE_TYPE_CONCEPT_ID",
                                    "CONDITION_SOURCE_VALUE as PROCEDURE_SOURCE_VALUE")
    lines = C.render_report(C.code_report(dictionary_from_mapping(spark, lists), cond, proc))
    want = [r.line for r in lines.orderBy(lines.proc_ord.asc_nulls_last(), "seq", "ord").collect()]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    for many in (False, True):
        out = os.path.join(tmp_dir, f"report{many}")
        try:
            spark.conf.set(conf, str(not many))
            write_report_text(lines, out)
        finally:
            spark.conf.unset(conf)
        parts = read_parts(out)
        assert (len(parts) > 1) == many and [x for p in parts for x in p] == want
        assert [r.value for r in ordered_lines(spark, out).orderBy("line_no").collect()] == want
