"""The batch run writes every output; checkpointed and persisted stays agree."""

import dataclasses
import os

import pytest

from tests import micro
from wardstat.plans.scorecard import RUN_COLUMNS, readmission_analysis, run
from wardstat.session import ensure_checkpoint_dir
from wardstat.sources.codes import dictionary_from_mapping
from wardstat.sources.staging import observe_malformed, stage_tables
from wardstat.sources.tables import load_directory, malformed_counts
from wardstat.specs import CohortSpec, ReadmissionSpec
from wardstat.workspace import Workspace


def left_over(spark):
    """Entries of the checkpoint folder that a run would make."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sorted(x for x in os.listdir(folder) if x.startswith(("run-", "wardstat-")))


def assert_nothing_left(spark):
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert left_over(spark) == []


def test_batch_run_outputs(spark, tmp_dir):
    ds = load_directory(spark, micro.write_fixture(tmp_dir))
    diag = dictionary_from_mapping(spark, micro.DIAGNOSIS)
    compl = dictionary_from_mapping(spark, micro.COMPLICATIONS)
    spec = ReadmissionSpec(30, micro.DEV_CONDITION_TYPES, micro.DEV_PROCEDURE_TYPES,
                           materialize="checkpoint")
    out = os.path.join(tmp_dir, "results")
    info = run(ds, diag, compl, out, CohortSpec(), spec)
    assert info["persons"] == 3 and set(info["malformed"].values()) == {0}
    for name in ("condition_type_concept_count", "procedure_type_concept_count", "scorecard",
                 "procedure_count_all", "procedure_count_primary", "readmission_count_all",
                 "readmission_count_primary", "readmission_event_code_count", "readmissions"):
        assert os.path.isdir(os.path.join(out, name)), name
    assert os.listdir(os.path.join(out, "scorecard")).count("procedure=81.54") == 1
    text = spark.read.text(os.path.join(out, "readmission_event_code_count")).collect()
    lines = [r.value for r in text]
    assert lines[0] == "Procedure: 81.07" and lines[-1] == "Total Count For All Procedures: 2"
    assert_nothing_left(spark)


def test_run_keeps_nothing_after_a_failure(spark, tmp_dir, monkeypatch):
    from wardstat.plans import scorecard
    ds = load_directory(spark, micro.write_fixture(tmp_dir))
    diag = dictionary_from_mapping(spark, micro.DIAGNOSIS)
    compl = dictionary_from_mapping(spark, micro.COMPLICATIONS)

    def broken(*_args, **_more):
        assert left_over(spark)     # the tables are staged by now
        raise OSError("no space")

    monkeypatch.setattr(scorecard, "write_report_text", broken)
    with pytest.raises(OSError):
        run(ds, diag, compl, os.path.join(tmp_dir, "out"))
    assert_nothing_left(spark)


def test_workspace(spark):
    with Workspace(spark) as work:
        a = work.written(spark.range(7), "a")
        b = work.persisted(spark.range(5))
        assert (a.count(), b.count(), len(left_over(spark))) == (7, 5, 1)
        with pytest.raises(ValueError):
            work.kept(a, "c", "elsewhere")
    work.close()
    assert_nothing_left(spark)
    with pytest.raises(RuntimeError):
        work.written(spark.range(1), "late")
    assert Workspace(spark)._folder is None     # nothing is made before it is needed


def test_staging_counts_in_the_pass_that_copies(spark, tmp_dir):
    """Counts equal those of a pass of their own; later plans read the copy alone."""
    folder = micro.write_fixture(tmp_dir)
    with open(os.path.join(folder, "death.csv"), "a") as f:
        f.write("x9,20090101,1\n7,2009-01-01,1\n")
    ds = load_directory(spark, folder)
    with Workspace(spark) as work:
        staged, counts = stage_tables(ds, RUN_COLUMNS, work)
        assert counts == malformed_counts(ds, list(RUN_COLUMNS)) and counts["death"] == 2
        for name, columns in RUN_COLUMNS.items():
            plan = staged[name]._jdf.queryExecution().executedPlan().toString()
            assert "FileScan parquet" in plan and "csv" not in plan
            assert sorted(map(str, staged[name].collect())) == sorted(
                map(str, ds[name].select(*columns).collect()))
        more, counted = observe_malformed(ds, ["death", "person"])
        for name in ("death", "person"):
            assert more[name].count() == ds[name].count()
            more[name].write.format("noop").mode("overwrite").save()
        assert counted() == {"death": 2, "person": 0}
    with open(os.path.join(folder, "death.csv"), "w") as f:
        f.write("PERSON_ID,DEATH_DATE\n1,2009-01-01\n")
    with Workspace(spark) as work, pytest.raises(ValueError, match="date format"):
        stage_tables(load_directory(spark, folder), RUN_COLUMNS, work)
    assert_nothing_left(spark)


def test_parquet_tables_that_cannot_lose_rows_are_not_copied(spark, tmp_dir):
    spark.range(3).withColumnRenamed("id", "PERSON_ID").write.parquet(f"{tmp_dir}/person.parquet")
    ds = load_directory(spark, tmp_dir)
    with Workspace(spark) as work:
        staged, counts = stage_tables(ds, {"person": ("PERSON_ID",)}, work)
        assert counts == {} and staged["person"] is ds["person"] and work._folder is None


def test_outputs_do_not_depend_on_the_size_of_the_dictionary(spark, tmp_dir):
    """A procedure without stays has its file, broadcast dictionary or not."""
    ds = load_directory(spark, micro.write_fixture(tmp_dir))
    spec = ReadmissionSpec(30, micro.DEV_CONDITION_TYPES, micro.DEV_PROCEDURE_TYPES)
    found = []
    for limit in (None, 0):
        lists = [dictionary_from_mapping(spark, x) for x in (micro.DIAGNOSIS, micro.COMPLICATIONS)]
        if limit == 0:      # distributed: no rows on the driver
            lists = [dataclasses.replace(x, rows=None, max_broadcast=0) for x in lists]
        out = os.path.join(tmp_dir, f"out{limit}")
        run(ds, *lists, out, spec=spec)
        files = {}
        for folder, _, names in os.walk(out):
            parts = [os.path.join(folder, n) for n in sorted(names) if n.startswith("part-")]
            if parts:
                files[os.path.relpath(folder, out)] = [
                    line for p in parts for line in open(p).read().splitlines()]
        found.append(files)
    assert found[0] == found[1]
    assert len(found[0]["scorecard/procedure=81.07"]) == 1
    assert len(found[0]["scorecard/procedure=81.54"]) == 3
    assert_nothing_left(spark)


def test_materialize_modes_agree(spark, tmp_dir):
    ds = load_directory(spark, micro.write_fixture(tmp_dir))
    diag = dictionary_from_mapping(spark, micro.DIAGNOSIS)
    compl = dictionary_from_mapping(spark, micro.COMPLICATIONS)
    base = ReadmissionSpec(30, micro.DEV_CONDITION_TYPES, micro.DEV_PROCEDURE_TYPES)
    cards = []
    for mode in ("persist", "checkpoint", "none"):
        with Workspace(spark) as work:
            res = readmission_analysis(ds, diag, compl, dataclasses.replace(base, materialize=mode),
                                       workspace=work)
            cards.append(sorted(tuple(r) for r in res.scorecard.collect()))
            plan = res.index_stays._jdf.queryExecution().executedPlan().toString()
            assert ("InMemoryTableScan" in plan, "FileScan csv" not in plan) == (
                mode == "persist", mode == "checkpoint")
    assert_nothing_left(spark)
    assert cards[0] == cards[1] == cards[2] and len(cards[0]) == 2


def test_command_line_entry(spark, tmp_dir):
    from wardstat.__main__ import main
    os.makedirs(os.path.join(tmp_dir, "data"))
    data = micro.write_fixture(os.path.join(tmp_dir, "data"))
    diag = os.path.join(tmp_dir, "diag.properties")
    compl = os.path.join(tmp_dir, "compl.properties")
    with open(diag, "w") as f:
        f.write("# index codes\n" + "".join(f"{k} = {','.join(v)}\n" for k, v in micro.DIAGNOSIS.items()))
    with open(compl, "w") as f:
        f.write("".join(f"{k} = {','.join(v)}\n" for k, v in micro.COMPLICATIONS.items()))
    out = os.path.join(tmp_dir, "out")
    extract = os.path.join(tmp_dir, "extract")
    info = main(["--data", data, "--diagnosis", diag, "--complications", compl, "--out", out,
                 "--inpatient-only", "--readmission-days", "30",
                 "--extract-dir", extract, "--extract-codec", "gzip"])
    assert info["persons"] == 3 and set(info["malformed"].values()) == {0}
    assert sorted(d for d in os.listdir(extract)) == [
        "condition_occurrence", "death", "person", "procedure_occurrence", "visit_occurrence"]
    # procedure folders are read back as text (no partition type inference)
    card = (spark.read.option("header", True).schema(
        "PROVIDER_ID string, PROCEDURE_COUNT string, READMISSION_COUNT string, "
        "DEATH_COUNT string, COMPLICATION_COUNT string, PERCENTAGE string, procedure string")
        .csv(os.path.join(out, "scorecard")))
    assert sorted((r.procedure, r.PROVIDER_ID, r.READMISSION_COUNT) for r in card.collect()) == [
        ("81.54", "23861", "1"), ("81.54", "29084", "1")]


def test_nothing_is_written_without_a_checkpoint_folder(spark, tmp_dir, monkeypatch):
    from wardstat.plans import scorecard
    ds = load_directory(spark, micro.write_fixture(tmp_dir))

    def missing(_):
        raise RuntimeError("set spark.checkpoint.dir")

    monkeypatch.setattr(scorecard, "ensure_checkpoint_dir", missing)
    out = os.path.join(tmp_dir, "none")
    with pytest.raises(RuntimeError):
        run(ds, dictionary_from_mapping(spark, micro.DIAGNOSIS),
            dictionary_from_mapping(spark, micro.COMPLICATIONS), out)
    assert not os.path.exists(out)
