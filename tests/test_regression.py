"""Regression figures on the driver tables (one procedure, sf0.01) and
invariants of the registered outputs."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from wardstat.plans.scorecard import readmission_analysis
from wardstat.sources.adapter import load_driver_dataset
from wardstat.sources.codes import dictionary_from_mapping

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="driver tables not present")
def test_one_procedure_figures(spark):
    ds = load_driver_dataset(spark, SF01)
    diag = dictionary_from_mapping(spark, {"A": ["Brand#1", "Brand#2", "Brand#3"]})
    compl = dictionary_from_mapping(spark, {"A": [f"Brand#{i}" for i in range(11, 16)]})
    res = readmission_analysis(ds, diag, compl)
    idx = res.index_stays
    assert idx.where("branch = 'C'").count() == 1691
    assert idx.where("branch = 'P'").count() == 1273
    # the concatenation keeps 51 rows a distinct union would drop
    assert idx.drop("branch").distinct().count() == 1691 + 1273 - 51
    assert res.complication_stays.count() == 2470
    assert res.readmissions.count() == 65
    assert res.readmissions.where("PROVIDER_ID IS NOT NULL").select("PROVIDER_ID").distinct().count() == 41
    assert res.deaths.count() == 98
    assert res.deaths.where("PROVIDER_ID IS NOT NULL").select("PROVIDER_ID").distinct().count() == 58
    assert idx.where("PROVIDER_ID IS NULL").count() == 25


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver tables not present")
def test_scorecard_and_report_invariants(spark):
    q = E.queries()
    card = q["provider_scorecard"](spark, SF001)
    bad = card.where((F.col("COMPLICATION_COUNT") != F.col("READMISSION_COUNT") + F.col("DEATH_COUNT"))
                     | (F.abs(F.col("PERCENTAGE") - F.col("COMPLICATION_COUNT") / F.col("PROCEDURE_COUNT"))
                        > 1e-12))
    assert bad.count() == 0
    n_index = q["index_stays"](spark, SF001).count()
    assert card.agg(F.sum("PROCEDURE_COUNT")).first()[0] == n_index
    totals = {r.procedure: r.TOTAL for r in q["code_report_totals"](spark, SF001).collect()}
    report = q["code_report_all"](spark, SF001)
    per_proc = {r.procedure: r.s for r in report.groupBy("procedure").agg(F.sum("COUNT").alias("s")).collect()}
    assert totals[None] == sum(v for k, v in totals.items() if k is not None)
    assert {k: v for k, v in totals.items() if k is not None} == per_proc
