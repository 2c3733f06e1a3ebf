"""Driver tables (TPC-H-like star schema) presented as OMOP tables.

The mapping is expressed once here in Spark and once as SQL common table
expressions (``wardstat.plans.oracle``) so that both engines see the same
patients, visits and events.  All derivations are column expressions and
equi-joins; nothing is materialised.

=====================  =====================================================
OMOP table             derived from
=====================  =====================================================
person                 customer
visit_occurrence       orders (one visit per order, 0-6 days long)
condition_occurrence   lineitem x orders x part, odd line numbers
procedure_occurrence   lineitem x orders x part, even line numbers
death                  customer, every tenth customer key
code descriptions      part: first part name per brand
=====================  =====================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.dataset import OmopDataset

# Fixed values of the mapping (shared with the SQL oracle).
CONDITION_TYPE_BY_FLAG = {"A": 38000199, "R": 38000200, "N": 45756836}
PROCEDURE_TYPE_BY_FLAG = {"A": 38000250, "R": 38000251, "N": 45756900}
DEATH_EPOCH = "1998-01-01"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _type_concept(flag, mapping: dict[str, int]):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(flag == k, F.lit(v)) if expr is None
                else expr.when(flag == k, F.lit(v)))
    return expr.cast("bigint")


def person(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("PERSON_ID"),
        (F.lit(1920) + k % 80).alias("YEAR_OF_BIRTH"),
        F.when(k % 3 == 0, F.lit("Male"))
        .when(k % 3 == 1, F.lit("Female"))
        .alias("GENDER_SOURCE_VALUE"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("CARE_SITE_ID"),
    )


def visit_occurrence(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return orders.select(
        k.alias("VISIT_OCCURRENCE_ID"),
        F.col("o_custkey").alias("PERSON_ID"),
        start.alias("VISIT_START_DATE"),
        F.date_add(start, (k % 7).cast("int")).alias("VISIT_END_DATE"),
        F.when(k % 97 == 0, F.lit(None)).otherwise(k % 100).alias("PROVIDER_ID"),
    )


def _line_events(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    p = part.select("p_partkey", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey))


def condition_occurrence(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    ev = _line_events(lineitem.where(F.col("l_linenumber") % 2 == 1), orders, part)
    start = F.date_add(F.to_date("o_orderdate"), F.col("l_linenumber") - 1)
    return ev.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("CONDITION_OCCURRENCE_ID"),
        F.col("o_custkey").alias("PERSON_ID"),
        start.alias("CONDITION_START_DATE"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("date"))
        .otherwise(start).alias("CONDITION_END_DATE"),
        _type_concept(F.col("l_returnflag"), CONDITION_TYPE_BY_FLAG)
        .alias("CONDITION_TYPE_CONCEPT_ID"),
        F.col("l_orderkey").alias("VISIT_OCCURRENCE_ID"),
        F.col("p_brand").alias("CONDITION_SOURCE_VALUE"),
    )


def procedure_occurrence(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    ev = _line_events(lineitem.where(F.col("l_linenumber") % 2 == 0), orders, part)
    return ev.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("PROCEDURE_OCCURRENCE_ID"),
        F.col("o_custkey").alias("PERSON_ID"),
        F.date_add(F.to_date("o_orderdate"), F.col("l_linenumber") - 1).alias("PROCEDURE_DATE"),
        _type_concept(F.col("l_returnflag"), PROCEDURE_TYPE_BY_FLAG)
        .alias("PROCEDURE_TYPE_CONCEPT_ID"),
        F.col("l_orderkey").alias("VISIT_OCCURRENCE_ID"),
        F.col("p_brand").alias("PROCEDURE_SOURCE_VALUE"),
    )


def death(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.where(k % 10 == 0).select(
        k.alias("PERSON_ID"),
        F.date_add(F.lit(DEATH_EPOCH).cast("date"), (k % 1000).cast("int")).alias("DEATH_DATE"),
    )


def code_descriptions(part: DataFrame) -> DataFrame:
    """(code, description): the smallest part name of each brand."""
    return part.groupBy(F.col("p_brand").alias("code")).agg(
        F.min("p_name").alias("description"))


def load_driver_dataset(spark: SparkSession, sf_dir: str) -> OmopDataset:
    customer = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")
    return OmopDataset({
        "person": person(customer),
        "visit_occurrence": visit_occurrence(orders),
        "condition_occurrence": condition_occurrence(lineitem, orders, part),
        "procedure_occurrence": procedure_occurrence(lineitem, orders, part),
        "death": death(customer),
    })


def load_code_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_descriptions(_read(spark, sf_dir, "part"))
