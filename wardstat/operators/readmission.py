"""Readmissions, deaths after a stay, and the per-provider scorecard.

All procedures are handled in one plan: ``procedure`` is part of every
distinct and join key, so there is no per-procedure loop on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators.intervals import band_join

STAY_KEY = ["procedure", "PERSON_ID", "VISIT_END_DATE", "PROVIDER_ID"]

def stay_keys(index_stays: DataFrame) -> DataFrame:
    """Distinct index stays regardless of the code or table they came from."""
    return index_stays.select(*STAY_KEY).distinct()


def readmissions(index_stays: DataFrame, complication_stays: DataFrame,
                 days: int) -> DataFrame:
    """Distinct (procedure, PERSON_ID, VISIT_END_DATE, PROVIDER_ID, SOURCE_VALUE)
    where a complication stay of the same person and procedure starts strictly
    after discharge and strictly before discharge + ``days`` (day 1 .. days-1).
    SOURCE_VALUE is the complication code, so a stay with two complication
    codes is counted twice."""
    compl = (complication_stays
             .select("procedure", "PERSON_ID",
                     F.col("VISIT_START_DATE").alias("READMIT_DATE"),
                     F.col("SOURCE_VALUE"))
             .distinct())
    joined = band_join(stay_keys(index_stays), compl, ["procedure", "PERSON_ID"],
                       "VISIT_END_DATE", "READMIT_DATE", 1, days - 1)
    return joined.select(*STAY_KEY, "SOURCE_VALUE").distinct()


def deaths_after_stay(index_stays: DataFrame, death: DataFrame, days: int,
                      after_discharge_only: bool = False) -> DataFrame:
    """Distinct (procedure, PERSON_ID, VISIT_END_DATE, PROVIDER_ID) with a
    death before discharge + ``days``, plus ``SOURCE_VALUE = 0``.

    By default a death has no lower bound (a death dated before discharge
    counts); the test only needs each person's earliest death, so the death
    side is reduced to one row per person before the join.  With
    ``after_discharge_only`` the death must fall on day 0 .. days-1.
    """
    stays = stay_keys(index_stays)
    if after_discharge_only:
        d = death.select("PERSON_ID", "DEATH_DATE").distinct()
        hit = (band_join(stays, d, ["PERSON_ID"], "VISIT_END_DATE", "DEATH_DATE", 0, days - 1)
               .select(*STAY_KEY).distinct())
    else:
        # one row per person on the death side: distinct stays stay distinct
        first = death.groupBy("PERSON_ID").agg(F.min("DEATH_DATE").alias("FIRST_DEATH"))
        hit = (stays.join(first, "PERSON_ID")
               .where(F.col("FIRST_DEATH") < F.date_add("VISIT_END_DATE", days))
               .select(*STAY_KEY))
    return hit.withColumn("SOURCE_VALUE", F.lit(0))


def provider_event_count(events: DataFrame, count_name: str = "COUNT") -> DataFrame:
    """(procedure, PROVIDER_ID, <count_name>) rows per procedure and provider, in
    no order: whoever writes them sorts them."""
    return events.groupBy("procedure", "PROVIDER_ID").agg(F.count(F.lit(1)).alias(count_name))


def provider_scorecard(index_stays: DataFrame, readmission_rows: DataFrame,
                       death_rows: DataFrame) -> DataFrame:
    """Per (procedure, PROVIDER_ID): PROCEDURE_COUNT (index stay rows),
    READMISSION_COUNT, DEATH_COUNT, COMPLICATION_COUNT = readmissions + deaths,
    PERCENTAGE = complications / procedures (a ratio; may exceed 1).

    The three counts come from one aggregation over the tagged union of the
    three inputs (instead of three aggregations and two joins).  A stay with
    a null provider forms its own group whose readmission and death counts
    are 0 (a null id matches no count), and whose id is then shown as 0.
    """
    one, zero = F.lit(1), F.lit(0)
    tagged = (
        index_stays.select("procedure", "PROVIDER_ID", one.alias("p"), zero.alias("r"), zero.alias("d"))
        .unionByName(readmission_rows.select("procedure", "PROVIDER_ID", zero.alias("p"),
                                             one.alias("r"), zero.alias("d")))
        .unionByName(death_rows.select("procedure", "PROVIDER_ID", zero.alias("p"),
                                       zero.alias("r"), one.alias("d")))
    )
    agg = tagged.groupBy("procedure", "PROVIDER_ID").agg(
        F.sum("p").cast("bigint").alias("PROCEDURE_COUNT"),
        F.sum("r").cast("bigint").alias("r"),
        F.sum("d").cast("bigint").alias("d"))
    null_provider = F.col("PROVIDER_ID").isNull()
    readm = F.when(null_provider, F.lit(0).cast("bigint")).otherwise(F.col("r"))
    dead = F.when(null_provider, F.lit(0).cast("bigint")).otherwise(F.col("d"))
    return (agg.where(F.col("PROCEDURE_COUNT") > 0)
            .select(
                "procedure",
                F.coalesce("PROVIDER_ID", F.lit(0).cast(agg.schema["PROVIDER_ID"].dataType))
                .alias("PROVIDER_ID"),
                "PROCEDURE_COUNT",
                readm.alias("READMISSION_COUNT"),
                dead.alias("DEATH_COUNT"),
                (readm + dead).alias("COMPLICATION_COUNT"),
                ((readm + dead) / F.col("PROCEDURE_COUNT")).alias("PERCENTAGE")))
