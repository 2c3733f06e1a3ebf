"""OMOP CDM v5.0 table layouts used by the loaders.

The column lists below are fixed values: they must equal the published
OMOP CDM v5.0 layout the analysis was written against, so they are stated
plainly as Spark DDL, one table per entry, columns in their natural order
(file sources do not enforce NOT NULL).

Type note: identifier columns (``*_ID``) are BIGINT, where the published layout
says INT, so that identifiers beyond 2**31 on very large installations are
not turned into malformed rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: OMOP CDM v5.0 columns per table -------------------------
OMOP_TABLE_COLUMNS: dict[str, str] = {
    "care_site": (
        "CARE_SITE_ID BIGINT NOT NULL, LOCATION_ID BIGINT, ORGANIZATION_ID BIGINT, "
        "PLACE_OF_SERVICE_CONCEPT_ID BIGINT, CARE_SITE_SOURCE_VALUE STRING, "
        "PLACE_OF_SERVICE_SOURCE_VALUE STRING"
    ),
    "cohort": (
        "COHORT_ID BIGINT NOT NULL, COHORT_CONCEPT_ID BIGINT NOT NULL, "
        "COHORT_START_DATE DATE NOT NULL, COHORT_END_DATE DATE, SUBJECT_ID BIGINT NOT NULL, "
        "STOP_REASON STRING"
    ),
    "condition_era": (
        "CONDITION_ERA_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "CONDITION_CONCEPT_ID BIGINT NOT NULL, CONDITION_ERA_START_DATE DATE NOT NULL, "
        "CONDITION_ERA_END_DATE DATE, CONDITION_OCCURRENCE_COUNT INT"
    ),
    "condition_occurrence": (
        "CONDITION_OCCURRENCE_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "CONDITION_CONCEPT_ID BIGINT NOT NULL, CONDITION_START_DATE DATE NOT NULL, "
        "CONDITION_END_DATE DATE, CONDITION_TYPE_CONCEPT_ID BIGINT NOT NULL, "
        "STOP_REASON STRING, PROVIDER_ID BIGINT, VISIT_OCCURRENCE_ID BIGINT, "
        "CONDITION_SOURCE_VALUE STRING, CONDITION_SOURCE_CONCEPT_ID BIGINT"
    ),
    "death": (
        "PERSON_ID BIGINT NOT NULL, DEATH_DATE DATE NOT NULL, "
        "DEATH_TYPE_CONCEPT_ID BIGINT NOT NULL, CAUSE_CONCEPT_ID BIGINT, "
        "CAUSE_SOURCE_VALUE STRING, CAUSE_SOURCE_CONCEPT_ID BIGINT"
    ),
    "device_exposure": (
        "DEVICE_EXPOSURE_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "DEVICE_CONCEPT_ID BIGINT NOT NULL, DEVICE_EXPOSURE_START_DATE DATE NOT NULL, "
        "DEVICE_EXPOSURE_END_DATE DATE, DEVICE_TYPE_CONCEPT_ID BIGINT, "
        "UNIQUE_DEVICE_ID BIGINT, QUANTITY INT, PROVIDER_ID BIGINT, "
        "VISIT_OCCURRENCE_ID BIGINT, DEVICE_SOURCE_VALUE STRING, "
        "DEVICE_SOURCE_CONCEPT_ID BIGINT"
    ),
    "drug_cost": (
        "DRUG_COST_ID BIGINT NOT NULL, DRUG_EXPOSURE_ID BIGINT NOT NULL, PAID_COPAY FLOAT, "
        "PAID_COINSURANCE FLOAT, PAID_TOWARD_DEDUCTIBLE FLOAT, PAID_BY_PAYER FLOAT, "
        "PAID_BY_COORDINATION_BENEFITS FLOAT, TOTAL_OUT_OF_POCKET FLOAT, TOTAL_PAID FLOAT, "
        "INGREDIENT_COST FLOAT, DISPENSING_FEE FLOAT, AVERAGE_WHOLESALE_PRICE FLOAT, "
        "PAYER_PLAN_PERIOD_ID BIGINT"
    ),
    "drug_era": (
        "DRUG_ERA_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "DRUG_CONCEPT_ID BIGINT NOT NULL, DRUG_ERA_START_DATE DATE NOT NULL, "
        "DRUG_ERA_END_DATE DATE, DRUG_TYPE_CONCEPT_ID BIGINT NOT NULL, "
        "DRUG_EXPOSURE_COUNT INT"
    ),
    "drug_exposure": (
        "DRUG_EXPOSURE_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "DRUG_CONCEPT_ID BIGINT NOT NULL, DRUG_EXPOSURE_START_DATE DATE NOT NULL, "
        "DRUG_EXPOSURE_END_DATE DATE, DRUG_TYPE_CONCEPT_ID BIGINT NOT NULL, "
        "STOP_REASON STRING, REFILLS INT, QUANTITY FLOAT, DAYS_SUPPLY INT, SIG STRING, "
        "ROUTE_CONCEPT_ID BIGINT, EFFECTIVE_DRUG_DOSE FLOAT, DOSE_UNIT_CONCEPT_ID BIGINT, "
        "LOT_NUMBER STRING, PROVIDER_ID BIGINT, VISIT_OCCURRENCE_ID BIGINT, "
        "DRUG_SOURCE_VALUE STRING, DRUG_SOURCE_CONCEPT_ID BIGINT, ROUTE_SOURCE_VALUE STRING, "
        "DOSE_UNIT_SOURCE_VALUE STRING"
    ),
    "location": (
        "LOCATION_ID BIGINT NOT NULL, ADDRESS_1 STRING, ADDRESS_2 STRING, CITY STRING, "
        "STATE STRING, ZIP STRING, COUNTY STRING, LOCATION_SOURCE_VALUE STRING"
    ),
    "measurement": (
        "MEASUREMENT_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "MEASUREMENT_CONCEPT_ID BIGINT NOT NULL, MEASUREMENT_DATE DATE NOT NULL, "
        "MEASUREMENT_TIME STRING, MEASUREMENT_TYPE_CONCEPT_ID BIGINT NOT NULL, "
        "OPERATOR_CONCEPT_ID BIGINT, VALUE_AS_NUMBER FLOAT, VALUE_AS_CONCEPT_ID BIGINT, "
        "UNIT_CONCEPT_ID BIGINT, RANGE_LOW FLOAT, RANGE_HIGH FLOAT, PROVIDER_ID BIGINT, "
        "VISIT_OCCURRENCE_ID BIGINT, MEASUREMENT_SOURCE_VALUE STRING, "
        "MEASUREMENT_SOURCE_CONCEPT_ID BIGINT, UNIT_SOURCE_VALUE STRING, "
        "VALUE_SOURCE_VALUE STRING"
    ),
    "observation": (
        "OBSERVATION_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "OBSERVATION_CONCEPT_ID BIGINT NOT NULL, OBSERVATION_DATE DATE NOT NULL, "
        "OBSERVATION_TIME STRING, OBSERVATION_TYPE_CONCEPT_ID BIGINT NOT NULL, "
        "VALUE_AS_NUMBER FLOAT, VALUE_AS_STRING STRING, VALUE_AS_CONCEPT_ID BIGINT, "
        "QUALIFIER_CONCEPT_ID BIGINT, UNIT_CONCEPT_ID BIGINT, PROVIDER_ID BIGINT, "
        "VISIT_OCCURRENCE_ID BIGINT, OBSERVATION_SOURCE_VALUE STRING, "
        "OBSERVATION_SOURCE_CONCEPT_ID BIGINT, UNIT_SOURCE_VALUE STRING, "
        "QUALIFIER_SOURCE_VALUE STRING"
    ),
    "observation_period": (
        "OBSERVATION_PERIOD_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "OBSERVATION_PERIOD_START_DATE DATE NOT NULL, "
        "OBSERVATION_PERIOD_END_DATE DATE NOT NULL"
    ),
    "organization": (
        "ORGANIZATION_ID BIGINT NOT NULL, PLACE_OF_SERVICE_CONCEPT_ID BIGINT, "
        "LOCATION_ID BIGINT, ORGANIZATION_SOURCE_VALUE STRING, "
        "PLACE_OF_SERVICE_SOURCE_VALUE STRING"
    ),
    "payer_plan_period": (
        "PAYER_PLAN_PERIOD_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "PAYER_PLAN_PERIOD_START_DATE DATE NOT NULL, "
        "PAYER_PLAN_PERIOD_END_DATE DATE NOT NULL, PAYER_SOURCE_VALUE STRING, "
        "PLAN_SOURCE_VALUE STRING, FAMILY_SOURCE_VALUE STRING"
    ),
    "person": (
        "PERSON_ID BIGINT NOT NULL, GENDER_CONCEPT_ID BIGINT NOT NULL, "
        "YEAR_OF_BIRTH INT NOT NULL, MONTH_OF_BIRTH INT, DAY_OF_BIRTH INT, "
        "TIME_OF_BIRTH STRING, RACE_CONCEPT_ID BIGINT, ETHNICITY_CONCEPT_ID BIGINT, "
        "LOCATION_ID BIGINT, PROVIDER_ID BIGINT, CARE_SITE_ID BIGINT, "
        "PERSON_SOURCE_VALUE STRING, GENDER_SOURCE_VALUE STRING, "
        "GENDER_SOURCE_CONCEPT_ID BIGINT, RACE_SOURCE_VALUE STRING, "
        "RACE_SOURCE_CONCEPT_ID BIGINT, ETHNICITY_SOURCE_VALUE STRING, "
        "ETHNICITY_SOURCE_CONCEPT_ID BIGINT"
    ),
    "procedure_cost": (
        "PROCEDURE_COST_ID BIGINT NOT NULL, PROCEDURE_OCCURRENCE INT NOT NULL, "
        "PAID_COPAY FLOAT, PAID_COINSURANCE FLOAT, PAID_TOWARD_DEDUCTIBLE FLOAT, "
        "PAID_BY_PAYER FLOAT, PAID_BY_COORDINATION_BENEFITS FLOAT, "
        "TOTAL_OUT_OF_POCKET FLOAT, TOTAL_PAID FLOAT, DISEASE_CLASS_CONCEPT_ID BIGINT, "
        "REVENUE_CODE_CONCEPT_ID BIGINT, PAYER_PLAN_PERIOD_ID BIGINT, "
        "DISEASE_CLASS_SOURCE_VALUE STRING, REVENUE_CODE_SOURCE_VALUE STRING"
    ),
    "procedure_occurrence": (
        "PROCEDURE_OCCURRENCE_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "PROCEDURE_CONCEPT_ID BIGINT NOT NULL, PROCEDURE_DATE DATE NOT NULL, "
        "PROCEDURE_TYPE_CONCEPT_ID BIGINT NOT NULL, MODIFIER_CONCEPT_ID BIGINT, "
        "QUANTITY INT NOT NULL, PROVIDER_ID BIGINT, VISIT_OCCURRENCE_ID BIGINT, "
        "PROCEDURE_SOURCE_VALUE STRING, PROCEDURE_SOURCE_CONCEPT_ID BIGINT, "
        "QUALIFIER_SOURCE_VALUE STRING"
    ),
    "provider": (
        "PROVIDER_ID BIGINT NOT NULL, PROVIDER_NAME STRING, NPI STRING, DEA STRING, "
        "SPECIALTY_CONCEPT_ID BIGINT, CARE_SITE_ID BIGINT, YEAR_OF_BIRTH INT, "
        "GENDER_CONCEPT_ID BIGINT, PROVIDER_SOURCE_VALUE STRING NOT NULL, "
        "SPECIALTY_SOURCE_VALUE STRING, SPECIALTY_SOURCE_CONCEPT_ID BIGINT, "
        "GENDER_SOURCE_VALUE STRING NOT NULL, GENDER_SOURCE_CONCEPT_ID BIGINT"
    ),
    "visit_occurrence": (
        "VISIT_OCCURRENCE_ID BIGINT NOT NULL, PERSON_ID BIGINT NOT NULL, "
        "VISIT_CONCEPT_ID BIGINT NOT NULL, VISIT_START_DATE DATE NOT NULL, "
        "VISIT_START_TIME STRING, VISIT_END_DATE DATE NOT NULL, VISIT_END_TIME STRING, "
        "VISIT_TYPE_CONCEPT_ID BIGINT NOT NULL, PROVIDER_ID BIGINT, CARE_SITE_ID BIGINT, "
        "VISIT_SOURCE_VALUE STRING, VISIT_SOURCE_CONCEPT_ID BIGINT"
    ),
}

# Date columns that bound an event in time: table -> (start column, end column).
# Tables with a single event date use it for both bounds.
EVENT_DATE_COLUMNS: dict[str, tuple[str, str]] = {
    "condition_occurrence": ("CONDITION_START_DATE", "CONDITION_END_DATE"),
    "procedure_occurrence": ("PROCEDURE_DATE", "PROCEDURE_DATE"),
    "visit_occurrence": ("VISIT_START_DATE", "VISIT_END_DATE"),
    "measurement": ("MEASUREMENT_DATE", "MEASUREMENT_DATE"),
    "observation": ("OBSERVATION_DATE", "OBSERVATION_DATE"),
    "device_exposure": ("DEVICE_EXPOSURE_START_DATE", "DEVICE_EXPOSURE_END_DATE"),
}
# ---------------------------------------------------------------------------

_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "FLOAT": T.FloatType(),
    "DATE": T.DateType(),
}


def _field(ddl: str) -> T.StructField:
    name, kind, *rest = ddl.split()
    return T.StructField(name, _TYPES[kind], rest != ["NOT", "NULL"])


def table_schema(table: str) -> T.StructType:
    """The typed layout of an OMOP table (dates as ``DateType``)."""
    try:
        spec = OMOP_TABLE_COLUMNS[table]
    except KeyError:
        raise KeyError(f"no OMOP layout for table {table!r}") from None
    return T.StructType([_field(s.strip()) for s in spec.split(",")])


def known_tables() -> list[str]:
    return sorted(OMOP_TABLE_COLUMNS)
