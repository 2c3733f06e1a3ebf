"""Equivalent SQL of every registered query, for an independent engine
(DuckDB) over the same parquet tables.

The SQL is written the plain way — range predicates in join conditions,
full outer / left joins of separate counts — so it checks the Spark plans
(bucketed range joins, single tagged aggregations) against a different
formulation of the same semantics.
"""

from __future__ import annotations

from wardstat.operators.codes import (REPORT_COLUMN_HEADER, REPORT_GRAND_TOTAL,
                                     REPORT_PROCEDURE_HEADER, REPORT_PROCEDURE_TOTAL)
from wardstat.plans import params as P
from wardstat.sources.adapter import CONDITION_TYPE_BY_FLAG, DEATH_EPOCH, PROCEDURE_TYPE_BY_FLAG


def _case(flag: str, mapping: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {flag} {whens} END AS BIGINT)"


def _values(mapping: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{proc}', {p_ord}, {i}, '{code}')"
                     for p_ord, (proc, codes) in enumerate(mapping.items())
                     for i, code in enumerate(codes))
    return (f"SELECT procedure, CAST(proc_ord AS BIGINT) AS proc_ord, "
            f"CAST(ord AS INTEGER) AS ord, code FROM (VALUES {rows}) "
            f"AS t(procedure, proc_ord, ord, code)")


def _in(values) -> str:
    return ", ".join(str(v) for v in values)


CT = _in(P.READMISSION.primary_condition_types)
PT = _in(P.READMISSION.primary_procedure_types)
DAYS = P.READMISSION_DAYS

ADAPTER = f"""
o_person AS (
  SELECT c_custkey AS PERSON_ID,
         1920 + c_custkey % 80 AS YEAR_OF_BIRTH,
         CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS GENDER_SOURCE_VALUE,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS CARE_SITE_ID
  FROM customer),
o_visit AS (
  SELECT o_orderkey AS VISIT_OCCURRENCE_ID, o_custkey AS PERSON_ID,
         CAST(o_orderdate AS DATE) AS VISIT_START_DATE,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS VISIT_END_DATE,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 100 END AS PROVIDER_ID
  FROM orders),
o_line AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, o_custkey,
         CAST(o_orderdate AS DATE) + CAST(l_linenumber - 1 AS INTEGER) AS edate, p_brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
o_condition AS (
  SELECT l_orderkey * 10 + l_linenumber AS CONDITION_OCCURRENCE_ID, o_custkey AS PERSON_ID,
         edate AS CONDITION_START_DATE,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE edate END AS CONDITION_END_DATE,
         {_case('l_returnflag', CONDITION_TYPE_BY_FLAG)} AS CONDITION_TYPE_CONCEPT_ID,
         l_orderkey AS VISIT_OCCURRENCE_ID, p_brand AS CONDITION_SOURCE_VALUE
  FROM o_line WHERE l_linenumber % 2 = 1),
o_procedure AS (
  SELECT l_orderkey * 10 + l_linenumber AS PROCEDURE_OCCURRENCE_ID, o_custkey AS PERSON_ID,
         edate AS PROCEDURE_DATE,
         {_case('l_returnflag', PROCEDURE_TYPE_BY_FLAG)} AS PROCEDURE_TYPE_CONCEPT_ID,
         l_orderkey AS VISIT_OCCURRENCE_ID, p_brand AS PROCEDURE_SOURCE_VALUE
  FROM o_line WHERE l_linenumber % 2 = 0),
o_death AS (
  SELECT c_custkey AS PERSON_ID,
         DATE '{DEATH_EPOCH}' + CAST(c_custkey % 1000 AS INTEGER) AS DEATH_DATE
  FROM customer WHERE c_custkey % 10 = 0),
o_descr AS (SELECT p_brand AS code, min(p_name) AS description FROM part GROUP BY p_brand),
o_diag AS ({_values(P.DIAGNOSIS_CODES)}),
o_compl AS ({_values(P.COMPLICATION_CODES)})"""

PERSON_COLS = "PERSON_ID, YEAR_OF_BIRTH, GENDER_SOURCE_VALUE, CARE_SITE_ID"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((ADAPTER,) + ctes) + "\n"


def _stays_ctes(cond: str = "o_condition", proc: str = "o_procedure") -> tuple[str, ...]:
    """Index stays / complication stays / readmissions / deaths, written
    plainly (range predicates in the join)."""
    return (
        "o_both AS (SELECT DISTINCT procedure FROM o_diag "
        "WHERE procedure IN (SELECT procedure FROM o_compl))",
        f"""o_stay_c AS (
  SELECT DISTINCT d.procedure, c.PERSON_ID, v.VISIT_END_DATE, v.PROVIDER_ID,
         c.CONDITION_SOURCE_VALUE AS SOURCE_VALUE
  FROM {cond} c
  JOIN (SELECT DISTINCT procedure, code FROM o_diag
        WHERE procedure IN (SELECT procedure FROM o_both)) d
    ON c.CONDITION_SOURCE_VALUE = d.code
  JOIN o_visit v ON c.PERSON_ID = v.PERSON_ID
   AND c.CONDITION_START_DATE >= v.VISIT_START_DATE
   AND c.CONDITION_START_DATE <= v.VISIT_END_DATE
  WHERE c.CONDITION_TYPE_CONCEPT_ID IN ({CT}))""",
        f"""o_stay_p AS (
  SELECT DISTINCT d.procedure, p.PERSON_ID, v.VISIT_END_DATE, v.PROVIDER_ID,
         p.PROCEDURE_SOURCE_VALUE AS SOURCE_VALUE
  FROM {proc} p
  JOIN (SELECT DISTINCT procedure, code FROM o_diag
        WHERE procedure IN (SELECT procedure FROM o_both)) d
    ON p.PROCEDURE_SOURCE_VALUE = d.code
  JOIN o_visit v ON p.PERSON_ID = v.PERSON_ID
   AND p.PROCEDURE_DATE >= v.VISIT_START_DATE
   AND p.PROCEDURE_DATE <= v.VISIT_END_DATE
  WHERE p.PROCEDURE_TYPE_CONCEPT_ID IN ({PT}))""",
        """o_index AS (
  SELECT procedure, 'C' AS branch, PERSON_ID, VISIT_END_DATE, PROVIDER_ID, SOURCE_VALUE FROM o_stay_c
  UNION ALL
  SELECT procedure, 'P' AS branch, PERSON_ID, VISIT_END_DATE, PROVIDER_ID, SOURCE_VALUE FROM o_stay_p)""",
        f"""o_cstay AS (
  SELECT DISTINCT x.procedure, c.PERSON_ID, v.VISIT_START_DATE, v.PROVIDER_ID,
         c.CONDITION_SOURCE_VALUE AS SOURCE_VALUE
  FROM {cond} c
  JOIN (SELECT DISTINCT procedure, code FROM o_compl) x ON c.CONDITION_SOURCE_VALUE = x.code
  JOIN o_visit v ON c.PERSON_ID = v.PERSON_ID
   AND c.CONDITION_START_DATE >= v.VISIT_START_DATE
   AND c.CONDITION_START_DATE <= v.VISIT_END_DATE
  WHERE c.CONDITION_TYPE_CONCEPT_ID IN ({CT}))""",
        f"""o_readm AS (
  SELECT DISTINCT i.procedure, i.PERSON_ID, i.VISIT_END_DATE, i.PROVIDER_ID, x.SOURCE_VALUE
  FROM o_index i JOIN o_cstay x
    ON i.procedure = x.procedure AND i.PERSON_ID = x.PERSON_ID
   AND i.VISIT_END_DATE < x.VISIT_START_DATE
   AND x.VISIT_START_DATE < i.VISIT_END_DATE + {DAYS})""",
        f"""o_deaths AS (
  SELECT DISTINCT i.procedure, i.PERSON_ID, i.VISIT_END_DATE, i.PROVIDER_ID, 0 AS SOURCE_VALUE
  FROM o_index i JOIN o_death d ON i.PERSON_ID = d.PERSON_ID
   AND d.DEATH_DATE < i.VISIT_END_DATE + {DAYS})""",
        f"""o_deaths_after AS (
  SELECT DISTINCT i.procedure, i.PERSON_ID, i.VISIT_END_DATE, i.PROVIDER_ID, 0 AS SOURCE_VALUE
  FROM o_index i JOIN o_death d ON i.PERSON_ID = d.PERSON_ID
   AND d.DEATH_DATE >= i.VISIT_END_DATE
   AND d.DEATH_DATE < i.VISIT_END_DATE + {DAYS})""",
    )


def _scorecard(readm: str = "o_readm", deaths: str = "o_deaths") -> str:
    """Left joins on the raw provider id, then nulls -> 0."""
    return f"""
SELECT pc.procedure, COALESCE(pc.PROVIDER_ID, 0) AS PROVIDER_ID, pc.PROCEDURE_COUNT,
       COALESCE(rc.n, 0) AS READMISSION_COUNT, COALESCE(dc.n, 0) AS DEATH_COUNT,
       COALESCE(rc.n, 0) + COALESCE(dc.n, 0) AS COMPLICATION_COUNT,
       CAST(COALESCE(rc.n, 0) + COALESCE(dc.n, 0) AS DOUBLE) / pc.PROCEDURE_COUNT AS PERCENTAGE
FROM (SELECT procedure, PROVIDER_ID, count(*) AS PROCEDURE_COUNT FROM o_index GROUP BY 1, 2) pc
LEFT JOIN (SELECT procedure, PROVIDER_ID, count(*) AS n FROM {readm} GROUP BY 1, 2) rc
  ON pc.procedure = rc.procedure AND pc.PROVIDER_ID = rc.PROVIDER_ID
LEFT JOIN (SELECT procedure, PROVIDER_ID, count(*) AS n FROM {deaths} GROUP BY 1, 2) dc
  ON pc.procedure = dc.procedure AND pc.PROVIDER_ID = dc.PROVIDER_ID"""


def _freq(cond_where: str = "", proc_where: str = "") -> str:
    return f"""(
  SELECT SOURCE_VALUE, COALESCE(COUNT_CO, 0) AS COUNT_CO, COALESCE(COUNT_PO, 0) AS COUNT_PO,
         COALESCE(COUNT_CO, 0) + COALESCE(COUNT_PO, 0) AS COUNT
  FROM (SELECT CONDITION_SOURCE_VALUE AS SOURCE_VALUE, count(*) AS COUNT_CO
        FROM o_condition {cond_where} GROUP BY 1) co
  FULL OUTER JOIN (SELECT PROCEDURE_SOURCE_VALUE AS SOURCE_VALUE, count(*) AS COUNT_PO
        FROM o_procedure {proc_where} GROUP BY 1) po USING (SOURCE_VALUE))"""


def _report(dict_cte: str, primary: bool) -> str:
    f = (_freq(f"WHERE CONDITION_TYPE_CONCEPT_ID IN ({CT})",
               f"WHERE PROCEDURE_TYPE_CONCEPT_ID IN ({PT})") if primary else _freq())
    return f"""
SELECT d.procedure, d.proc_ord, d.ord, d.code, COALESCE(f.COUNT, 0) AS COUNT,
       COALESCE(ds.description, '') AS DESCRIPTION
FROM {dict_cte} d
LEFT JOIN {f} f ON f.SOURCE_VALUE = d.code
LEFT JOIN o_descr ds ON ds.code = d.code"""


_EV_START, _EV_END = P.EVENTS_START.isoformat(), P.EVENTS_END.isoformat()
_SITES = _in(P.CARE_SITES)

FC = P.FULL_COHORT
_FC_START, _FC_END = FC.events_start_date.isoformat(), FC.events_end_date.isoformat()
_FC_SITES = _in(FC.exclude_care_sites)
FULL_COHORT_CTES = (
    f"""f_condition AS (SELECT * FROM o_condition
  WHERE CONDITION_START_DATE >= DATE '{_FC_START}' AND CONDITION_END_DATE <= DATE '{_FC_END}')""",
    f"""f_procedure AS (SELECT * FROM o_procedure
  WHERE PROCEDURE_DATE >= DATE '{_FC_START}' AND PROCEDURE_DATE <= DATE '{_FC_END}')""",
    f"""f_visit AS (SELECT * FROM o_visit
  WHERE VISIT_START_DATE >= DATE '{_FC_START}' AND VISIT_END_DATE <= DATE '{_FC_END}')""",
    f"""f_person AS (
  SELECT * FROM o_person
  WHERE YEAR_OF_BIRTH <= {FC.year_of_birth_max} AND YEAR_OF_BIRTH >= {FC.year_of_birth_min}
    AND GENDER_SOURCE_VALUE <> 'Male'
    AND (NOT CARE_SITE_ID IN ({_FC_SITES}) OR CARE_SITE_ID IS NULL)
    AND PERSON_ID NOT IN (SELECT PERSON_ID FROM o_death)
    AND PERSON_ID IN (SELECT PERSON_ID FROM f_visit)
    AND (PERSON_ID IN (SELECT PERSON_ID FROM f_condition WHERE CONDITION_TYPE_CONCEPT_ID IN ({CT}))
      OR PERSON_ID IN (SELECT PERSON_ID FROM f_procedure WHERE PROCEDURE_TYPE_CONCEPT_ID IN ({PT}))))""",
    """fc_condition AS (SELECT * FROM f_condition WHERE PERSON_ID IN (SELECT PERSON_ID FROM f_person))""",
    """fc_procedure AS (SELECT * FROM f_procedure WHERE PERSON_ID IN (SELECT PERSON_ID FROM f_person))""",
)


def _cohort_scorecard() -> str:
    # The cohort's visits are date-bounded too: swap the visit CTE name.
    ctes = tuple(c.replace("JOIN o_visit v", "JOIN f_visit v")
                 for c in _stays_ctes("fc_condition", "fc_procedure"))
    return _with(*FULL_COHORT_CTES, *ctes) + _scorecard()


ORACLE_SQL: dict[str, str] = {
    "cohort_birth_year": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    f"WHERE YEAR_OF_BIRTH <= {P.BIRTH_YEAR_MAX} AND YEAR_OF_BIRTH >= {P.BIRTH_YEAR_MIN}",
    "cohort_exclude_male": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    "WHERE GENDER_SOURCE_VALUE <> 'Male'",
    "cohort_exclude_female": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    "WHERE GENDER_SOURCE_VALUE <> 'Female'",
    "cohort_exclude_sites": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    f"WHERE NOT CARE_SITE_ID IN ({_SITES}) OR CARE_SITE_ID IS NULL",
    "cohort_include_sites": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    f"WHERE CARE_SITE_ID IN ({_SITES})",
    "cohort_event_dates_condition": _with() +
    "SELECT CONDITION_OCCURRENCE_ID, PERSON_ID, CONDITION_START_DATE, CONDITION_END_DATE "
    f"FROM o_condition WHERE CONDITION_START_DATE >= DATE '{_EV_START}' "
    f"AND CONDITION_END_DATE <= DATE '{_EV_END}'",
    "cohort_event_dates_procedure": _with() +
    "SELECT PROCEDURE_OCCURRENCE_ID, PERSON_ID, PROCEDURE_DATE FROM o_procedure "
    f"WHERE PROCEDURE_DATE >= DATE '{_EV_START}' AND PROCEDURE_DATE <= DATE '{_EV_END}'",
    "cohort_event_dates_visit": _with() +
    "SELECT VISIT_OCCURRENCE_ID, PERSON_ID, VISIT_START_DATE, VISIT_END_DATE FROM o_visit "
    f"WHERE VISIT_START_DATE >= DATE '{_EV_START}' AND VISIT_END_DATE <= DATE '{_EV_END}'",
    "cohort_with_visit": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    "WHERE PERSON_ID IN (SELECT PERSON_ID FROM o_visit)",
    "cohort_inpatient_only": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    f"WHERE PERSON_ID IN (SELECT PERSON_ID FROM o_condition WHERE CONDITION_TYPE_CONCEPT_ID IN ({CT})) "
    f"OR PERSON_ID IN (SELECT PERSON_ID FROM o_procedure WHERE PROCEDURE_TYPE_CONCEPT_ID IN ({PT}))",
    "cohort_exclude_dead": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    "WHERE PERSON_ID NOT IN (SELECT PERSON_ID FROM o_death)",
    "cohort_exclude_alive": _with() + f"SELECT {PERSON_COLS} FROM o_person "
    "WHERE PERSON_ID IN (SELECT PERSON_ID FROM o_death)",
    "cohort_full": _with(*FULL_COHORT_CTES) + f"SELECT {PERSON_COLS} FROM f_person",
    "cohort_extract_person": _with(*FULL_COHORT_CTES) +
    "SELECT PERSON_ID, CAST(YEAR_OF_BIRTH AS INTEGER) AS YEAR_OF_BIRTH, GENDER_SOURCE_VALUE, "
    "CAST(CARE_SITE_ID AS BIGINT) AS CARE_SITE_ID FROM f_person",
    "cohort_extract_visit": _with(*FULL_COHORT_CTES) +
    "SELECT VISIT_OCCURRENCE_ID, PERSON_ID, VISIT_START_DATE, VISIT_END_DATE, PROVIDER_ID "
    "FROM f_visit",
    "yearly_combine": "SELECT CAST(year(o_orderdate) AS INTEGER) AS YEAR, "
    "CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate "
    "FROM orders",
    "condition_type_count": _with() +
    "SELECT CONDITION_TYPE_CONCEPT_ID, count(*) AS COUNT FROM o_condition GROUP BY 1",
    "procedure_type_count": _with() +
    "SELECT PROCEDURE_TYPE_CONCEPT_ID, count(*) AS COUNT FROM o_procedure GROUP BY 1",
    "code_filter": _with() +
    "SELECT CONDITION_OCCURRENCE_ID, PERSON_ID, CONDITION_SOURCE_VALUE FROM o_condition "
    "WHERE CONDITION_SOURCE_VALUE IN (" +
    ", ".join(f"'{c}'" for c in P.DIAGNOSIS_CODES["A"]) + ")",
    "code_frequency": _with() + "SELECT * FROM " + _freq(),
    "code_frequency_primary": _with() + "SELECT * FROM " + _freq(
        f"WHERE CONDITION_TYPE_CONCEPT_ID IN ({CT})", f"WHERE PROCEDURE_TYPE_CONCEPT_ID IN ({PT})"),
    "code_report_all": _with() + _report("o_diag", False),
    "code_report_primary": _with() + _report("o_diag", True),
    "complication_code_report_all": _with() + _report("o_compl", False),
    "complication_code_report_primary": _with() + _report("o_compl", True),
    "code_report_totals": _with("o_rep AS (" + _report("o_diag", False) + ")") +
    "SELECT procedure, CAST(sum(COUNT) AS BIGINT) AS TOTAL FROM o_rep GROUP BY ROLLUP (procedure)",
    "code_report_lines": _with("o_rep AS (" + _report("o_diag", True) + ")",
                               "o_tot AS (SELECT procedure, CAST(sum(COUNT) AS BIGINT) AS TOTAL "
                               "FROM o_rep GROUP BY ROLLUP (procedure))",
                               "o_pp AS (SELECT DISTINCT procedure, proc_ord FROM o_rep)") + f"""
SELECT proc_ord, 0 AS seq, 0 AS ord, '{REPORT_PROCEDURE_HEADER}' || procedure AS line FROM o_pp
UNION ALL SELECT proc_ord, 0, 1, '{REPORT_COLUMN_HEADER}' FROM o_pp
UNION ALL SELECT proc_ord, 1, ord, code || ',' || CAST(COUNT AS VARCHAR) || ',' || DESCRIPTION
  FROM o_rep
UNION ALL SELECT p.proc_ord, 2, 0, '{REPORT_PROCEDURE_TOTAL}' || CAST(t.TOTAL AS VARCHAR)
  FROM o_tot t JOIN o_pp p ON t.procedure = p.procedure
UNION ALL SELECT p.proc_ord, 2, 1, '' FROM o_tot t JOIN o_pp p ON t.procedure = p.procedure
UNION ALL SELECT CAST(NULL AS BIGINT), 3, 0,
  '{REPORT_GRAND_TOTAL}' || CAST(COALESCE(TOTAL, 0) AS VARCHAR)
  FROM o_tot WHERE procedure IS NULL""",
    "inpatient_stays_condition": _with() + f"""
SELECT DISTINCT d.procedure, c.PERSON_ID, v.VISIT_END_DATE, v.PROVIDER_ID,
       c.CONDITION_SOURCE_VALUE AS SOURCE_VALUE
FROM o_condition c JOIN (SELECT DISTINCT procedure, code FROM o_diag) d
  ON c.CONDITION_SOURCE_VALUE = d.code
JOIN o_visit v ON c.PERSON_ID = v.PERSON_ID
 AND c.CONDITION_START_DATE BETWEEN v.VISIT_START_DATE AND v.VISIT_END_DATE
WHERE c.CONDITION_TYPE_CONCEPT_ID IN ({CT})""",
    "inpatient_stays_procedure": _with() + f"""
SELECT DISTINCT d.procedure, p.PERSON_ID, v.VISIT_END_DATE, v.PROVIDER_ID,
       p.PROCEDURE_SOURCE_VALUE AS SOURCE_VALUE
FROM o_procedure p JOIN (SELECT DISTINCT procedure, code FROM o_diag) d
  ON p.PROCEDURE_SOURCE_VALUE = d.code
JOIN o_visit v ON p.PERSON_ID = v.PERSON_ID
 AND p.PROCEDURE_DATE BETWEEN v.VISIT_START_DATE AND v.VISIT_END_DATE
WHERE p.PROCEDURE_TYPE_CONCEPT_ID IN ({PT})""",
    "index_stays": _with(*_stays_ctes()) + "SELECT * FROM o_index",
    "complication_stays": _with(*_stays_ctes()) +
    "SELECT * FROM o_cstay WHERE procedure IN (SELECT procedure FROM o_both)",
    "readmissions": _with(*_stays_ctes()) + "SELECT * FROM o_readm",
    "deaths_after_stay": _with(*_stays_ctes()) + "SELECT * FROM o_deaths",
    "provider_event_count": _with(*_stays_ctes()) +
    "SELECT procedure, PROVIDER_ID, count(*) AS COUNT FROM o_index GROUP BY 1, 2",
    "provider_scorecard": _with(*_stays_ctes()) + _scorecard(),
    "provider_scorecard_cohort_only": _cohort_scorecard(),
    "provider_scorecard_after_discharge": _with(*_stays_ctes()) +
    _scorecard(deaths="o_deaths_after"),
    "readmission_code_count": _with(*_stays_ctes()) +
    "SELECT procedure, SOURCE_VALUE, count(*) AS COUNT FROM o_readm GROUP BY 1, 2",
    "readmission_code_report": _with(*_stays_ctes()) + """
SELECT x.procedure, x.proc_ord, x.ord, x.code, COALESCE(r.n, 0) AS COUNT,
       COALESCE(ds.description, '') AS DESCRIPTION
FROM o_compl x
LEFT JOIN (SELECT procedure, SOURCE_VALUE, count(*) AS n FROM o_readm GROUP BY 1, 2) r
  ON r.procedure = x.procedure AND r.SOURCE_VALUE = x.code
LEFT JOIN o_descr ds ON ds.code = x.code""",
}


def _dated(key: str, start: str, end: str | None = None) -> str:
    day = "CAST(ts AS DATE)"
    last = (f", CASE WHEN event_id % 5 <> 0 THEN {day} + CAST(event_id % 4 AS INTEGER) END AS {end}"
            if end else "")
    return (f"SELECT * FROM (SELECT event_id AS {key}, user_id AS PERSON_ID, {day} AS {start}{last} "
            f"FROM events) WHERE {start} >= DATE '{P.STREAM_START}' "
            f"AND {end or start} <= DATE '{P.STREAM_END}'")


_VISIT = "SELECT VISIT_OCCURRENCE_ID, PERSON_ID, VISIT_START_DATE, VISIT_END_DATE, PROVIDER_ID FROM "

# Sources and sinks: what was written is what is read back.
ORACLE_SQL |= {
    "cohort_extract_condition": _with(*FULL_COHORT_CTES) +
    "SELECT CONDITION_OCCURRENCE_ID, PERSON_ID, CONDITION_START_DATE, CONDITION_END_DATE, "
    "CONDITION_SOURCE_VALUE FROM f_condition",
    "cohort_extract_procedure": _with(*FULL_COHORT_CTES) +
    "SELECT PROCEDURE_OCCURRENCE_ID, PERSON_ID, PROCEDURE_DATE, PROCEDURE_SOURCE_VALUE "
    "FROM f_procedure",
    "cohort_extract_death": _with() + "SELECT PERSON_ID, DEATH_DATE FROM o_death",
    "extract_text": _with() + """SELECT PERSON_ID, CASE PERSON_ID % 6 WHEN 0 THEN ' padded '
  WHEN 1 THEN '' WHEN 2 THEN 'two' || chr(10) || 'lines'
  WHEN 3 THEN 'say "a' || chr(92) || 'b", 100%' WHEN 4 THEN 'x,' || PERSON_ID
  END AS PERSON_SOURCE_VALUE FROM o_person""",
    "csv_header_drift": _with() + _VISIT + "o_visit",
    "events_in_long_periods": _with() + """
SELECT p.PERSON_ID, PROVIDERS, FROM_DATE, TO_DATE, count(*) AS EVENTS
FROM (SELECT PERSON_ID, coalesce(PROVIDER_ID % 3, 3) AS PROVIDERS,
             min(VISIT_START_DATE) AS FROM_DATE, max(VISIT_END_DATE) AS TO_DATE
      FROM o_visit GROUP BY 1, 2) p
JOIN o_condition c ON c.PERSON_ID = p.PERSON_ID
 AND CONDITION_START_DATE BETWEEN FROM_DATE AND TO_DATE
GROUP BY ALL""",
    "csv_many_files": _with() + _VISIT + "o_visit",
    "csv_malformed_drop": _with() + _VISIT + "o_visit WHERE VISIT_OCCURRENCE_ID % 13 <> 0 "
    "AND VISIT_OCCURRENCE_ID % 11 <> 3",
    "code_dictionary_file": "SELECT p_type || '/' || p_brand AS procedure, "
    "CAST(row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS INTEGER) "
    "AS ord, CAST(p_partkey AS VARCHAR) AS code FROM part",
    "code_descriptions_file": "SELECT CAST(p_partkey AS VARCHAR) AS code, "
    "rtrim(p_name) AS description FROM part",
    "code_report_sieved": ORACLE_SQL["code_report_all"],
    "cohort_repeated_persons": _with() + """
, rows AS (
  SELECT PERSON_ID, YEAR_OF_BIRTH, GENDER_SOURCE_VALUE, CARE_SITE_ID FROM o_person UNION ALL
  SELECT PERSON_ID, YEAR_OF_BIRTH + PERSON_ID % 3 - 1, GENDER_SOURCE_VALUE, NULL FROM o_person)
SELECT PERSON_ID, YEAR_OF_BIRTH, GENDER_SOURCE_VALUE, CARE_SITE_ID FROM rows
WHERE PERSON_ID IN (SELECT PERSON_ID FROM o_condition WHERE CONDITION_TYPE_CONCEPT_ID IN (""" + CT + """)
                    UNION SELECT PERSON_ID FROM o_procedure
                    WHERE PROCEDURE_TYPE_CONCEPT_ID IN (""" + PT + """))
QUALIFY row_number() OVER (PARTITION BY PERSON_ID ORDER BY YEAR_OF_BIRTH NULLS FIRST,
                           GENDER_SOURCE_VALUE NULLS FIRST, CARE_SITE_ID NULLS FIRST) = 1""",
    "code_dictionary_override": """
WITH a AS (SELECT DISTINCT 'brand ' || p_brand AS k, p_type AS code FROM part),
b AS (SELECT 'brand ' || p_brand AS k, p_partkey::VARCHAR AS code FROM part UNION
      SELECT 'type ' || p_type, p_partkey::VARCHAR FROM part),
n AS (SELECT count(DISTINCT k) AS n FROM a),
ord AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS proc_ord FROM (SELECT DISTINCT k FROM a)
        UNION ALL
        SELECT k, proc_ord FROM (SELECT k, n + row_number() OVER (ORDER BY k) - 1 AS proc_ord
                                 FROM (SELECT DISTINCT k FROM b), n)
        WHERE k NOT IN (SELECT k FROM a))
SELECT k AS procedure, proc_ord::BIGINT AS proc_ord,
       CAST(row_number() OVER (PARTITION BY k ORDER BY code) - 1 AS INTEGER) AS ord, code
FROM b JOIN ord USING (k)""",
    "code_descriptions_override": "SELECT p_brand AS code, rtrim(arg_max(p_name, p_partkey)) "
    "AS description FROM part GROUP BY 1",
    "single_csv": ORACLE_SQL["condition_type_count"],
    "cohort_size": _with(*FULL_COHORT_CTES) + "SELECT count(*) AS persons FROM f_person",
    "scorecard_files": ORACLE_SQL["provider_scorecard"],
    "report_text_file": "SELECT CAST(row_number() OVER (ORDER BY proc_ord NULLS LAST, seq, ord) - 1 "
    "AS INTEGER) AS line_no, line FROM (" + ORACLE_SQL["code_report_lines"] + ")",
    "event_dates_measurement": _dated("MEASUREMENT_ID", "MEASUREMENT_DATE"),
    "event_dates_observation": _dated("OBSERVATION_ID", "OBSERVATION_DATE"),
    "event_dates_device": _dated("DEVICE_EXPOSURE_ID", "DEVICE_EXPOSURE_START_DATE",
                                 "DEVICE_EXPOSURE_END_DATE"),
}
