"""Evidence operators: line items as toxicity studies, orders as cancer calls, parts as a regulatory list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import text as txt
from dosescreen.operators import evidence
from dosescreen.operators.joins import join_on
from dosescreen.operators.reshape import rename
from workload.exposure_queries import case_sql, has
from workload.registry import query, table

CLASSES = {
    "1-URGENT": "Reproductive", "2-HIGH": "developmental", "3-MEDIUM": "Reproductive Developmental",
    "4-NOT SPECIFIED": "developmental neurotoxicity", "5-LOW": "chronic",
}
SPECIES = {"O": "mammals", "F": "mammals (rodent)", "P": "birds"}
KINDS = {"1": "LOAEL", "2": "NOAEL", "3": "BMDL", "4": "NOEL", "5": "LD50", "6": "LOEL", "7": "NEL"}
QUALIFIERS = {"AF": "=", "AO": "<", "NF": ">", "NO": "~", "RF": ">=", "RO": "<="}
CALLS = {
    "1-URGENTO": "Likely Human Carcinogen", "5-LOWO": "Not Likely to Be Carcinogenic in Humans",
    "5-LOWF": "Not Likely to Be Carcinogenic in Humans", "2-HIGHO": "Not Yet  Determined",
    "2-HIGHF": "Inadequate for an assessment of carcinogenic potential",
    "2-HIGHP": "Group VA: CEPA (inadequate data for evaluation)", "3-MEDIUMO": "C (Possible human carcinogen)",
}
TOXICITIES = {"STANDARD": "cancer", "LARGE": "developmental", "SMALL": "cancer, developmental", "MEDIUM": "female"}
SHORT = {
    "Invivo effect < 100 mg/kg-day": "effect_below", "No invivo effect >= 100 mg/kg-day": "no_effect_above",
    "Invivo effect < 100 mg/kg-day (ToxValDb)": "effect_below",
    "No invivo effect >= 100 mg/kg-day (ToxValDb)": "no_effect_above", "Other (ToxValDb)": "other",
    "Nhanes": "survey", fixed.MAMMARY_COLUMN: "mammary", "Carcinogencity": "cancer_calls", "Carcinogencity (ToxValDb)": "cancer_calls",
    "Prop65": "listed", fixed.CANCER_SUMMARY: "cancer_summary", fixed.TOXICITY_SUMMARY: "toxicity_summary",
    "CAS No.": "cas_no", "Type of Toxicity": "toxicity", "Chemical": "chemical",
}


def studies(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("casrn"),
        txt.recode("o_orderpriority", CLASSES).alias("risk_assessment_class"),
        txt.recode("o_orderstatus", SPECIES).alias("species_supercategory"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", txt.recode(F.col("l_linenumber").cast("string"), KINDS).alias("toxval_type"),
        txt.recode(F.concat("l_returnflag", "l_linestatus"), QUALIFIERS).alias("toxval_numeric_qualifier"),
        (F.col("l_quantity") * 4).alias("toxval_numeric"),
        F.when(F.col("l_discount") < 0.08, "mg/kg-day").otherwise("ppm").alias("toxval_units"),
    )
    return join_on(lines, orders, {"l_orderkey": "o_orderkey"}, "inner")


def calls(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    call = txt.recode(F.concat("o_orderpriority", "o_orderstatus"), CALLS)
    return orders.select(F.col("o_custkey").cast("string").alias("casrn"), call.alias("cancer_call"))


def listed(spark, folder) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    cells = {
        "STANDARD": F.concat(key, F.lit(" / "), size), "LARGE": F.concat(key, F.lit("; "), size),
        "SMALL": F.concat(key, F.lit("/"), size, F.lit("/"), F.lit("x")), "MEDIUM": F.concat(F.lit(" "), key, F.lit(" ")),
        "PROMO": F.lit("---"),
    }
    identifier = None
    for kind, cell in cells.items():
        test = F.col("p_type") == kind
        identifier = F.when(test, cell) if identifier is None else identifier.when(test, cell)
    return table(spark, folder, "part").select(
        F.when(F.col("p_size") == 50, F.concat("p_name", F.lit(" (Delisted)"))).otherwise(F.col("p_name"))
        .alias("Chemical"),
        identifier.alias("CAS No."),
        F.when(F.col("p_type").isin(list(TOXICITIES)), txt.recode("p_type", TOXICITIES)).alias("Type of Toxicity"),
    )


def merged(spark, folder) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("chnm"), F.col("c_custkey").cast("string").alias("casn")
    )

    def ids(name, column):
        return table(spark, folder, name).select(F.col(column).cast("string").alias("id"))

    return evidence.evidence_matrix(
        customers, evidence.evidence_flags(evidence.classify_studies(studies(spark, folder))),
        evidence.call_classes(calls(spark, folder)),
        evidence.list_flags(evidence.clean_list(listed(spark, folder))),
        ids("events", "user_id"), ids("supplier", "s_suppkey"), ids("benchmark", "item_id"),
        survey_key="id", developmental_key="id", carcinogens_key="id",
    )


STUDIES = f"""st AS (
  SELECT l_orderkey, l_linenumber, CAST(o_custkey AS VARCHAR) AS casrn,
    lower({case_sql('o_orderpriority', CLASSES)}) AS risk, {case_sql('o_orderstatus', SPECIES)} AS species,
    {case_sql('CAST(l_linenumber AS VARCHAR)', KINDS)} AS tt,
    {case_sql('l_returnflag || l_linestatus', QUALIFIERS)} AS q, l_quantity * 4 AS v,
    CASE WHEN l_discount < 0.08 THEN 'mg/kg-day' ELSE 'ppm' END AS u
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
st2 AS (SELECT *, CASE WHEN {has('risk', 'repro|dev')} AND risk <> 'developmental neurotoxicity'
  AND {has('species', 'mammals')} THEN 1 ELSE 0 END AS is_study FROM st),
st3 AS (SELECT *, CASE WHEN is_study = 1 AND tt IN ('BMDL','ED10','LEL','LOAEC','LOAEL','LOEC','LOEL','BMC05') THEN 'effect'
    WHEN is_study = 1 AND tt IN ('HNEL','NEL','NOAEC','NOAEL','NOEL','NOEC') THEN 'no effect' END AS value_kind,
  CASE WHEN is_study = 1 AND risk = 'reproductive developmental' THEN 'repro/dev'
    WHEN {has('risk', 'repro')} THEN 'reproductive' WHEN is_study = 1 AND {has('risk', 'dev')} THEN 'developmental'
    ELSE '' END AS study_type FROM st2),
st4 AS (SELECT *, CASE WHEN is_study = 0 THEN 'not a developmental or reproductive risk assessment'
    WHEN value_kind = 'effect' AND q IN ('=','<','<=','~') AND v < 100 AND u = 'mg/kg-day'
      THEN 'toxicant with effect level < 100'
    WHEN value_kind = 'effect' AND q IN ('=','>','>=','~') AND v >= 100 AND u = 'mg/kg-day'
      THEN 'toxicant with effect level >= 100'
    WHEN value_kind = 'no effect' AND q IN ('=','<','<=','~') AND v < 100 AND u = 'mg/kg-day'
      THEN 'NOEL less than 100 mg/kg-day'
    WHEN value_kind = 'no effect' AND q IN ('=','>','>=','~') AND v >= 100 AND u = 'mg/kg-day'
      THEN 'unlikely (NOEL over 100 mg/kg-day)'
    ELSE 'uncategorized (vague toxicity value or different units)' END AS effect_type FROM st3),
studies AS (SELECT l_orderkey, l_linenumber, tt AS toxval_type, q AS toxval_numeric_qualifier, v AS toxval_numeric,
  u AS toxval_units, casrn, risk AS risk_assessment_class, species AS species_supercategory, is_study, value_kind,
  study_type, effect_type, CASE WHEN is_study = 1 THEN study_type || ' - ' || effect_type ELSE effect_type END AS summary
  FROM st4)"""
U, B = "unlikely (NOEL over 100 mg/kg-day)", "toxicant with effect level < 100"
_CONCLUSIVE = "(" + ", ".join(f"'{a} - {b}'" for b in (U, B) for a in ("reproductive", "developmental", "repro/dev")) + ")"
FLAGS = STUDIES + f""", flags AS (
  SELECT casrn, bool_or(is_study = 1) AS tested,
    bool_or(summary IN ('reproductive - {U}', 'repro/dev - {U}')) AS repro_unlikely,
    bool_or(summary IN ('developmental - {U}', 'repro/dev - {U}')) AS dev_unlikely,
    bool_or(summary IN ('reproductive - {B}', 'repro/dev - {B}')) AS repro_below,
    bool_or(summary IN ('developmental - {B}', 'repro/dev - {B}')) AS dev_below,
    bool_or(is_study = 1 AND summary NOT IN {_CONCLUSIVE} AND {has('summary', 'repro')}) AS repro_imprecise,
    bool_or(is_study = 1 AND summary NOT IN {_CONCLUSIVE} AND {has('summary', 'dev')}) AS dev_imprecise
  FROM studies GROUP BY 1)"""
CALL_SQL = f"""calls AS (SELECT CAST(o_custkey AS VARCHAR) AS casrn,
  {case_sql('o_orderpriority || o_orderstatus', CALLS)} AS call FROM orders),
classes AS (SELECT casrn, CASE
  WHEN bool_or(call IN ('Likely Human Carcinogen', 'C (Possible human carcinogen)')) THEN 'Likely'
  WHEN bool_or(call = 'Not Likely to Be Carcinogenic in Humans') THEN 'Unlikely'
  WHEN bool_or(call IN ('Not Yet  Determined', 'Inadequate for an assessment of carcinogenic potential',
    'Group VA: CEPA (inadequate data for evaluation)')) THEN 'Inadequate evidence' ELSE 'FIX' END AS call_class
  FROM calls GROUP BY 1)"""
LIST_SQL = f"""raw AS (SELECT CASE WHEN p_size = 50 THEN p_name || ' (Delisted)' ELSE p_name END AS chemical,
  CASE p_type WHEN 'STANDARD' THEN p_partkey || ' / ' || p_size WHEN 'LARGE' THEN p_partkey || '; ' || p_size
    WHEN 'SMALL' THEN p_partkey || '/' || p_size || '/x' WHEN 'MEDIUM' THEN ' ' || p_partkey || ' '
    WHEN 'PROMO' THEN '---' END AS cell, {case_sql('p_type', TOXICITIES)} AS toxicity FROM part),
halves AS (SELECT chemical, toxicity, regexp_split_to_array(cell, '[/;]') AS parts FROM raw
  WHERE NOT {has('chemical', 'Delisted')}),
cleaned AS (SELECT chemical, trim(v) AS cas_no, toxicity FROM (SELECT chemical, toxicity, unnest(parts) AS v FROM halves)
  WHERE v IS NOT NULL AND v <> '---'),
listing AS (SELECT cas_no, bool_or({has('toxicity', 'cancer')}) AS cancer,
  bool_or({has('toxicity', 'development')}) AS development FROM cleaned GROUP BY 1)"""
MATRIX = FLAGS + ", " + CALL_SQL + ", " + LIST_SQL + f""", base AS (
  SELECT c_name AS chnm, CAST(c_custkey AS VARCHAR) AS casn,
    CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 1 ELSE 0 END AS survey,
    c_custkey IN (SELECT s_suppkey FROM supplier) AS d, c_custkey IN (SELECT item_id FROM benchmark) AS c,
    coalesce(call_class, 'No assessment') AS cancer_calls, coalesce(tested, false) AS tested,
    coalesce(repro_unlikely, false) AS ru, coalesce(dev_unlikely, false) AS du, coalesce(repro_below, false) AS rb,
    coalesce(dev_below, false) AS db, coalesce(repro_imprecise, false) AS ri, coalesce(dev_imprecise, false) AS di,
    coalesce(cancer, false) AS lc, coalesce(development, false) AS ld
  FROM customer LEFT JOIN flags f ON f.casrn = CAST(c_custkey AS VARCHAR)
  LEFT JOIN classes k ON k.casrn = CAST(c_custkey AS VARCHAR) LEFT JOIN listing l ON l.cas_no = CAST(c_custkey AS VARCHAR)),
m1 AS (SELECT *, CASE WHEN d AND c THEN 'Mammary carcinogen and developmental toxicant'
    WHEN d THEN 'Mammary developmental toxicant' WHEN c THEN 'Mammary carcinogen' ELSE '' END AS mammary,
  CASE WHEN db AND rb THEN 'Reproductive and developmental' WHEN rb THEN 'Reproductive' WHEN db THEN 'Developmental'
    ELSE '' END AS effect_below,
  CASE WHEN lc AND ld THEN 'Cancer and developmental' WHEN lc THEN 'Cancer' WHEN ld THEN 'Developmental' ELSE '' END
    AS listed FROM base),
m2 AS (SELECT *, CASE WHEN du AND ru AND effect_below = '' THEN 'Reproductive and developmental'
    WHEN ru AND NOT {has('effect_below', 'Repro')} THEN 'Reproductive'
    WHEN du AND NOT {has('effect_below', 'mental')} THEN 'Developmental' ELSE '' END AS no_effect_above FROM m1),
matrix AS (SELECT chnm, casn, survey, mammary, cancer_calls, effect_below, no_effect_above, listed,
  CASE WHEN ri AND di AND effect_below = '' AND no_effect_above = ''
      THEN 'repro/dev - imprecise toxicity value or different units'
    WHEN ri AND NOT {has('effect_below', '(R|r)epro')} AND NOT {has('no_effect_above', '(R|r)epro')}
      THEN 'repro - imprecise toxicity value or different units'
    WHEN di AND NOT {has('effect_below', '(D|d)ev')} AND NOT {has('no_effect_above', '(D|d)ev')}
      THEN 'dev - imprecise toxicity value or different units'
    WHEN NOT tested THEN 'no repro nor dev tests in ToxValDb' ELSE '' END AS other FROM m2)"""
SUMMARY = MATRIX + f""", summary AS (SELECT *,
  CASE WHEN cancer_calls = 'Likely' OR {has('mammary', 'carcinogen')} OR {has('listed', 'Cancer')} THEN 'Likely'
    WHEN cancer_calls = 'Unlikely' THEN 'Unlikely'
    WHEN cancer_calls IN ('Inadequate evidence', 'No assessment') THEN 'Inadequate evidence' ELSE 'fix' END
    AS cancer_summary,
  CASE WHEN {has('effect_below', '(D|d)evelopment|Reproductive')} OR {has('mammary', '(D|d)evelopment')}
      OR {has('listed', '(D|d)evelopmental')} THEN 'Likely'
    WHEN no_effect_above = 'Reproductive and developmental' THEN 'Unlikely'
    WHEN other <> '' OR no_effect_above IN ('Reproductive', 'Developmental') THEN 'Inadequate evidence'
    ELSE 'FIX' END AS toxicity_summary FROM matrix)"""


@query("study_classes", f"WITH {STUDIES} SELECT * FROM studies")
def study_classes(spark, folder):
    return evidence.classify_studies(studies(spark, folder))


@query("evidence_flags", f"WITH {FLAGS} SELECT * FROM flags")
def evidence_flags(spark, folder):
    return evidence.evidence_flags(evidence.classify_studies(studies(spark, folder)))


@query("call_priority", f"WITH {CALL_SQL} SELECT * FROM classes")
def call_priority(spark, folder):
    return evidence.call_classes(calls(spark, folder))


@query("list_cleanup", f"WITH {LIST_SQL} SELECT * FROM cleaned")
def list_cleanup(spark, folder):
    return rename(evidence.clean_list(listed(spark, folder)), SHORT)


@query("list_flags", f"WITH {LIST_SQL} SELECT * FROM listing")
def list_flags(spark, folder):
    return rename(evidence.list_flags(evidence.clean_list(listed(spark, folder))), SHORT)


@query("evidence_matrix", f"WITH {MATRIX} SELECT * FROM matrix")
def evidence_matrix(spark, folder):
    return rename(merged(spark, folder), SHORT)


@query("evidence_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def evidence_summary(spark, folder):
    return rename(evidence.evidence_summary(merged(spark, folder)), SHORT)


@query("calls_by_source", """
WITH c AS (SELECT DISTINCT o_custkey AS casrn, 'Customer#' || o_custkey AS name, o_orderstatus AS source,
  CASE WHEN o_totalprice < 250000 THEN o_orderpriority || ' (oral)' ELSE o_orderpriority END AS call FROM orders)
SELECT casrn, name, string_agg(call, ', ' ORDER BY call) FILTER (source = 'F') AS "F",
  string_agg(call, ', ' ORDER BY call) FILTER (source = 'O') AS "O",
  string_agg(call, ', ' ORDER BY call) FILTER (source = 'P') AS "P" FROM c GROUP BY 1, 2""")
def calls_by_source(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("casrn"), F.concat(F.lit("Customer#"), F.col("o_custkey")).alias("name"),
        F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("cancer_call"),
        F.when(F.col("o_totalprice") < 250000, "oral").otherwise("-").alias("exposure_route"),
    )
    return evidence.calls_by_source(rows, ["F", "O", "P"])
