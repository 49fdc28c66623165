"""Ranking, integration, prioritisation, published tables and chart tables.

The responders of the assay queries are the potency table (A = estradiol, N = progesterone); every other input of the
integration is derived from the part table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.functions import text as txt
from dosescreen.operators import assay, charts, exposure, ranking, screening
from dosescreen.operators.joins import join_on
from dosescreen.operators.reshape import pick, quoted, rename
from dosescreen.session import cut_lineage
from workload.assay_queries import RESPOND, effects, respond, settled_hits
from workload.exposure_queries import TOKENS, USES, case_sql, has
from workload.registry import query, table


GLAND = [label for _, label in fixed.MAMMARY_LABELS]


def snake(name: str) -> str:
    name = name.replace(">=", "at least").replace("<", "below")
    return re.sub("_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower())).strip("_")


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


NAMES = {"7": "Bisphenol A", "8": "C.I. Dichlorophenol", "13": "PK-13"}
CONSUMER = {"STANDARD": "1", "LARGE": "1*", "SMALL": "0", "PROMO": "1", "ECONOMY": "0"}
STATUS = {
    "STANDARD": "considered - tumor", "LARGE": "not considered - both", "SMALL": "not considered - tumor",
    "MEDIUM": "considered - other", "PROMO": "not listed",
}
MAMMARY = {
    "STANDARD": "Mammary carcinogen and developmental toxicant", "SMALL": "Mammary developmental toxicant",
    "MEDIUM": "Mammary carcinogen",
}


def part(spark, folder) -> DataFrame:
    name = F.concat(
        F.coalesce(F.try_element_at(
            F.create_map(*[F.lit(x) for p in NAMES.items() for x in p]), F.col("p_size").cast("string")
        ), F.col("p_name"))
    )
    return table(spark, folder, "part").withColumns({"chnm": name, "casn": F.col("p_partkey").cast("string")})


def potency(spark, folder) -> DataFrame:
    first = ranking.lowest_with_ties(respond(settled_hits(spark, folder)), ["chem"], "plate")
    size, price = F.col("p_size"), F.col("p_retailprice")
    known = part(spark, folder).select(
        "p_partkey", "chnm", "casn", F.col("p_name").alias("date_chnm_plate"),
        F.concat(F.lit("c("), size.cast("string"), F.lit(")")).alias("hits_Estradiol"),
        F.concat(F.lit("c("), F.col("p_brand"), F.lit(")")).alias("hits_Progesterone"),
        num.round_decimals(F.when(size > 45, fixed.NOT_ACTIVE).otherwise(price / 8)).alias("AC50_Estradiol"),
        num.round_decimals(F.when(size > 5, price / size)).alias("AC50_Progesterone"),
        num.round_decimals((size - 12) / F.lit(64.0)).alias("adj_maxmMD"),
        (size * 2.0).alias("max_tested_conc"), (size / F.lit(2.0)).alias("min_tested_conc"),
        F.concat(num.number_text(size / F.lit(16.0)), F.lit(" (u)")).alias("seem"),
    )
    joined = join_on(first, known, {"chem": "p_partkey"}, "inner").drop("chem")
    return rename(joined, {
        "LEC_A": "LEC_Estradiol", "LEC_N": "LEC_Progesterone", "MFC_A": "MFC_Estradiol", "MFC_N": "MFC_Progesterone",
        "A": "Estradiol", "N": "Progesterone",
    })


def integrated(spark, folder) -> DataFrame:
    parts, size = part(spark, folder), F.col("p_size")
    peaks = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("CASRN")).agg(
        F.max("l_discount").alias("AUC.Agonist"), F.max("l_tax").alias("AUC.Antagonist")
    )
    # parts of some sizes are there under another id, so that both sides have rows without a partner
    sources = parts.select(
        F.when(size > 2, F.col("casn")).otherwise(F.concat(F.lit("other "), "casn")).alias("casrn"), F.when(F.col("p_type").isin(list(CONSUMER)), txt.recode("p_type", CONSUMER))
        .alias("Cons."),
        F.when(size > 25, "1").otherwise("0").alias("Diet"), F.when(size < 10, "1*").otherwise("0").alias("Ind."),
        F.when(size.between(20, 30), "1").otherwise("0").alias("Pharma."),
        F.when(size > 44, "1").otherwise("0").alias("Pest."),
        F.when(F.col("p_type") == "MEDIUM", "1").otherwise(" ").alias("No Toxcast Info."),
        F.lower("p_brand").alias("Sources of Interest"),
    )
    pesticides = parts.select(
        F.when(size < 25, F.col("casn")).otherwise(F.concat(F.lit("other "), "casn")).alias("CASRN"),
        F.when(F.col("p_type").isin(list(STATUS)), txt.recode("p_type", STATUS)).alias("status"),
    )
    evidence = parts.select(
        "chnm", "casn", F.when(size > 40, 1).otherwise(0).alias("Nhanes"),
        F.when(F.col("p_type").isin(list(MAMMARY)), txt.recode("p_type", MAMMARY)).otherwise("").alias(fixed.MAMMARY_COLUMN),
        F.when(size > 30, "Likely").otherwise("No assessment").alias("Carcinogencity (ToxValDb)"),
        F.col("p_brand").alias("Invivo effect < 100 mg/kg-day (ToxValDb)"),
        F.col("p_type").alias("No invivo effect >= 100 mg/kg-day (ToxValDb)"),
        F.lit("").alias("Other (ToxValDb)"), F.lower("p_type").alias("Prop65"),
        F.when(size > 30, "Likely").otherwise("Unlikely").alias(fixed.CANCER_SUMMARY),
        F.when(size > 20, "Likely").otherwise("Unlikely").alias(fixed.TOXICITY_SUMMARY),
    )
    return screening.integrated_long(
        potency(spark, folder), assay.label_areas(peaks, "CASRN", "AUC.Agonist", "AUC.Antagonist"), sources,
        pesticides, evidence,
    )


def kept(table_: DataFrame) -> DataFrame:
    rows = screening.potency_filter(table_, exclude=["11", "1111"])
    return pick(rows.withColumn("Chemical name", screening.display_name(quoted("Chemical name"))),
                ["hormone", "Chemical name", "CASN", "MFC", "LEC", "logLEC"])


def ranked(spark, folder) -> DataFrame:
    return screening.potency_rank(cut_lineage(kept(integrated(spark, folder))))


def assay_calls(spark, folder) -> DataFrame:
    size = F.col("p_size")
    parts = part(spark, folder)
    values = parts.select("casn", ((size - 20) / F.lit(8.0)).alias("e"), F.when(size > 5, size / F.lit(16.0)).alias("p"))
    calls = parts.select("casn", F.when(size < 10, F.lit(None)).when(size < 30, 0).otherwise(1).alias("e"),
                         F.when(size > 25, 0).otherwise(1).alias("p"))
    return assay.matrix_with_calls(
        values.withColumnRenamed("casn", "code"), calls.withColumnRenamed("casn", "code"),
        parts.select("casn", F.col("casn").alias("code")), {"e": fixed.ESTRADIOL, "p": fixed.PROGESTERONE},
    )


def updated(spark, folder) -> DataFrame:
    table_ = cut_lineage(integrated(spark, folder))
    places = screening.potency_rank(cut_lineage(kept(table_)))
    return screening.annotate(table_, assay_calls(spark, folder), rename(places, {"Chemical name": "Synonym"}))


def drug_products(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.concat(F.upper("p_name"), F.when(F.col("p_size") < 2, "; ").otherwise(" "), "p_brand").alias("Ingredient"),
        F.when(F.col("p_type") == "PROMO", fixed.DISCONTINUED).otherwise("RX").alias("Type"),
    )


def pesticide_status(spark, folder) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("CASN"),
        F.when(size > 40, size).alias("Active products"), F.when(size < 10, size).alias("Not active products"),
    )


def prioritised(spark, folder) -> DataFrame:
    base = updated(spark, folder)
    status = screening.active_products(part(spark, folder).select(
        F.col("chnm").alias("Chemical name"), F.col("casn").alias("CASN")
    ), pesticide_status(spark, folder))
    return screening.prioritise(base, screening.ingredient_counts(drug_products(spark, folder)), status)


def shown(v: str) -> str:
    return f"regexp_replace(CAST({v} AS VARCHAR), '\\.0$', '')"


def rounded(v: str) -> str:
    return f"CAST(printf('%.2f', {v}) AS DOUBLE)"


def area(v: str) -> str:
    return (f"{shown(v)} || CASE WHEN {v} >= 0.1 THEN ' (active)' WHEN {v} >= 0.01 THEN ' (ambiguous)' ELSE '' END")


def wide_one(h: str, ch: str) -> str:
    ac50 = "a1" if ch == "A" else "a2"
    hits = "'c(' || p_size || ')'" if ch == "A" else "'c(' || p_brand || ')'"
    return f"""SELECT '{h}' AS hormone, "LEC_{ch}" AS lec, "MFC_{ch}" AS mfc, {hits} AS hits,
      {ac50} AS ac, w.* FROM wide_p w"""


INTEGRATED = RESPOND + f""", sel AS (SELECT * FROM respond QUALIFY row_number() OVER (PARTITION BY chem ORDER BY plate) = 1),
pp AS (SELECT *, coalesce({case_sql('CAST(p_size AS VARCHAR)', NAMES)}, p_name) AS chnm,
  CAST(p_partkey AS VARCHAR) AS casn FROM part),
wide_p AS (SELECT s.*, p.*, {rounded("CASE WHEN p_size > 45 THEN 1000000.0::DOUBLE ELSE p_retailprice / 8 END")} AS a1,
  {rounded("CASE WHEN p_size > 5 THEN p_retailprice / p_size END")} AS a2 FROM sel s JOIN pp p ON chem = p_partkey),
long AS ({wide_one('Estradiol', 'A')} UNION ALL {wide_one('Progesterone', 'N')}),
peaks AS (SELECT l_partkey, max(l_discount) AS ag, max(l_tax) AS an, greatest(max(l_discount), max(l_tax)) AS bio
  FROM lineitem GROUP BY 1),
integrated AS (SELECT chnm AS chemical_name, casn, "A" AS estradiol, "N" AS progesterone,
  {rounded('(p_size - 12) / 64.0::DOUBLE')} AS adj_maxmmd, p_size * 2.0::DOUBLE AS max_tested_conc,
  p_size / 2.0::DOUBLE AS min_tested_conc,
  {shown('(p_size / 16.0::DOUBLE)')} || ' (u)' AS predicted_median_intake_rate_mg_kg_bw_day,
  hormone, lec, mfc, hits,
  CASE WHEN ac = 1000000 THEN '-' WHEN ac IS NULL THEN ' ' ELSE {shown('ac')} END AS ac50,
  {area('ag')} AS auc_agonist, {area('an')} AS auc_antagonist, {area('bio')} AS auc_bioactivity,
  CASE WHEN p_size > 2 THEN {case_sql('p_type', CONSUMER)} END AS consumer,
  CASE WHEN p_size > 25 THEN '1' WHEN p_size > 2 THEN '0' END AS diet,
  CASE WHEN p_size > 2 THEN CASE WHEN p_size < 10 THEN '1*' ELSE '0' END END AS industrial,
  CASE WHEN p_size > 2 THEN CASE WHEN p_size BETWEEN 20 AND 30 THEN '1' ELSE '0' END END AS pharma,
  CASE WHEN p_size > 2 THEN CASE WHEN p_size > 44 THEN '1' ELSE '0' END END AS pest,
  CASE WHEN p_size > 2 THEN CASE WHEN p_type = 'MEDIUM' THEN '1' ELSE ' ' END END AS no_exposure_source_data,
  CASE WHEN p_size > 2 THEN lower(p_brand) END AS additional_exposure_sources,
  CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS nhanes,
  CASE WHEN p_size > 30 THEN 'Likely' ELSE 'No assessment' END AS carcinogencity_toxvaldb,
  p_brand AS invivo_effect_below_100_mg_kg_day_toxvaldb, p_type AS no_invivo_effect_at_least_100_mg_kg_day_toxvaldb,
  '' AS other_toxvaldb, lower(p_type) AS prop65,
  CASE WHEN p_size > 30 THEN 'Likely' ELSE 'Unlikely' END AS carcinogenicity_assessment_summary,
  CASE WHEN p_size > 20 THEN 'Likely' ELSE 'Unlikely' END AS developmental_or_reproducive_toxicity_summary,
  CASE p_type WHEN 'STANDARD' THEN '{GLAND[0]} {GLAND[1]}'
    WHEN 'SMALL' THEN '{GLAND[2]}' WHEN 'MEDIUM' THEN '{GLAND[0]}'
    WHEN 'LARGE' THEN CASE WHEN p_size < 25 THEN 'Tumor and other effect (potential){fixed.PESTICIDE_EFFECT_NOTE}' END
    END AS effects_on_mammary_gland
  FROM long JOIN peaks ON l_partkey = p_partkey WHERE lec IS NOT NULL)"""
RANKED = INTEGRATED + """, kept AS (SELECT hormone, replace(CASE chemical_name WHEN 'Bisphenol A' THEN 'BPA'
    WHEN 'C.I. Dichlorophenol' THEN 'DCP' ELSE chemical_name END, '', '') AS chemical_name, casn, mfc, lec, log10(lec) AS loglec
  FROM integrated WHERE mfc >= 1.5 AND lec <= 33 AND adj_maxmmd > 0 AND casn NOT IN ('11', '1111')),
r1 AS (SELECT *, count(*) OVER w AS n, percent_rank() OVER (PARTITION BY hormone ORDER BY mfc) AS rank_mfc,
  percent_rank() OVER (PARTITION BY hormone ORDER BY lec DESC) AS rank_lec FROM kept WINDOW w AS (PARTITION BY hormone)),
r2 AS (SELECT * EXCLUDE (n), n, (rank_mfc + rank_lec) / 2 AS cumulative_rank FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY hormone ORDER BY cumulative_rank DESC, mfc DESC, casn) AS rank FROM r2),
ranked AS (SELECT * EXCLUDE (n), rank / n AS rank_percent, CASE WHEN rank / n < .25 THEN 'higher'
  WHEN rank / n < .75 THEN 'intermediate' ELSE 'lower' END AS cluster FROM r3)"""
UPDATED = RANKED + f""", ac10 AS (
  SELECT CAST(p_partkey AS VARCHAR) AS c, 'Estradiol' AS h, (p_size - 20) / 8.0::DOUBLE AS v,
    CASE WHEN p_size < 10 THEN NULL WHEN p_size < 30 THEN 0 ELSE 1 END AS hitcall FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Progesterone', CASE WHEN p_size > 5 THEN p_size / 16.0::DOUBLE END,
    CASE WHEN p_size > 25 THEN 0 ELSE 1 END FROM part),
ac10t AS (SELECT *, {shown('round(pow(10, v), 3)')} AS t FROM ac10),
updated AS (SELECT i.* EXCLUDE (auc_agonist, auc_antagonist, auc_bioactivity), auc_agonist AS er_agonist_auc,
  auc_antagonist AS er_antagonist_auc, auc_bioactivity AS er_bioactivity,
  CASE WHEN i.chemical_name <> r.chemical_name THEN r.chemical_name ELSE '' END AS synonym, r.cluster AS efficacy_potency,
  r.rank, r.rank_percent, CASE WHEN hitcall = 0 THEN t || ' (not active)' WHEN hitcall = 1 THEN t END AS ac10,
  CASE WHEN {has('i.chemical_name', 'UK-|CP-|Pharma|GSK|MK-|CI-|SSR|PD-|FR|CJ-|SAR|PD |AVE|PK|HMR')} THEN 1 ELSE 0 END
    AS failed_drug_candidate
  FROM integrated i LEFT JOIN ac10t a ON a.c = i.casn AND a.h = i.hormone
  LEFT JOIN ranked r ON r.casn = i.casn AND r.hormone = i.hormone)"""
PRIORITISED = UPDATED + """, ingredients AS (
  SELECT DISTINCT unnest(string_split(
    lower(upper(p_name) || CASE WHEN p_size < 2 THEN '; ' ELSE ' ' END || p_brand), '; ')) AS g FROM part
  WHERE p_type <> 'PROMO'),
p1 AS (SELECT *, CASE WHEN lower(chemical_name) IN (SELECT g FROM ingredients) THEN 'yes' ELSE 'no' END
    AS fda_approved_drug_products,
  CASE WHEN casn IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 40) THEN 'yes' ELSE 'no' END
    AS epa_approved_pesticide_products FROM updated),
prioritised AS (SELECT *, CASE WHEN efficacy_potency <> '' AND (consumer = '1' OR nhanes = 1
    OR epa_approved_pesticide_products = 'yes' OR fda_approved_drug_products = 'yes') THEN 'yes' ELSE 'no' END
    AS prioritize_based_on_efficacy_potency_and_exposure_potential FROM p1)"""


@query("potency_percent_rank", """
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_extendedprice, l_quantity,
  percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rank_mfc,
  percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank_lec FROM lineitem""")
def potency_percent_rank(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity"
    )
    return ranking.percent_rank(
        rows, ["l_returnflag"], {"rank_mfc": ("l_extendedprice", False), "rank_lec": ("l_quantity", True)}
    )


@query("potency_cluster", """
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_extendedprice, l_quantity,
    percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rank_l_extendedprice,
    percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank_l_quantity,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
s AS (SELECT *, (rank_l_extendedprice + rank_l_quantity) / 2 AS cumulative_rank FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY cumulative_rank DESC, l_extendedprice DESC,
    l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rank FROM s)
SELECT * EXCLUDE (n), rank / n AS rank_percent, CASE WHEN rank / n < .25 THEN 'higher'
  WHEN rank / n < .75 THEN 'intermediate' ELSE 'lower' END AS cluster FROM t""")
def potency_cluster(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity"
    )
    return screening.potency_rank(
        rows, "l_returnflag", fold="l_extendedprice", conc="l_quantity",
        tie_order=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    )


@query("potency_filter", f"""WITH {RESPOND} SELECT r.chem, r.plate, e.channel, e."MFC", e."LEC", p_name,
  round(log10(e."LEC"), 9) AS "logLEC" FROM respond r JOIN effects e USING (chem, plate) JOIN part ON chem = p_partkey
  WHERE e."MFC" >= 1.5 AND e."LEC" <= 33 AND p_size - 12 > 0 AND p_name NOT IN ('hot ring', 'cold bolt')""")
def potency_filter(spark, folder):
    marked = settled_hits(spark, folder)
    both = join_on(respond(marked).select("chem", "plate"), effects(marked), ["chem", "plate"], "inner")
    named = join_on(both, table(spark, folder, "part").select(
        "p_partkey", "p_name", (F.col("p_size") - 12).alias("distance")
    ), {"chem": "p_partkey"}, "inner")
    kept = screening.potency_filter(named, exclude=["hot ring", "cold bolt"], chem="p_name", distance="distance")
    return kept.drop("distance").withColumn("logLEC", F.round("logLEC", 9))


@query("synonym_recode", """
SELECT p_partkey, replace(replace(CASE p_name WHEN 'small ring' THEN 'S-Ring' WHEN 'old anvil' THEN 'Relic'
  ELSE p_name END, 'widget', 'wdg'), 'gizmo', 'gzm') AS name, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def synonym_recode(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, folder, "part").select("p_partkey", screening.display_name(
        F.col("p_name"), {"small ring": "S-Ring", "old anvil": "Relic"}, [("widget", "wdg"), ("gizmo", "gzm")]
    ).alias("name"))
    return join_on(parts, counts, {"p_partkey": "l_partkey"}, "inner")


@query("integrated_long", f"WITH {INTEGRATED} SELECT * FROM integrated")
def integrated_long(spark, folder):
    return plain(integrated(spark, folder))


@query("potency_rank", f"WITH {RANKED} SELECT * EXCLUDE (loglec), round(loglec, 9) AS loglec FROM ranked")
def potency_rank(spark, folder):
    return plain(ranked(spark, folder)).withColumn("loglec", F.round("loglec", 9))


@query("annotated_table", f"WITH {UPDATED} SELECT * FROM updated")
def annotated_table(spark, folder):
    return plain(updated(spark, folder))


@query("ingredient_counts", """
WITH t AS (SELECT unnest(string_split(lower(text), ', ')) AS ingredients FROM documents WHERE lang <> 'de')
SELECT ingredients, count(*) AS n FROM t WHERE ingredients <> '' GROUP BY 1""")
def ingredient_counts(spark, folder):
    texts = table(spark, folder, "documents").select(
        F.col("text").alias("Ingredient"), F.when(F.col("lang") == "de", fixed.DISCONTINUED).otherwise("RX").alias("Type")
    )
    return screening.ingredient_counts(texts, separator=", ")


@query("ingredient_match", """
WITH t AS (SELECT unnest(string_split(lower(p_name || '; ' || p_brand), '; ')) AS g FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO'), c AS (SELECT g, count(*) AS n FROM t GROUP BY 1)
SELECT DISTINCT p_name AS chemical_name, p_partkey AS casn, lower(p_name) AS chemical_name2, n
FROM part LEFT JOIN c ON g = lower(p_name)""")
def ingredient_match(spark, folder):
    parts = table(spark, folder, "part")
    sold = join_on(table(spark, folder, "lineitem").select("l_partkey"), parts.select(
        "p_partkey", F.concat_ws("; ", "p_name", "p_brand").alias("Ingredient"),
        F.when(F.col("p_type") == "PROMO", fixed.DISCONTINUED).otherwise("RX").alias("Type"),
    ), {"l_partkey": "p_partkey"}, "inner")
    chemicals = parts.select(F.col("p_name").alias("Chemical name"), F.col("p_partkey").alias("CASN"))
    return plain(screening.ingredient_match(chemicals, screening.ingredient_counts(sold)))


@query("active_products", """
WITH s AS (SELECT l_partkey, nullif(count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 45), 0) AS a,
  nullif(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40), 0) AS b FROM lineitem GROUP BY 1)
SELECT DISTINCT p_name AS chemical_name, p_partkey AS casn, a AS active_products, b AS not_active_products,
  CASE WHEN a IS NOT NULL THEN 'yes' WHEN b IS NOT NULL THEN 'no' ELSE '' END AS products
FROM part LEFT JOIN s ON p_partkey = l_partkey""")
def active_products(spark, folder):
    large = F.col("l_quantity")
    status = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("CASN")).agg(
        F.nullif(F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (large > 45)), F.lit(0))
        .alias("Active products"),
        F.nullif(F.count_if((F.col("l_linestatus") == "F") & (large > 40)), F.lit(0)).alias("Not active products"),
    )
    chemicals = table(spark, folder, "part").select(
        F.col("p_name").alias("Chemical name"), F.col("p_partkey").alias("CASN")
    )
    return plain(screening.active_products(chemicals, status))


@query("prioritise", f"WITH {PRIORITISED} SELECT * FROM prioritised")
def prioritise(spark, folder):
    return plain(prioritised(spark, folder))


# part numbers that stand for the identifiers of hormones
SUBSTRATES = [str(k) for k in range(3, 400, 7)]


def published_sql(hormone: str, other: str) -> str:
    renamed = {
        "rank": "Efficacy/potency rank", "rank_percent": "Efficacy/potency percentile",
        "hits": "Hitcall per chemical concentration", "effects_on_mammary_gland": "Effect on mammary gland",
        "invivo_effect_below_100_mg_kg_day_toxvaldb": "Dev/repro in vivo effect level < 100 mg/kg-day (ToxValDb)",
        "no_invivo_effect_at_least_100_mg_kg_day_toxvaldb":
            "Dev/repro in vivo no effect level >= 100 mg/kg-day (ToxValDb)",
        "other_toxvaldb": "Other (ToxValDb re dev/repro in vivo effect)",
        "carcinogencity_toxvaldb": "Carcinogenicity (ToxValDb)",
        "developmental_or_reproducive_toxicity_summary": "Developmental or reproductive toxicity (Summary)",
        "prioritize_based_on_efficacy_potency_and_exposure_potential":
            "Chemical of concern (based on hazard and exposure potential)",
        other.lower(): f"Direction of {'P4' if other == 'Progesterone' else 'E2'} synthesis",
    }
    back = {snake(v): k for k, v in renamed.items()}
    out = []
    for name in [*fixed.PUBLISHED_COLUMNS, f"Direction of {'P4' if other == 'Progesterone' else 'E2'} synthesis"]:
        column = snake(name)
        if name in ("hormone", hormone, other):
            continue
        if column == "efficacy_potency":
            listed = ", ".join(f"'{k}'" for k in SUBSTRATES)
            out.append(f"CASE WHEN casn IN ({listed}) THEN 'hormone substrate' "
                       "ELSE coalesce(efficacy_potency, 'borderline active') END AS efficacy_potency")
        else:
            out.append(f"{back[column]} AS {column}" if column in back else column)
    return f"WITH {PRIORITISED} SELECT {', '.join(out)} FROM prioritised WHERE hormone = '{hormone}'"


@query("final_table_estradiol", published_sql("Estradiol", "Progesterone"))
def final_table_estradiol(spark, folder):
    return plain(screening.final_tables(prioritised(spark, folder), SUBSTRATES)[fixed.ESTRADIOL])


@query("final_table_progesterone", published_sql("Progesterone", "Estradiol"))
def final_table_progesterone(spark, folder):
    return plain(screening.final_tables(prioritised(spark, folder), SUBSTRATES)[fixed.PROGESTERONE])


@query("cluster_sizes", f"""WITH {RANKED} SELECT hormone, cluster, count(*) AS n FROM ranked
WHERE NOT {has('chemical_name', 'UK-|CP-|Pharma|GSK|MK-|CI-|SSR|PD-|FR|CJ-|SAR|PD |AVE|PK|HMR')} GROUP BY 1, 2""")
def cluster_sizes(spark, folder):
    return charts.cluster_sizes(charts.plotted(ranked(spark, folder)))


@query("label_window", f"""WITH {RANKED} SELECT hormone, casn, chemical_name, cluster,
  CASE cluster WHEN 'higher' THEN 1 WHEN 'intermediate' THEN 2 ELSE 3 END AS cluster_order,
  CASE hormone WHEN 'Estradiol' THEN mfc <= 3.84 AND loglec > -0.7 ELSE mfc <= 11.72 AND loglec > -0.65 END AS parameters
FROM ranked WHERE NOT {has('chemical_name', 'UK-|CP-|Pharma|GSK|MK-|CI-|SSR|PD-|FR|CJ-|SAR|PD |AVE|PK|HMR')}""")
def label_window(spark, folder):
    rows = charts.label_window(charts.plotted(ranked(spark, folder)))
    return plain(pick(rows, ["hormone", "CASN", "Chemical name", "cluster", "cluster_order", "parameters"]))


@query("exposure_bins", f"""WITH {UPDATED}, sets AS (
  SELECT chemical_name, casn, predicted_median_intake_rate_mg_kg_bw_day, max(efficacy_potency) FILTER (hormone = 'Estradiol')
    AS estradiol, max(efficacy_potency) FILTER (hormone = 'Progesterone') AS progesterone
  FROM updated WHERE efficacy_potency IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN estradiol IS NOT NULL AND progesterone IS NOT NULL THEN 'Both'
    WHEN progesterone IS NOT NULL THEN 'Progesterone' ELSE 'Estradiol' END AS hormone,
  CAST(split_part(predicted_median_intake_rate_mg_kg_bw_day, ' ', 1) AS DOUBLE) AS intake,
  CASE WHEN estradiol = 'higher' OR progesterone = 'higher' THEN 'Higher'
    WHEN estradiol = 'intermediate' OR progesterone = 'intermediate' THEN 'Intermediate' ELSE 'Lower' END AS best_cluster
  FROM sets)
SELECT *, CASE best_cluster WHEN 'Lower' THEN 1 WHEN 'Intermediate' THEN 2 ELSE 3 END AS cluster_order,
  CASE WHEN intake > 2.5 THEN 'high' WHEN intake > 0.3 THEN 'intermediate' ELSE 'low' END AS facet,
  CASE WHEN intake > 2.5 THEN 3 WHEN intake > 0.3 THEN 2 ELSE 1 END AS facet_order FROM b WHERE intake >= 0.01""")
def exposure_bins(spark, folder):
    sets = charts.hormone_sets(updated(spark, folder), ["Chemical name", "CASN", fixed.INTAKE])
    return plain(charts.exposure_bins(sets))


CATEGORY_SQL = {
    "Consumer": "consumer", "Diet": "diet", "Industrial": "industrial", "Pest.": "pest", "Pharma.": "pharma",
    "No exposure source data": "no_exposure_source_data",
}


@query("source_hormone_counts", f"WITH {UPDATED}, reported AS (" + " UNION ALL ".join(
    f"SELECT chemical_name, casn, hormone, '{c}' AS category, {v} AS value FROM updated WHERE efficacy_potency IS NOT NULL"
    for c, v in CATEGORY_SQL.items()) + """), sets AS (
  SELECT chemical_name, casn, category, string_agg(hormone, ', ' ORDER BY hormone) AS hormones FROM reported
  WHERE value IN ('1', '1*') GROUP BY 1, 2, 3)
SELECT category, hormones, count(*) AS n, """ + case_sql("category", {
    k: v.replace("\n", "' || chr(10) || '") for k, v in fixed.SOURCE_LABELS.items()}) + """ AS categories,
  CASE category WHEN 'Consumer' THEN 1 WHEN 'Diet' THEN 2 WHEN 'Industrial' THEN 3 WHEN 'Pest.' THEN 4
    WHEN 'Pharma.' THEN 5 ELSE 6 END AS category_order,
  replace(hormones, 'Estradiol, Progesterone', 'Both') AS hormone_set FROM sets GROUP BY 1, 2""")
def source_hormone_counts(spark, folder):
    clustered = updated(spark, folder).where(quoted("Efficacy/potency").isNotNull())
    keys = ["Chemical name", "CASN"]
    return plain(charts.source_hormone_counts(charts.source_long(clustered, keys), keys))


@query("use_hormone_counts", f"""WITH {UPDATED}, input AS (SELECT CAST(p_partkey AS VARCHAR) AS key,
  {case_sql("split_part(p_name, ' ', 2)", USES)} || ', ' || p_type AS txt, ',' AS sep FROM part), {TOKENS},
sets AS (SELECT chemical_name, key, value, string_agg(hormone, ', ' ORDER BY hormone) AS hormones
  FROM (SELECT DISTINCT chemical_name, casn, hormone FROM updated WHERE efficacy_potency IS NOT NULL AND (
    """ + " OR ".join(f"{v} IN ('1', '1*')" for v in CATEGORY_SQL.values()) + """)) JOIN tokens ON key = casn GROUP BY 1, 2, 3)
SELECT hormones, value, count(*) AS n, replace(hormones, 'Estradiol, Progesterone', 'Both') AS hormone_set
FROM sets GROUP BY 1, 2""")
def use_hormone_counts(spark, folder):
    keys = ["Chemical name", "CASN"]
    clustered = updated(spark, folder).where(quoted("Efficacy/potency").isNotNull())
    texts = part(spark, folder).select(F.col("casn").alias("casrn"), F.concat_ws(
        ", ", txt.recode(txt.term("p_name", 1, " "), USES), F.col("p_type")
    ).alias("Other"))
    return plain(charts.use_hormone_counts(
        exposure.use_tokens(texts), charts.source_long(clustered, keys), "casrn", keys, "CASN"
    ))
