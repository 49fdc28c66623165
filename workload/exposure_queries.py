"""Exposure operators: line items as catalogue records and ingredient lists, orders as the record-to-chemical table.

The words of part names and types stand for the terms of a catalogue path and for product uses; return flag and line
status together stand for the catalogue a record comes from. Customers are the chemicals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.functions import text as txt
from dosescreen.operators import exposure
from dosescreen.operators.joins import join_on
from dosescreen.operators.reshape import rename
from dosescreen.session import cut_lineage
from workload.registry import query, table

CATALOGUES = {
    "AF": "Retail Product Categories", "AO": "Industrial Sectors", "NF": "ACToR UseDB", "NO": "Drug Registry",
    "RF": "Dow Functional Uses", "RO": "CPCat",
}
FIRST = {
    "small": "pesticide", "red": "personal_care", "large": "industrial_manufacturing", "blue": "food_contact",
    "new": "drug", "cold": "drinking_water", "hot": "disinfectant", "old": "discontinued",
}
SECOND = {
    "ring": "consumer_use", "bolt": "automotive_care", "plate": "food_additive", "rod": "raw_material",
    "gear": "apparel", "gizmo": "toy", "anvil": "fragrance", "widget": "plastic",
}
THIRD = {
    "STANDARD": "hair_dye", "LARGE": "textile", "SMALL": "extermination", "MEDIUM": "soap", "ECONOMY": "beverage",
    "PROMO": "flame_retardant",
}
USES = {
    "ring": "personal care: fragrance", "bolt": "air freshener", "plate": "hair color", "rod": "personal care",
    "gear": "disinfectant", "gizmo": "pesticide", "anvil": "herbicide and disinfectant", "widget": "toys",
}
PATHWAYS = {
    "FURNITURE": "All Four", "HOUSEHOLD": "Consumer", "MACHINERY": "Industrial, Pesticide", "BUILDING": "Unknown",
    "AUTOMOBILE": "Dietary",
}
RECORD = "cpdat_substance_record_id"


def paths(spark, folder) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.concat_ws(
        "|", txt.recode(txt.term("p_name", 0, " "), FIRST), txt.recode(txt.term("p_name", 1, " "), SECOND),
        txt.recode("p_type", THIRD),
    ).alias("cassette"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(RECORD), "l_partkey",
        txt.recode(F.concat("l_returnflag", "l_linestatus"), CATALOGUES).alias("source"),
    )
    return join_on(lines, part, {"l_partkey": "p_partkey"}, "inner").drop("l_partkey")


def ids(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias(RECORD), F.col("o_custkey").alias("casrn"))


def universe(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("casn"))


def records(spark, folder) -> DataFrame:
    return exposure.catalogue_records(paths(spark, folder), ids(spark, folder), universe(spark, folder))


def products(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("source"),
        F.when(F.col("p_size") > 3, txt.recode(txt.term("p_name", 1, " "), USES)).alias("product_use_category"),
    )


def ingredients(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias(RECORD), F.col("l_partkey").alias("product_id")
    )


def product_rows(spark, folder) -> DataFrame:
    return exposure.product_uses(
        ids(spark, folder), ingredients(spark, folder), products(spark, folder), universe(spark, folder)
    )


def predicted_table(spark, folder) -> DataFrame:
    catalogue, listed = paths(spark, folder), products(spark, folder)
    labels = exposure.number_labels(catalogue, listed)
    known, chemicals = ids(spark, folder), universe(spark, folder)
    # the numbered products are settled, so the planner knows the size of what the ingredients are joined with
    numbered = cut_lineage(exposure.labelled(listed, labels.products))
    summary = exposure.source_summary(
        exposure.catalogue_records(exposure.labelled(catalogue, labels.paths), known, chemicals),
        exposure.product_uses(known, ingredients(spark, folder), numbered, chemicals), labels=labels,
    )
    predictions = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("CAS"), txt.recode("c_mktsegment", PATHWAYS).alias("Pathway")
    )
    return exposure.with_predictions(summary, universe(spark, folder), predictions)


PLAIN = {
    "Cons.": "cons", "Diet": "diet", "Ind.": "ind", "Pharma.": "pharma", "Pest.": "pest",
    "Uncategorized Use": "uncategorised", "No Toxcast Info.": "no_info", "Other": "other", "Pathway": "pathway",
    "Sources of Interest": "uses",
}


def case_sql(value: str, words: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


def has(field: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({field}, '{pattern}'), false)"


RECORDS = f"""paths AS (
  SELECT l_orderkey AS rid, {case_sql("l_returnflag || l_linestatus", CATALOGUES)} AS source, l_partkey,
    {case_sql("split_part(p_name, ' ', 1)", FIRST)} || '|' || {case_sql("split_part(p_name, ' ', 2)", SECOND)} || '|'
    || {case_sql("p_type", THIRD)} AS cassette
  FROM lineitem JOIN part ON l_partkey = p_partkey),
records AS (
  SELECT p.*, o_custkey AS casrn FROM
    (SELECT source, cassette, rid, count(*) AS repeats FROM paths
     WHERE NOT {has('cassette', 'discontinued|prohibited|restricted')} GROUP BY 1, 2, 3) p
  JOIN orders ON rid = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer))"""
CATEGORIES = RECORDS + f""", c1 AS (SELECT *, CASE
    WHEN {has('source', 'Industrial|NACE')} THEN 'ind.'
    WHEN {has('source', 'Retail')} AND NOT {has('cassette', 'food|beverage')} THEN 'cons.'
    WHEN {has('source', 'Drug')} THEN 'pharma.'
    WHEN {has('source', 'DfE|Dow|Kem|Toxome|Functional')} THEN 'functional' ELSE cassette END AS fromsource FROM records),
c2 AS (SELECT *, split_part(fromsource, '|', 1) AS split FROM c1),
c3 AS (SELECT *, CASE WHEN {has('split', 'pesticide|herbicide|extermination|fungicide|antimicrobial')} THEN 'pest.'
    WHEN {has('split', 'drug')} THEN 'pharma.' WHEN {has('split', 'food|beverage|drinking_water')} THEN 'diet'
    ELSE split END AS t FROM c2),
c4 AS (SELECT * EXCLUDE (t), CASE
    WHEN t IN ('pest.', 'pharma', 'diet.') AND {has('cassette', 'consumer_use')} THEN t || ' ,cons.'
    WHEN {has('fromsource', 'consumer_use')} THEN 'cons.' ELSE t END AS cassette3 FROM c3),
c5 AS (SELECT *, CASE
    WHEN {has('cassette', 'apparel')} AND NOT {has('fromsource', 'ind.')} THEN 'cons.'
    WHEN {has('cassette3', 'personal_care|arts_crafts')} THEN 'cons.'
    WHEN {has('cassette', 'furniture')} AND NOT {has('fromsource', 'ind.')} THEN 'cons.'
    WHEN {has('cassette3', 'child_use|decor|toy|electronics|lawn_garden|sports_equipment|baby_use|pet|tools|dental|toothbrush|detected|cleaning_washing')} THEN 'cons.'
    WHEN {has('cassette3', 'industrial|raw_material|mining|manufacturing|resource_extraction|rubber_processing')} THEN 'ind.'
    WHEN {has('cassette3', 'soap')} THEN 'cons.' WHEN {has('cassette3', 'disinfectant')} THEN 'pest.'
    WHEN {has('cassette', 'automotive_care')} AND NOT {has('fromsource', 'ind.')} THEN 'cons.'
    ELSE cassette3 END AS f FROM c4),
categories AS (SELECT * EXCLUDE (f), CASE
    WHEN {has('cassette', 'food|beverage')} AND f NOT IN ('diet', 'ind.') AND cassette3 <> 'ind.' THEN f || ', diet'
    WHEN {has('cassette', 'extermination')} THEN f || ', pest.'
    WHEN {has('cassette', 'disinfectant')} AND f NOT IN ('disinfectant', 'pest.', 'feed') THEN f || ', pest.'
    ELSE f END AS cassette4 FROM c5)"""
PRODUCTS = f"""uses AS (
  SELECT o_custkey AS casrn, u AS product_use_category, source, count(*) AS repeats
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (SELECT p_partkey, p_brand AS source, CASE WHEN p_size > 3 THEN
        {case_sql("split_part(p_name, ' ', 2)", USES)} END AS u FROM part) ON l_partkey = p_partkey
  WHERE u IS NOT NULL AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2, 3),
product_categories AS (SELECT *, CASE WHEN {has('product_use_category', 'pesticide|herbicide')} THEN 'pest., cons.'
    ELSE 'cons.' END AS cassette4 FROM uses)"""


def title_sql(c: str) -> str:
    word = r"[\p{L}\p{M}\p{N}_]+"
    pieces = f"regexp_extract_all(lower({c}), '{word}|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
    return f"replace(array_to_string(list_transform({pieces}, lambda w: upper(w[1]) || w[2:]), ''), '_', ' ')"


BROAD = CATEGORIES + ", " + PRODUCTS + f""", labels4 AS (
  SELECT DISTINCT casrn, {title_sql('cassette4')} AS c FROM
    (SELECT casrn, cassette4 FROM categories UNION SELECT casrn, cassette4 FROM product_categories)),
broad AS (SELECT casrn, string_agg(c, ', ' ORDER BY c) AS broad FROM labels4 GROUP BY 1),
flags AS (SELECT *, CASE WHEN broad <> ' ' AND cons = '0' AND diet = '0' AND ind = '0' AND pharma = '0' AND pest = '0'
    THEN '1' ELSE '0' END AS uncategorised FROM (SELECT *,
  CASE WHEN {has('broad', 'Cons')} THEN '1' ELSE '0' END AS cons,
  CASE WHEN {has('broad', 'Diet|Drinking')} THEN '1' ELSE '0' END AS diet,
  CASE WHEN {has('broad', 'Ind.')} THEN '1' ELSE '0' END AS ind,
  CASE WHEN {has('broad', 'Pharma.')} THEN '1' ELSE '0' END AS pharma,
  CASE WHEN {has('broad', 'Pest.')} THEN '1' ELSE '0' END AS pest FROM broad))"""
SPECIFIC = BROAD + f""", s1 AS (SELECT casrn, cassette, CASE
    WHEN {has("split_part(cassette, '|', 1)", 'personal_care')} THEN 'pers.'
    WHEN {has('cassette', 'fragrance|air_freshener')} THEN 'fragrance'
    WHEN {has('cassette', 'antimicrobial|disinfectant')} THEN 'antimicrobial'
    WHEN {has("split_part(cassette, '|', 1)", 'cigarettes')} THEN 'cigarettes'
    WHEN {has('cassette', 'human_metabolite')} THEN 'human_metabolite'
    WHEN {has('cassette', 'plastic')} THEN 'plastic'
    WHEN {has('cassette', 'drinking_water')} THEN 'drinking_water_contaminant'
    WHEN {has('cassette', 'flame_retardant')} THEN 'flame_retardant'
    WHEN {has('cassette', 'food_contact')} THEN 'food_contact'
    WHEN {has('cassette', 'food_additive')} THEN 'food_additive'
    WHEN {has('cassette', 'food_residue')} THEN 'food_residue'
    WHEN {has("split_part(cassette, '|', 1)", 'textile')} THEN 'textile' ELSE ' ' END AS o FROM records),
s2 AS (SELECT casrn, CASE WHEN {has('cassette', 'hair_dye')} AND o <> 'hair_dye' THEN o || ', hair_dye'
    WHEN {has('cassette', 'fragrance')} AND o <> 'fragrance' THEN o || ', fragrance'
    WHEN {has('cassette', 'drinking_water')} AND o <> 'drinking_water_contaminant' THEN o || ', drinking_water_contaminant'
    WHEN {has('cassette', 'food_contact')} AND o <> 'food_contact' THEN o || ', food_contact' ELSE o END AS o FROM s1),
s3 AS (SELECT casrn, product_use_category AS u, CASE
    WHEN {has('product_use_category', 'fragrance|air freshener')} THEN 'fragrance'
    WHEN {has('product_use_category', 'hair color')} THEN 'hair_dye'
    WHEN {has('product_use_category', 'disinfectant')} THEN 'antimicrobial' ELSE ' ' END AS o FROM uses),
s4 AS (SELECT casrn, CASE WHEN {has('u', 'personal care')} AND o <> ' ' THEN 'pers., ' || o
    WHEN {has('u', 'personal care')} THEN 'pers.' ELSE o END AS o FROM s3),
s5 AS (SELECT DISTINCT casrn, {title_sql('o')} AS o FROM (SELECT * FROM s2 UNION SELECT * FROM s4)),
specific AS (SELECT casrn, regexp_replace(string_agg(o, ', ' ORDER BY o), '^ , ', ' ') AS other FROM s5 GROUP BY 1)"""


def _predicted(flag: str, pattern: str) -> str:
    return (f"CASE WHEN {has('pathway', pattern)} AND ({flag} IS NULL OR {flag} = '0') THEN '1*' ELSE {flag} END "
            f"AS {flag}")


PREDICTED = SPECIFIC + f""", joined AS (
  SELECT c_custkey AS casrn, broad, cons, diet, ind, pharma, pest, uncategorised, other,
    {case_sql('c_mktsegment', {**PATHWAYS, 'FURNITURE': 'Cons., Ind., Pest., Diet.'})} AS pathway
  FROM customer LEFT JOIN flags f ON f.casrn = c_custkey LEFT JOIN specific s ON s.casrn = c_custkey),
p1 AS (SELECT casrn, broad, {_predicted('cons', 'Cons')}, {_predicted('diet', 'Diet')}, {_predicted('ind', 'Ind.')},
  pharma, {_predicted('pest', 'Pest')}, uncategorised, other, pathway FROM joined),
predicted AS (SELECT *, CASE WHEN pathway = 'Unknown' AND cons IS NULL AND diet IS NULL AND pest IS NULL
  AND ind IS NULL THEN '1' ELSE ' ' END AS no_info FROM p1)"""
TOKENS = """pieces AS (SELECT key, unnest(string_split(txt, sep)) AS raw, generate_subscripts(string_split(txt, sep), 1) AS pos
  FROM input), single AS (SELECT key, raw, min(pos) AS place FROM pieces WHERE raw NOT IN ('', ' ') GROUP BY 1, 2),
tokens AS (SELECT key, place, CASE WHEN regexp_matches(regexp_replace(raw, '^\\s+', ''), 'Pers.') THEN 'Personal care'
  ELSE regexp_replace(raw, '^\\s+', '') END AS value FROM single)"""


@query("broad_categories", f"WITH {CATEGORIES} SELECT source, cassette, rid AS {RECORD}, repeats, casrn, fromsource, "
       "split, cassette3, cassette4 FROM categories")
def broad_categories(spark, folder):
    return exposure.categorise(records(spark, folder))


@query("product_categories", f"WITH {PRODUCTS} SELECT * FROM product_categories")
def product_categories(spark, folder):
    return exposure.categorise_products(product_rows(spark, folder))


@query("category_union_flags", f"WITH {BROAD} SELECT * FROM flags")
def category_union_flags(spark, folder):
    known, used = records(spark, folder), product_rows(spark, folder)
    return rename(
        exposure.category_flags([exposure.categorise(known), exposure.categorise_products(used)]), PLAIN
    )


@query("specific_uses", f"WITH {SPECIFIC} SELECT * FROM specific")
def specific_uses(spark, folder):
    known, used = records(spark, folder), product_rows(spark, folder)
    return rename(
        exposure.specific_uses([exposure.catalogue_uses(known), exposure.product_specific_uses(used)]), PLAIN
    )


@query("predicted_flags", f"WITH {PREDICTED} SELECT * FROM predicted")
def predicted_flags(spark, folder):
    return rename(predicted_table(spark, folder), PLAIN)


@query("uses_to_rows", f"""WITH {PREDICTED}, input AS (SELECT casrn AS key, other AS txt, ',' AS sep FROM predicted),
{TOKENS} SELECT casrn, 'V' || place AS source, value, cons, diet, ind, pharma, pest, other, no_info
FROM predicted LEFT JOIN tokens ON key = casrn""")
def uses_to_rows(spark, folder):
    narrow = predicted_table(spark, folder).drop("broad", "Pathway", "Uncategorized Use")
    return rename(exposure.tokens_to_rows(narrow), PLAIN)


@query("tokens_to_rows", f"""WITH input AS (SELECT page_id AS key, url AS txt, '/' AS sep FROM pages
  UNION ALL SELECT -1 - doc_id, text, ',' FROM documents), {TOKENS}
SELECT key, CAST(place AS INTEGER) AS place, value FROM tokens""")
def tokens_to_rows(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("txt"))
    texts = table(spark, folder, "documents").select((-1 - F.col("doc_id")).alias("key"), F.col("text").alias("txt"))
    return exposure.use_tokens(pages, "key", "txt", "/").unionByName(
        exposure.use_tokens(texts, "key", "txt", ",")
    ).select("key", "place", "value")


@query("rows_to_tokens", """WITH input AS (SELECT page_id AS key, url AS txt, '/' AS sep FROM pages), """ + TOKENS + """
SELECT key, lower(string_agg(value, ', ' ORDER BY place)) AS uses FROM tokens GROUP BY 1""")
def rows_to_tokens(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("txt"))
    return rename(exposure.rows_to_tokens(exposure.use_tokens(pages, "key", "txt", "/"), "key"), PLAIN)


@query("tidy_sources", f"""WITH {PREDICTED}, input AS (SELECT casrn AS key, other AS txt, ',' AS sep FROM predicted),
{TOKENS}, cells AS (SELECT key, lower(string_agg(value, ', ' ORDER BY place)) AS uses FROM tokens GROUP BY 1)
SELECT casrn, cons, diet, ind, pharma, pest, no_info, coalesce(uses, '') AS uses
FROM predicted LEFT JOIN cells ON key = casrn""")
def tidy_sources(spark, folder):
    narrow = predicted_table(spark, folder).drop("broad", "Pathway", "Uncategorized Use")
    return rename(exposure.tidy_sources(narrow), PLAIN)
