"""Assay operators with line items as wells.

A part is a chemical, the return flag its channel, the line status its plate, the line number its dose level (1 to 7),
the quantity the concentration and the extended price the response. Wells without discount are controls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.functions import numeric as num
from dosescreen.operators import assay, joins, ranking
from dosescreen.operators.joins import join_on
from dosescreen.operators.quality import Audit
from dosescreen.operators.reshape import column_range, split_columns, unpivot, unpivot_groups, widen
from dosescreen.session import cut_lineage
from workload.registry import query, table

SLOTS = 7
KEYS = ["chem", "channel", "plate"]
CHANNELS = ["A", "N"]


def wells(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("chem"), F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("plate"),
        F.col("l_linenumber").alias("dose_level"), F.col("l_quantity").alias("conc"),
        F.col("l_extendedprice").alias("resp"), F.col("l_discount").alias("disc"),
        F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("flag"),
    )


def replicate_means(spark, folder) -> DataFrame:
    return wells(spark, folder).groupBy(*KEYS, "dose_level").agg(
        num.mean_strict("resp", 2).alias("resp_mean"), num.mean_strict("conc", 2).alias("conc"),
        F.sum("flag").cast("bigint").alias("flag_sum"),
    )


def folds(spark, folder) -> DataFrame:
    controls = assay.collapse_replicates(
        wells(spark, folder).where("disc = 0"), ["channel", "plate"], "resp", "flag", "control_bar", "control_flags", 2
    )
    return assay.fold_change(replicate_means(spark, folder), controls, ["channel", "plate"], mean="resp_mean")


def hits(spark, folder) -> DataFrame:
    """Test-only hit rule: a change of more than a quarter is significant."""
    marked = folds(spark, folder).withColumn("hit", (F.abs(F.col("foldchange") - 1) > 0.25).cast("int"))
    return assay.signed_hits(marked)


def directions(marked: DataFrame) -> DataFrame:
    return marked.groupBy("chem", "channel").agg(
        F.signum(F.sum(F.coalesce("hitd", F.lit(0)))).cast("int").alias("direction")
    )


def effects(marked: DataFrame) -> DataFrame:
    return assay.lec_mfc(marked, KEYS)


def respond(marked: DataFrame) -> DataFrame:
    ways = directions(marked)
    raised = join_on(effects(marked), ways, ["chem", "channel"]).where("direction = 1")
    return assay.responders(raised, ways, ["chem", "plate"], "chem", CHANNELS, "channel", ("LEC", "MFC"))


def settled_hits(spark, folder) -> DataFrame:
    """Hits as a table: effects and directions read different columns of it, three times in all."""
    return cut_lineage(hits(spark, folder))


def signif_sql(x: str) -> str:
    f = f"(({x}) - floor({x}))"
    k = f"pow(10.0, 1 - floor(log10({f})))"
    return (f"CASE WHEN isinf({x}) THEN NULL WHEN {f} = 0 THEN floor({x}) "
            f"ELSE floor({x}) + round_even({f} * {k}, 0) / {k} END")


MEANS = """means AS (
  SELECT l_partkey AS chem, l_returnflag AS channel, l_linestatus AS plate, l_linenumber AS dose_level,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS resp_mean,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS conc,
         CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS flag_sum
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
FOLDS = MEANS + f""", controls AS (
  SELECT l_returnflag AS channel, l_linestatus AS plate,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS control_bar,
         CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS control_flags
  FROM lineitem WHERE l_discount = 0 GROUP BY 1, 2),
raw AS (SELECT m.*, c.control_bar, c.control_flags, m.resp_mean / c.control_bar AS x
        FROM means m LEFT JOIN controls c ON m.channel = c.channel AND m.plate = c.plate),
folds AS (SELECT chem, channel, plate, dose_level, resp_mean, conc, flag_sum, control_bar, control_flags,
                 {signif_sql('x')} AS foldchange FROM raw)"""
HITS = FOLDS + """, hits AS (
  SELECT *, CASE WHEN abs(foldchange - 1) > 0.25 THEN 1 ELSE 0 END AS hit,
         CAST(sign(foldchange - 1) AS INTEGER) AS fc_dir,
         CASE WHEN abs(foldchange - 1) > 0.25 THEN CAST(sign(foldchange - 1) AS INTEGER) ELSE 0 END AS hitd
  FROM folds), directions AS (
  SELECT chem, channel, CAST(sign(sum(hitd)) AS INTEGER) AS direction FROM hits GROUP BY 1, 2)"""


# the doses before and after, joined by their numbers
NEIGHBOURS = HITS + """, doses AS (
  SELECT h.chem, h.channel, h.plate, h.dose_level, h.hitd, h.conc, h.foldchange,
         coalesce(h.hitd = 1 AND (b.hitd = 1 OR a.hitd = 1 OR (h.dose_level > 1 AND a.hitd IS NULL)), false) AS counts
  FROM hits h
  LEFT JOIN hits b ON b.chem = h.chem AND b.channel = h.channel AND b.plate = h.plate AND b.dose_level = h.dose_level - 1
  LEFT JOIN hits a ON a.chem = h.chem AND a.channel = h.channel AND a.plate = h.plate AND a.dose_level = h.dose_level + 1)"""
EFFECTS = NEIGHBOURS + """, effects AS (
  SELECT chem, channel, plate,
         coalesce(max(CASE WHEN counts THEN foldchange END), CAST('-inf' AS DOUBLE)) AS "MFC",
         coalesce(min(CASE WHEN counts THEN conc END), CAST('inf' AS DOUBLE)) AS "LEC"
  FROM doses GROUP BY 1, 2, 3)"""
RESPOND = EFFECTS + """, respond AS (
  SELECT e.chem, e.plate,
         max(CASE WHEN e.channel = 'A' THEN "LEC" END) AS "LEC_A", max(CASE WHEN e.channel = 'N' THEN "LEC" END) AS "LEC_N",
         max(CASE WHEN e.channel = 'A' THEN "MFC" END) AS "MFC_A", max(CASE WHEN e.channel = 'N' THEN "MFC" END) AS "MFC_N",
         any_value(w."A") AS "A", any_value(w."N") AS "N"
  FROM effects e JOIN directions d ON e.chem = d.chem AND e.channel = d.channel AND d.direction = 1
  JOIN (SELECT chem, max(CASE WHEN channel = 'A' THEN direction END) AS "A",
               max(CASE WHEN channel = 'N' THEN direction END) AS "N" FROM directions GROUP BY 1) w ON w.chem = e.chem
  WHERE e.channel IN ('A', 'N') GROUP BY 1, 2)"""


@query("replicate_mean", f"""WITH {MEANS} SELECT chem, channel, plate, dose_level, resp_mean, flag_sum FROM means""")
def replicate_mean(spark, folder):
    return assay.collapse_replicates(
        wells(spark, folder), [*KEYS, "dose_level"], "resp", "flag", "resp_mean", "flag_sum", 2
    )


@query("control_fold_change", f"WITH {FOLDS} SELECT * FROM folds")
def control_fold_change(spark, folder):
    return folds(spark, folder)


@query("natural_join", f"""WITH {FOLDS} SELECT m.*, c.control_bar, c.control_flags FROM means m NATURAL LEFT JOIN controls c""")
def natural_join(spark, folder):
    """Means beside the controls of the columns that both tables have: channel and plate."""
    controls = assay.collapse_replicates(
        wells(spark, folder).where("disc = 0"), ["channel", "plate"], "resp", "flag", "control_bar", "control_flags", 2
    )
    audit = Audit()
    joined = joins.natural_join(replicate_means(spark, folder), controls, keys=["channel", "plate"], null_keys_match=False, audit=audit)
    return audit.settled(joined)


@query("natural_join_keys", """SELECT 'doc_id' AS key, 'bigint' AS left_type, 'bigint' AS right_type,
  (SELECT count(*) FILTER (doc_id IS NULL) FROM documents) AS left_nulls, (SELECT count(*) FILTER (doc_id IS NULL) FROM labels) AS right_nulls""")
def natural_join_keys(spark, folder):
    return joins.key_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("dose_level_avg_rank", """
SELECT l_orderkey, l_linenumber, l_partkey AS chem, l_returnflag AS channel, l_quantity AS conc,
       rank() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity)
       + (count(*) OVER (PARTITION BY l_partkey, l_returnflag, l_quantity) - 1) / 2.0 AS dose_level FROM lineitem""")
def dose_level_avg_rank(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("chem"), F.col("l_returnflag").alias("channel"),
        F.col("l_quantity").alias("conc"),
    )
    return assay.dose_levels(rows, ["chem", "channel"])


def plate_ids(spark, folder) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("name"))
    run = table(spark, folder, "lineitem").select(
        "l_partkey", F.date_format("l_shipdate", "yyyyMMdd").alias("day"), "l_suppkey"
    ).distinct()
    named = join_on(run, parts, {"l_partkey": "p_partkey"}, "inner")
    return named.select(F.concat(
        F.col("day"), F.lit("_"), F.col("name"), F.lit("_Plate"), F.col("l_suppkey").cast("string")
    ).alias("date_chnm_plate")).distinct()


@query("lowest_plate_per_chem", """
WITH ids AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') AS date, replace(p_name, ' ', '_') AS chnm,
                    CAST(l_suppkey AS DOUBLE) AS plate, l_suppkey
             FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT date || '_' || chnm || '_Plate' || l_suppkey AS date_chnm_plate, date, chnm, plate FROM ids
QUALIFY rank() OVER (PARTITION BY chnm ORDER BY plate) = 1""")
def lowest_plate_per_chem(spark, folder):
    return ranking.lowest_with_ties(assay.plate_parts(plate_ids(spark, folder)), ["chnm"], "plate")


def plate_matrix(spark, folder) -> DataFrame:
    """Direction per plate: one column per plate."""
    each = hits(spark, folder).groupBy(*KEYS).agg(F.signum(F.sum("hitd")).cast("int").alias("way"))
    return widen(each, ["chem", "channel"], "plate", ["F", "O"], ["way"])


@query("direction_unpivot", f"""
WITH {HITS}, matrix AS (
  SELECT chem, channel, max(CASE WHEN plate = 'F' THEN way END) AS "F", max(CASE WHEN plate = 'O' THEN way END) AS "O"
  FROM (SELECT chem, channel, plate, CAST(sign(sum(hitd)) AS INTEGER) AS way FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT chem, channel, 'F' AS plate, "F" AS direction FROM matrix
UNION ALL SELECT chem, channel, 'O', "O" FROM matrix""")
def direction_unpivot(spark, folder):
    return unpivot(plate_matrix(spark, folder), ["chem", "channel"], ["F", "O"], "plate", "direction")


def hit_vectors(spark, folder) -> DataFrame:
    """Packed hit vectors as far as the last tested dose, one column per channel."""
    marked = hits(spark, folder).where("hitd IS NOT NULL").groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("dose_level", F.col("hitd").cast("string")))).alias("h"),
        F.max("dose_level").alias("last"),
    )
    texts = F.transform(F.sequence(F.lit(1), F.col("last").cast("int")), lambda k: F.coalesce(F.col("h")[k], F.lit("NA")))
    vectors = marked.select(*KEYS, F.concat(F.lit("c("), F.array_join(texts, ", "), F.lit(")")).alias("v"))
    return widen(vectors, ["chem", "plate"], "channel", ["A", "N", "R"], ["v"])


@query("hits_unpack", f"""
WITH {HITS}, v AS (
  SELECT chem, plate, channel, max(CASE WHEN hitd IS NOT NULL THEN dose_level END) AS last FROM hits GROUP BY 1, 2, 3),
packed AS (
  SELECT v.chem, v.plate, v.channel,
         'c(' || string_agg(coalesce(CAST(h.hitd AS VARCHAR), 'NA'), ', ' ORDER BY k) || ')' AS hits
  FROM (SELECT *, unnest(range(1, last + 1)) AS k FROM v) v
  LEFT JOIN hits h ON h.chem = v.chem AND h.plate = v.plate AND h.channel = v.channel AND h.dose_level = v.k
  GROUP BY 1, 2, 3),
grid AS (SELECT DISTINCT chem, plate FROM v WHERE last IS NOT NULL)
SELECT g.chem, g.plate, c.channel, p.hits, CAST(d.k AS INTEGER) AS dose_level, CAST(h.hitd AS DOUBLE) AS hit
FROM grid g CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(channel) CROSS JOIN range(1, {SLOTS + 1}) d(k)
LEFT JOIN packed p ON p.chem = g.chem AND p.plate = g.plate AND p.channel = c.channel
LEFT JOIN hits h ON h.chem = g.chem AND h.plate = g.plate AND h.channel = c.channel AND h.dose_level = d.k""")
def hits_unpack(spark, folder):
    return assay.unpack_hits(hit_vectors(spark, folder), ["chem", "plate"], ["A", "N", "R"], "channel", SLOTS)


@query("consecutive_hits", f"WITH {NEIGHBOURS} SELECT * FROM doses")
def consecutive_hits(spark, folder):
    return assay.consecutive_hits(hits(spark, folder), KEYS)


@query("lec_mfc", f"WITH {EFFECTS} SELECT * FROM effects")
def lec_mfc(spark, folder):
    return effects(hits(spark, folder))


@query("tested_range", """
SELECT l_partkey AS chem, l_returnflag AS channel, max(l_quantity) AS max_tested_conc, min(l_quantity) AS min_tested_conc
FROM lineitem GROUP BY 1, 2""")
def tested_range(spark, folder):
    return assay.tested_range(wells(spark, folder).select("chem", "channel", "conc"), ["chem", "channel"])


@query("responders_wide", f"WITH {RESPOND} SELECT * FROM respond")
def responders_wide(spark, folder):
    return respond(settled_hits(spark, folder))


@query("wide_long_multi_value", f"""
WITH {RESPOND}, long AS (
  SELECT chem, plate, "A", "N", 'A' AS channel, "LEC_A" AS "LEC", "MFC_A" AS "MFC" FROM respond
  UNION ALL SELECT chem, plate, "A", "N", 'N', "LEC_N", "MFC_N" FROM respond)
SELECT * FROM long WHERE "LEC" IS NOT NULL OR "MFC" IS NOT NULL""")
def wide_long_multi_value(spark, folder):
    return unpivot_groups(respond(settled_hits(spark, folder)), CHANNELS, ["LEC", "MFC"], "channel")


def matrix(spark, folder) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, folder, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"),
        F.when(size > 45, F.lit(1000000.0)).otherwise(price / 8).alias("X_A_up"),
        F.when(size > 5, price / size).alias("X_N_up"), price.alias("X_R_up"),
    )


def code_map(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("chem"),
    )


@query("attach_matrix_columns", f"""
WITH {RESPOND}, m AS (
  SELECT p_partkey AS chem, CASE WHEN p_size > 45 THEN 1000000.0::DOUBLE ELSE p_retailprice / 8 END AS v1,
         CASE WHEN p_size > 5 THEN p_retailprice / p_size END AS v2 FROM part)
SELECT r.chem, r.plate, printf('%.2f', v1) AS "AC50_A_text", printf('%.2f', v2) AS "AC50_N_text",
       CAST(printf('%.2f', v1) AS DOUBLE) AS "AC50_A", CAST(printf('%.2f', v2) AS DOUBLE) AS "AC50_N"
FROM respond r LEFT JOIN m ON r.chem = m.chem""")
def attach_matrix_columns(spark, folder):
    rows = respond(settled_hits(spark, folder)).select("chem", "plate")
    return assay.attach_matrix(
        rows, matrix(spark, folder), code_map(spark, folder), {"X_A_up": "AC50_A", "X_N_up": "AC50_N"}, "chem"
    )


@query("attach_distance", f"""
WITH {RESPOND} SELECT r.chem, r.plate, CAST(printf('%.2f', (p_size - 12) / 64.0::DOUBLE) AS DOUBLE) AS distance,
  printf('%.2f', (p_size - 12) / 64.0::DOUBLE) AS distance_text FROM respond r LEFT JOIN part ON chem = p_partkey""")
def attach_distance(spark, folder):
    distances = table(spark, folder, "part").select(
        F.col("p_partkey").alias("chem"), ((F.col("p_size") - 12) / F.lit(64.0)).alias("distance")
    )
    return assay.attach_distance(respond(settled_hits(spark, folder)).select("chem", "plate"), distances, ["chem"], "distance")


@query("matrix_with_calls", """
WITH m AS (SELECT 'C' || p_partkey AS code, p_partkey AS chem, p_size, p_retailprice FROM part), l AS (
  SELECT code, chem, 'X_A_up' AS name, (p_size - 20) / 8.0::DOUBLE AS "AC10",
         CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN -1 WHEN p_size < 30 THEN 0 ELSE 1 END AS hitcall,
         'A' AS hormone FROM m
  UNION ALL
  SELECT code, chem, 'X_N_up', CASE WHEN p_size > 5 THEN p_size / 16.0::DOUBLE END,
         CASE WHEN p_size > 25 THEN 0 ELSE 1 END, 'N' FROM m)
SELECT code, chem, name, "AC10", hitcall, hormone, CASE WHEN hitcall = 1 THEN "AC10" END AS "AC10_active",
  CASE WHEN hitcall = 0 THEN t || ' (not active)' WHEN hitcall = 1 THEN t END AS "AC10_label"
FROM (SELECT *, regexp_replace(CAST(round(pow(10, "AC10"), 3) AS VARCHAR), '\\.0$', '') AS t FROM l)""")
def matrix_with_calls(spark, folder):
    part = table(spark, folder, "part")
    code = F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code")
    size = F.col("p_size")
    values = part.select(
        code, ((size - 20) / F.lit(8.0)).alias("X_A_up"), F.when(size > 5, size / F.lit(16.0)).alias("X_N_up")
    )
    calls = part.select(
        code, F.when(size < 10, F.lit(None)).when(size < 20, -1).when(size < 30, 0).otherwise(1).alias("X_A_up"),
        F.when(size > 25, 0).otherwise(1).alias("X_N_up"),
    )
    rows = assay.matrix_with_calls(
        values, calls, code_map(spark, folder), {"X_A_up": "A", "X_N_up": "N"}, chem="chem"
    )
    value, call = F.col("AC10"), F.col("hitcall")
    return rows.withColumns({
        "AC10_active": assay.active_value(value, call), "AC10_label": assay.active_label(value, call)
    })


@query("prediction_upper_or_median", f"""
WITH p AS (
  SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100000 AS m,
         CASE WHEN max(l_quantity) < 50 THEN NULL ELSE max(l_extendedprice) / 10000 END AS u FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS casn, p_name AS chnm, {signif_sql('m')} AS seem3, {signif_sql('u')} AS seem3_u95
      FROM part LEFT JOIN p ON p_partkey = l_partkey)
SELECT casn, chnm, seem3, seem3_u95, CASE WHEN seem3_u95 IS NULL
  THEN regexp_replace(CAST(seem3 AS VARCHAR), '\\.0$', '') || ' (m)'
  ELSE regexp_replace(CAST(seem3_u95 AS VARCHAR), '\\.0$', '') || ' (u)' END AS seem FROM r""")
def prediction_upper_or_median(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("casn"), F.col("p_name").alias("chnm"))
    per_part = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("CAS")).agg(
        (num.mean_strict("l_extendedprice", 2) / 100000).alias("seem3"),
        F.when(F.max("l_quantity") >= 50, F.max("l_extendedprice") / 10000).alias("seem3_u95"),
    )
    quoted_names = join_on(per_part, part, {"CAS": "casn"}, "inner").withColumn(
        "Substance_Name", F.concat(F.lit('"'), F.col("chnm"), F.lit('"'))
    )
    predictions = quoted_names.withColumn("chnm", assay.clean_names(F.col("Substance_Name")))
    return assay.attach_prediction(
        part, predictions, {"casn": "CAS", "chnm": "chnm"}, upper="seem3_u95"
    )


@query("bioactivity_label", """
WITH top AS (SELECT l_partkey, max(greatest(l_discount, l_tax)) AS m FROM lineitem GROUP BY 1),
t AS (SELECT l.l_partkey, l_discount AS a, l_tax AS b, m FROM lineitem l JOIN top USING (l_partkey))
SELECT l_partkey AS chem, """ + ", ".join(
    f"""regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '') ||
  CASE WHEN {c} >= 0.1 THEN ' (active)' WHEN {c} >= 0.01 THEN ' (ambiguous)' ELSE '' END AS {n}"""
    for c, n in (("a", "agonist"), ("b", "antagonist"), ("m", "bioactivity"))) + " FROM t")
def bioactivity_label(spark, folder):
    areas = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("chem"), F.col("l_discount").alias("agonist"), F.col("l_tax").alias("antagonist")
    )
    return assay.label_areas(areas, "chem", "agonist", "antagonist", "bioactivity")


@query("tidy_wells", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN DATE '2013-03-20' WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS DATE) END
  AS date, CAST(o_custkey AS DOUBLE) AS plate, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS flag FROM orders""")
def tidy_wells(spark, folder):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    day = F.when(key % 7 == 0, "20130320").when(key % 11 == 0, "no date").otherwise(F.date_format("o_orderdate", "ddMMMyyyy"))
    rows = table(spark, folder, "orders").select(
        key, F.concat(day, F.lit(".x."), F.col("o_custkey").cast("string")).alias("apid"),
        F.when(status == "F", "ND").when(status == "P", "NQ").otherwise(F.col("o_totalprice").cast("string")).alias("ceetox_raw"),
    )
    return assay.tidy_wells(rows).select("o_orderkey", "date", "plate", "flag")


# plate ids of two chemicals: one with plates 10 and 2, one with two plates 3
PLATES = {1: "20130320_a_b_Plate10", 2: "20130320_a_b_Plate2", 3: "20130321_c_Plate3", 4: "20140702_c_Plate3"}


@query("direction_table", " UNION ALL ".join(
    f"""SELECT l_partkey, l_returnflag AS steroid, '{name}' AS date_chnm_plate, '{name.split('_')[0]}' AS date, '{chem}' AS chnm,
  CAST({plate} AS DOUBLE) AS plate, sum(CASE WHEN l_linenumber = {k} AND l_discount > 0.05 THEN 1 ELSE 0 END) % 3 - 1 AS direction
  FROM lineitem GROUP BY 1, 2""" for k, (name, chem, plate) in {
      2: (PLATES[2], "a_b", 2), 3: (PLATES[3], "c", 3), 4: (PLATES[4], "c", 3)}.items()))
def direction_table(spark, folder):
    ways = table(spark, folder, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("steroid")).agg(*[
        (F.count_if((F.col("l_linenumber") == k) & (F.col("l_discount") > 0.05)) % 3 - 1).alias(name)
        for k, name in PLATES.items()
    ])
    keyed = ways.select(F.struct("l_partkey", "steroid").alias("steroid"), *PLATES.values())
    return assay.direction_table(keyed, list(PLATES.values())).select("steroid.*", "date_chnm_plate", "date", "chnm", "plate", "direction")


@query("rank_key_join", """
WITH a AS (SELECT l_partkey AS chem, l_quantity AS conc, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity)
           + (count(*) OVER (PARTITION BY l_partkey, l_quantity) - 1) / 2.0 AS dose_level FROM lineitem),
x AS (SELECT l_partkey AS chem, l_tax, rank() OVER (PARTITION BY l_partkey ORDER BY l_tax)
      + (count(*) OVER (PARTITION BY l_partkey, l_tax) - 1) / 2.0 AS dose_level FROM lineitem),
b AS (SELECT chem, dose_level, max(l_tax) AS conc FROM x GROUP BY 1, 2)
SELECT a.chem, a.dose_level, a.conc AS conc_left, b.conc AS conc_right
FROM a LEFT JOIN b ON a.chem = b.chem AND a.dose_level = b.dose_level""")
def rank_key_join(spark, folder):
    """Two series of a chemical joined by their ranks, halves included; both have a column of the same name."""
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("chem"), F.col("l_quantity").alias("conc"), "l_tax")
    left = assay.dose_levels(rows.drop("l_tax"), ["chem"])
    right = assay.dose_levels(rows.select("chem", F.col("l_tax").alias("conc")), ["chem"])
    right = right.groupBy("chem", "dose_level").agg(F.max("conc").alias("conc"))
    out = join_on(left, right, ["chem", "dose_level"], suffixes=("_left", "_right"))
    return out.select("chem", "dose_level", "conc_left", "conc_right")


@query("name_parts", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second,
  nullif(split_part(p_name, ' ', 3), '') AS third, p_brand, p_type FROM part""")
def name_parts(spark, folder):
    parts = table(spark, folder, "part")
    named_ = parts.select(*column_range(parts, "p_partkey", "p_type"))
    return split_columns(named_, "p_name", ["first", "second", "third"], " ", remove=True)
