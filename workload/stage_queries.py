"""All four stages on a study made of the driver tables, with the counts that their checks take while writing.

A brand is a chemical, the line status its plate, the return flag the channel, the line number the dose and the extended
price the response; lines without discount are controls. Every line item is a well, every part a catalogue record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import text as txt
from dosescreen.operators.quality import Audit
from dosescreen.plans import stages
from dosescreen.session import cut_lineage
from workload.registry import query, table

STEROIDS = {"A": fixed.ESTRADIOL, "N": fixed.PROGESTERONE, "R": "OH-Pregnenolone"}
DOSES = 7
WITHOUT_PREDICTION = "Brand#11"


def study(spark, folder) -> dict[str, DataFrame]:
    """The tables of the first stage."""
    parts = table(spark, folder, "part")
    brands = sorted(r[0] for r in parts.select("p_brand").distinct().collect())
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    number = F.when(F.col("l_linestatus") == "F", 1).otherwise(2)
    plate = F.concat(F.lit("20130320_"), "p_brand", F.lit("_Plate"), number.cast("string"))
    wells = lines.select(
        F.when(F.col("l_discount") == 0, fixed.CONTROL_SAMPLE).otherwise("S").alias("spid"),
        *[F.when(F.col("l_discount") != 0, F.col("p_brand")).alias(c) for c in ("chnm", "casn")],
        F.concat(F.lit("20130320.x."), number.cast("string")).alias("apid"), txt.recode("l_returnflag", STEROIDS).alias("steroid"),
        F.col("l_linenumber").cast("int").alias("conc_index"), F.col("l_linenumber").cast("double").alias("conc"),
        F.col("l_extendedprice").alias("uM"), F.when(F.col("l_tax") == 0, "ND").otherwise("1").alias("ceetox_raw"),
    )
    # one pass over the lines: what the plates' tables are made of
    doses = cut_lineage(lines.groupBy(plate.alias(stages.PLATE), F.col("p_brand").alias("chnm"), txt.recode("l_returnflag", STEROIDS)
                                      .alias("steroid"), F.col("l_linenumber").alias("dose")).count())
    plates = [f"20130320_{b}_Plate{n}" for b in brands for n in (1, 2)]
    way = (F.sum(F.col("dose") * F.col("count")) % 3 - 1).cast("int")
    direction = doses.groupBy("steroid").pivot(stages.PLATE, plates).agg(way)
    hit = F.max(F.when(F.col("count") % 2 == 1, 1).otherwise(0))
    vector = F.concat(F.lit("c("), F.concat_ws(", ", *[
        F.coalesce(F.max(F.when(F.col("dose") == k, (F.col("count") % 2).cast("string"))), F.lit("NA")) for k in range(1, DOSES + 1)
    ]), F.lit(")"))
    hits = (doses.groupBy(stages.PLATE, F.col("chnm"), F.col("chnm").alias("casn"))
            .pivot("steroid", ["OH-Pregnenolone", fixed.PROGESTERONE, fixed.ESTRADIOL]).agg(vector))
    conc = doses.groupBy(stages.PLATE, F.col("dose").cast("double").alias("conc")).agg(hit.alias("p"))
    chemicals = cut_lineage(parts.groupBy(F.col("p_brand").alias("casn")).agg(
        F.avg(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("price"), F.max("p_size").alias("size")))
    code = F.concat(F.lit("C"), "casn").alias("code")
    return {
        "direction": direction, "hits": hits, "concentrations": conc, "wells": wells,
        "distances": chemicals.select(F.concat(F.lit("20130320_"), "casn", F.lit("_Plate1")).alias(stages.PLATE),
                                      F.col("casn").alias("chnm"), "casn", (F.col("price") / 100).alias("adj_maxmMD")),
        "ac50": chemicals.select(code, F.col("price").alias("CEETOX_H295R_ESTRADIOL_up"),
                                 F.col("size").cast("double").alias("CEETOX_H295R_PROG_up")),
        "substances": chemicals.select(F.col("casn").alias("chnm"), "casn", code),
        "predictions": chemicals.where(F.col("casn") != WITHOUT_PREDICTION).select(
            F.col("casn").alias("CAS"), F.col("casn").alias("Substance_Name"), (F.col("price") / 1e5).alias("seem3"),
            (F.col("price") / 1e4).alias("seem3.u95"), F.lit("All Four").alias("Pathway")),
    }


def results(spark, folder, audit: Audit) -> dict[str, DataFrame]:
    tables = study(spark, folder)
    gaps = tables["substances"].select("chnm").where(F.col("chnm") == WITHOUT_PREDICTION)
    potent = stages.potency(**tables, check=True, known_gaps=gaps, audit=audit)
    parts, key = table(spark, folder, "part"), "cpdat_substance_record_id"
    chem = F.col("p_brand").alias("casrn")
    exposure = stages.sources(
        potent, parts.select(F.col("p_partkey").alias(key), chem),
        parts.select(F.lit("list").alias("source"), F.concat_ws("|", F.lower("p_type"), "p_name").alias("cassette"), F.col("p_partkey").alias(key)),
        parts.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_use_category"), F.lit("list").alias("source")),
        parts.select(F.col("p_partkey").alias(key), F.col("p_partkey").alias("product_id")), tables["predictions"])
    names = parts.select(F.col("p_brand").alias("CAS_No"), F.col("p_brand").alias("name"), "p_type").distinct()
    evidence = stages.invivo(
        potent, parts.select(chem, F.lit("Reproductive").alias("risk_assessment_class"), F.lit("mammals").alias("species_supercategory"),
                             F.lit("LOAEL").alias("toxval_type"), F.lit("=").alias("toxval_numeric_qualifier"),
                             F.col("p_size").cast("double").alias("toxval_numeric"), F.lit("mg/kg-day").alias("toxval_units")),
        parts.select(chem, F.col("p_brand").alias("name"), F.lit("IARC").alias("source"), F.lit("Likely Human Carcinogen").alias("cancer_call"),
                     F.lit("oral").alias("exposure_route")).distinct(),
        names.where("p_type = 'SMALL'").drop("p_type"), names.where("p_type = 'LARGE'").drop("p_type"),
        parts.select(F.col("p_brand").alias("CASRN")).distinct(),
        names.select(F.col("name").alias("Chemical"), F.col("CAS_No").alias("CAS No."), F.lit("cancer").alias("Type of Toxicity")), ["IARC"])
    single = tables["substances"]
    return stages.integration(
        potent, exposure["tidy"], evidence["matrix"],
        single.select(F.col("casn").alias("CASRN_Adj (4-30-21)"), F.lit(0.2).alias("AUC.Agonist"), F.lit(0.05).alias("AUC.Antagonist")),
        single.select(F.col("casn").alias("CASRN"), F.lit("considered - other").alias("status")), tables["ac50"],
        single.select("code", F.lit(1).alias("CEETOX_H295R_ESTRADIOL_up"), F.lit(1).alias("CEETOX_H295R_PROG_up")), single,
        parts.select(F.upper("p_name").alias("Ingredient"), F.lit("RX").alias("Type")),
        single.select(F.col("casn").alias("CASN"), F.lit(1.0).alias("Active products"), F.lit(None).cast("double").alias("Not active products")),
        uses=exposure["specific"], check=True, audit=audit)


COUNTS = f"""WITH w AS (SELECT p_brand AS chnm, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS plate, l_linenumber AS dose,
  CASE l_returnflag WHEN 'A' THEN '{fixed.ESTRADIOL}' WHEN 'N' THEN '{fixed.PROGESTERONE}' ELSE 'OH-Pregnenolone' END AS steroid,
  l_discount = 0 AS control FROM lineitem JOIN part ON l_partkey = p_partkey),
brands AS (SELECT DISTINCT p_brand AS chnm FROM part),
raised AS (SELECT chnm, steroid FROM w WHERE plate = 1 AND steroid <> 'OH-Pregnenolone' GROUP BY ALL HAVING sum(dose) % 3 - 1 = 1),
dosed AS (SELECT sum(CASE WHEN chnm IN (SELECT chnm FROM w WHERE plate = 1) THEN {DOSES} ELSE 1 END)
  * (SELECT count(DISTINCT steroid) FROM w) AS n FROM brands),
means AS (SELECT DISTINCT steroid, CASE WHEN NOT control THEN chnm END AS chnm, plate, dose FROM w),
chosen AS (SELECT count(DISTINCT chnm) AS n FROM raised), series AS (SELECT count(*) AS n FROM raised)
SELECT name, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'lowest' AS name, 'rows' AS metric, count(*) AS value FROM brands UNION ALL SELECT 'lowest', 'ambiguous', 0
  UNION ALL SELECT 'levels', 'rows', count(DISTINCT (chnm, plate, dose)) FROM w UNION ALL SELECT 'levels', 'tied', 0
  UNION ALL SELECT m, 'rows', count(*) FROM means CROSS JOIN (VALUES ('means'), ('folds')) t(m) GROUP BY m
  UNION ALL SELECT m, 'unnamed', count(*) FROM means CROSS JOIN (VALUES ('means'), ('folds')) t(m) WHERE chnm IS NULL GROUP BY m
  UNION ALL SELECT m, 'rows', n FROM dosed CROSS JOIN (VALUES ('dosed'), ('combined')) t(m)
  UNION ALL SELECT m, 'rows', n FROM chosen CROSS JOIN (VALUES ('distanced'), ('measured'), ('potent')) t(m)
  UNION ALL SELECT 'potent', 'gaps', 0
  UNION ALL SELECT m, 'rows', n FROM series CROSS JOIN (VALUES ('with_areas'), ('integrated')) t(m)
  UNION ALL SELECT steroid, 'published', count(*) FROM raised GROUP BY steroid)"""


@query("study_counts", COUNTS)
def study_counts(spark, folder):
    """What the checks of all stages count in the passes that write them, and the rows of both published tables."""
    audit = Audit()
    out = results(spark, folder, audit)
    published = None
    for hormone in fixed.CHANNELS:
        rows = out[hormone].groupBy(F.lit(hormone).alias("name"), F.lit("published").alias("metric")).agg(F.count("*").alias("value"))
        published = rows if published is None else published.unionByName(rows)
    return audit.report(spark).unionByName(published)
