"""All four stages on one small made-up study, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.operators import quality
from dosescreen.plans import runs, stages
from tests.conftest import rows

P1, P2 = "20130320_Alpha_Plate1", "20130320_Alpha_Plate2"
B1 = "20130321_Beta_x_Plate1"
DOSES = [0.1, 0.5, 1.0, 5.0, 10.0, 50.0]


def study(spark):
    # Alpha raises estradiol on its first plate; Beta_x raises both; the second plate of Alpha is ignored
    direction = spark.createDataFrame(
        [("OH-Pregnenolone", 0, 0, 0), ("Progesterone", 0, 1, 1), ("Estradiol", 1, -1, 1)],
        f"steroid string, {P1} int, {P2} int, {B1} int")
    hits = spark.createDataFrame([
        (P1, "Alpha", "1-1-1", "c(0, 0, 0, 0, 0, 0)", "c(0, 0, 0, 0, 0, 0)", "c(0, 1, 0, 1, 1, 0)"),
        (P2, "Alpha", "1-1-1", "c(0, 0, 0, 0, 0, 0)", "c(1, 1, 1, 1, 1, 1)", "c(1, 1, 1, 1, 1, 1)"),
        (B1, "Beta_x", "2-2-2", "c(0, 0, 0, 0, 0, 0)", "c(0, 0, 0, 0, 0, 1)", "c(1, 0, 0, 0, 0, 0)"),
    ], "date_chnm_plate string, chnm string, casn string, `OH-Pregnenolone` string, Progesterone string, Estradiol string")
    conc = spark.createDataFrame([(p, c, 0.5) for p in (P1, P2, B1) for c in DOSES],
                                 "date_chnm_plate string, conc double, p double")
    wells = []
    folds = {("1-1-1", "Estradiol"): [1.0, 1.6, 1.1, 1.8, 2.0, 1.0], ("2-2-2", "Progesterone"): [1, 1, 1, 1, 1, 3.456],
             ("2-2-2", "Estradiol"): [1.9, 1, 1, 1, 1, 1]}
    for (casn, steroid), values in folds.items():
        for i, f in enumerate(values):
            for rep in (0.9, 1.1):
                wells.append(("s", "name", casn, "20130320.x.1", steroid, i + 1, DOSES[i], 2.0 * f * rep, "5"))
    for steroid in ("Estradiol", "Progesterone"):
        for v in (1.0, 3.0):
            wells.append(("DMSO", None, None, "20130320.x.1", steroid, 0, 0.0, v, "ND"))
    wells = spark.createDataFrame(wells, "spid string, chnm string, casn string, apid string, steroid string, "
                                         "conc_index int, conc double, uM double, ceetox_raw string")
    distances = spark.createDataFrame([(P1, "Alpha", "1-1-1", 1.234), (B1, "Beta_x", "2-2-2", 0.004)],
                                      "date_chnm_plate string, chnm string, casn string, adj_maxmMD double")
    ac50 = spark.createDataFrame([("C1", 12.345, 1000000.0), ("C2", None, 3.0)],
                                 "code string, CEETOX_H295R_ESTRADIOL_up double, CEETOX_H295R_PROG_up double")
    substances = spark.createDataFrame([("Alpha", "1-1-1", "C1"), ("Beta", "2-2-2", "C2")],
                                       "chnm string, casn string, code string")
    predictions = spark.createDataFrame([("1-1-1", '"Alpha"', 0.01, 0.02345, "All Four")],
        "CAS string, Substance_Name string, seem3 double, `seem3.u95` double, Pathway string")
    return {"direction": direction, "hits": hits, "concentrations": conc, "wells": wells, "distances": distances,
            "ac50": ac50, "substances": substances, "predictions": predictions}


@pytest.fixture(scope="module")
def potent(spark):
    gaps = spark.createDataFrame([("Beta_x",)], "chnm string")
    return stages.potency(**study(spark), check=True, known_gaps=gaps).cache()


@pytest.mark.parametrize("broken, message", [
    ({"direction": lambda d: d.withColumn("20140702_Alpha_Plate1", F.col(P1))}, "chnm.* not unique"),
    ({"concentrations": lambda d: d.union(d)}, "dose_level.* not unique"),
    ({"wells": lambda d: d.union(d.withColumn("apid", F.lit("20130321.x.1")))}, "foldchange|dose_level.* not unique"),
    ({"substances": lambda d: d.union(d)}, "code.* not unique"),
    ({"ac50": lambda d: d.union(d)}, "casn.* not unique"),
    ({}, "known gaps"),
])
def test_potency_checks(spark, broken, message):
    tables = study(spark)
    for name, spoil in broken.items():
        tables[name] = spoil(tables[name])
    with pytest.raises(ValueError, match=message):
        stages.potency(**tables, check=True, known_gaps=spark.createDataFrame([], "chnm string"))


def test_potency(potent):
    got = {r["casn"]: r.asDict() for r in potent.collect()}
    assert set(got) == {"1-1-1", "2-2-2"}
    a, b = got["1-1-1"], got["2-2-2"]
    # the lone hit at dose 2 does not count, doses 4 and 5 do
    assert (a["LEC_Estradiol"], a["MFC_Estradiol"], a["LEC_Progesterone"]) == (5.0, 2.0, None)
    # a first dose alone does not count: no lowest concentration; the highest dose alone does
    assert (b["LEC_Estradiol"], b["MFC_Estradiol"]) == (float("inf"), float("-inf"))
    assert (b["LEC_Progesterone"], b["MFC_Progesterone"]) == (50.0, 3.46)
    assert (a["Estradiol"], a["Progesterone"], b["Estradiol"], b["Progesterone"]) == (1, 0, 1, 1)
    assert (a["hits_Estradiol"], a["max_tested_conc"], a["min_tested_conc"]) == ("c(0, 1, 0, 1, 1, 0)", 50.0, 0.1)
    assert (a["adj_maxmMD"], b["adj_maxmMD"]) == (1.23, 0.0)
    assert (a["AC50_Estradiol"], a["AC50_Progesterone"], b["AC50_Estradiol"]) == (
        float("%.2f" % 12.345), 1000000.0, None)
    assert (a["seem"], a["Pathway"], b["seem"]) == ("0.023 (u)", "All Four", None)


def exposure_inputs(spark):
    key = "cpdat_substance_record_id"
    ids = spark.createDataFrame([(1, "1-1-1"), (2, "9-9-9")], f"{key} int, casrn string")
    paths = spark.createDataFrame([("Cat", "pesticide|fragrance", 1), ("Cat", "toy", 2)], f"source string, cassette string, {key} int")
    products = spark.createDataFrame([(7, "hair color", "s")], "product_id int, product_use_category string, source string")
    ingredients = spark.createDataFrame([(1, 7)], f"{key} int, product_id int")
    predictions = spark.createDataFrame([("1-1-1", "All Four"), ("2-2-2", "Unknown")], "CAS string, Pathway string")
    return {"ids": ids, "paths": paths, "products": products, "ingredients": ingredients, "predictions": predictions}


@pytest.fixture(scope="module")
def exposure_tables(spark, potent):
    return stages.sources(potent, **exposure_inputs(spark))


def test_sources(exposure_tables):
    assert rows(exposure_tables["tidy"], "casrn", "Cons.", "Diet", "Ind.", "Pharma.", "Pest.", "No Toxcast Info.",
                "Sources of Interest") == [
        ("1-1-1", "1", "1*", "1*", "0", "1", " ", "fragrance, hair dye"), ("2-2-2", None, None, None, None, None, "1", "")]
    assert rows(exposure_tables["specific"], "casrn", "source", "value") == [
        ("1-1-1", "V1", "Fragrance"), ("1-1-1", "V2", "Hair dye"), ("2-2-2", None, None)]


def evidence_inputs(spark):
    studies = spark.createDataFrame([("1-1-1", "Reproductive", "mammals", "LOAEL", "=", 5.0, "mg/kg-day")],
        "casrn string, risk_assessment_class string, species_supercategory string, toxval_type string, "
        "toxval_numeric_qualifier string, toxval_numeric double, toxval_units string")
    calls = spark.createDataFrame([("1-1-1", "Alpha", "IARC", "Likely Human Carcinogen", "oral")],
                                  "casrn string, name string, source string, cancer_call string, exposure_route string")
    lists = spark.createDataFrame([("2-2-2", "Beta")], "CAS_No string, name string")
    survey = spark.createDataFrame([("1-1-1",)], "CASRN string")
    listed = spark.createDataFrame([("Beta", "2-2-2/3", "cancer")], "Chemical string, `CAS No.` string, `Type of Toxicity` string")
    return {"studies": studies, "cancer_calls": calls, "developmental": lists, "carcinogens": lists, "survey": survey, "listed": listed}


@pytest.fixture(scope="module")
def evidence_tables(spark, potent):
    return stages.invivo(potent, **evidence_inputs(spark), call_sources=["IARC", "EPA"])


def test_invivo(evidence_tables):
    assert rows(evidence_tables["matrix"], "casn", "Nhanes", fixed.MAMMARY_COLUMN, fixed.CANCER_SUMMARY, fixed.TOXICITY_SUMMARY) == [
        ("1-1-1", 1, "", "Likely", "Likely"),
        ("2-2-2", 0, "Mammary carcinogen and developmental toxicant", "Likely", "Likely")]
    assert rows(evidence_tables["calls"]) == [("1-1-1", "Alpha", "Likely Human Carcinogen (oral)", None)]


def integration_inputs(spark):
    areas = spark.createDataFrame([("1-1-1", 0.2, 0.05)], "`CASRN_Adj (4-30-21)` string, `AUC.Agonist` double, `AUC.Antagonist` double")
    pesticides = spark.createDataFrame([("1-1-1", "considered - other")], "CASRN string, status string")
    ac10 = spark.createDataFrame([("C1", 1.0, None)], "code string, CEETOX_H295R_ESTRADIOL_up double, CEETOX_H295R_PROG_up double")
    calls = spark.createDataFrame([("C1", 1, None)], "code string, CEETOX_H295R_ESTRADIOL_up int, CEETOX_H295R_PROG_up int")
    substances = spark.createDataFrame([("C1", "1-1-1")], "code string, casn string")
    drugs = spark.createDataFrame([("ALPHA; OMEGA", "RX")], "Ingredient string, Type string")
    status = spark.createDataFrame([("2-2-2", 3.0, None)], "CASN string, `Active products` double, `Not active products` double")
    return {"areas": areas, "pesticides": pesticides, "ac10": ac10, "hit_calls": calls, "substances": substances,
            "drug_products": drugs, "pesticide_status": status}


def test_integration(spark, potent, exposure_tables, evidence_tables):
    given = integration_inputs(spark)
    out = stages.integration(potent, exposure_tables["tidy"], evidence_tables["matrix"], **given,
                             uses=exposure_tables["specific"], check=True)
    e2, p4 = out[fixed.ESTRADIOL], out[fixed.PROGESTERONE]
    assert len(e2.columns) == 39 and len(p4.columns) == 39
    assert "Direction of P4 synthesis" in e2.columns and "Direction of E2 synthesis" in p4.columns
    assert rows(e2, "CASN", "MFC", "LEC", "AC50", "AC10", "Efficacy/potency", "Efficacy/potency rank", fixed.CONCERN) == [
        ("1-1-1", 2.0, 5.0, "%.2f" % 12.345, "10", "lower", 1, "yes"),
        ("2-2-2", float("-inf"), float("inf"), " ", None, "borderline active", None, "no")]
    assert rows(e2, "CASN", "ER Bioactivity", "FDA approved drug products", "EPA approved pesticide products",
                "Effect on mammary gland") == [
        ("1-1-1", "0.2 (active)", "yes", "no", "Other effect" + fixed.PESTICIDE_EFFECT_NOTE),
        ("2-2-2", None, "no", "yes", " ".join(label for _, label in fixed.MAMMARY_LABELS[:2]))]
    # distance rounds to zero, so the second chemical is not ranked although it is potent in progesterone
    assert rows(p4, "CASN", "Efficacy/potency") == [("2-2-2", "borderline active")]
    assert rows(out["points"], "CASN", "hormone", "AC10_active") == [("1-1-1", "Estradiol", 1.0)]
    assert out["ingredients"].where(F.col("ingredients") == "omega").count() == 1
    # one complete pair per hormone at most: counted, not tested
    assert {(r["hormone"], r["POD"]): r["n"] for r in out["correlations"].collect()} == {
        ("Estradiol", "AC50_active"): 1, ("Estradiol", "AC10_all"): 1, ("Estradiol", "AC10_active"): 1}
    assert out["bands"].count() == 0
    assert rows(out["cluster_sizes"]) == [("Estradiol", "lower", 1)]
    assert rows(out["source_counts"], "category", "hormones", "n") == [
        ("Consumer", "Estradiol", 1), ("Diet", "Estradiol", 1), ("Industrial", "Estradiol", 1), ("Pest.", "Estradiol", 1)]
    assert rows(out["use_counts"], "value", "Hormone_set", "n") == [("Fragrance", "Estradiol", 1), ("Hair dye", "Estradiol", 1)]
    assert rows(out["labels"], "CASN", "cluster") == [("1-1-1", "lower")]
    assert out["exposure_bins"].count() <= 1
    given["pesticides"] = given["pesticides"].union(given["pesticides"])
    with pytest.raises(ValueError, match="not unique"):
        stages.integration(potent, exposure_tables["tidy"], evidence_tables["matrix"], **given, check=True)


def test_a_broken_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    """The third stage fails once; the next run builds it and what follows, and reads the first two stages."""
    tables = (study(spark), exposure_inputs(spark), evidence_inputs(spark), integration_inputs(spark), ["IARC", "EPA"])

    def killed(*_, **__):
        raise RuntimeError("lost")

    first = runs.Run(spark, str(tmp_path))
    monkeypatch.setattr(stages, "invivo", killed)
    with pytest.raises(RuntimeError, match="lost"):
        stages.study(first, *tables)
    assert (first.built, first.resumed) == (["potency", "sources"], [])
    monkeypatch.undo()
    second = runs.Run(spark, str(tmp_path))
    out = stages.study(second, *tables)
    assert (second.built, second.resumed) == (["invivo", "integration"], ["potency", "sources"])
    assert rows(out["integration"][fixed.ESTRADIOL], "CASN", "MFC") == [("1-1-1", 2.0), ("2-2-2", float("-inf"))]
    third = runs.Run(spark, str(tmp_path))
    changed = {**tables[1], "predictions": tables[1]["predictions"].limit(1)}
    stages.study(third, tables[0], changed, *tables[2:])
    assert (third.built, third.resumed) == (["sources", "integration"], ["potency", "invivo"])


def test_checks_start_no_job_of_their_own(spark, monkeypatch):
    """Nothing but the writes computes anything; a count that is off is made sure of before it is an error."""
    def fail(*_):
        raise AssertionError("a check computed its findings")

    monkeypatch.setattr(quality, "require_empty", fail)
    audit = quality.Audit()
    gaps = spark.createDataFrame([("Beta_x",)], "chnm string")
    assert stages.potency(**study(spark), check=True, known_gaps=gaps, audit=audit).count() == 2
    counts = audit.counts()
    assert counts["lowest"] == {"rows": 2, "ambiguous": 0} and counts["potent"] == {"rows": 2, "gaps": 0}
    assert counts["means"]["unnamed"] == counts["folds"]["unnamed"] == 2
    monkeypatch.undo()
    audit = quality.Audit()
    table = audit.watch(spark.range(5), "five", odd=F.count_if(F.col("id") % 2 == 1))
    audit.expect(lambda c: c["five"]["odd"] == 7, lambda: spark.range(0), "a false alarm")
    assert audit.settled(table).count() == 5
    assert rows(audit.report(spark)) == [("five", "odd", 2), ("five", "rows", 5)]
    with pytest.raises(ValueError, match="watched already"):
        audit.watch(spark.range(1), "five")


def test_a_table_that_spark_leaves_out_is_checked_exactly(spark):
    asked = []

    def findings():
        asked.append(1)
        return spark.range(0)

    audit = quality.Audit()
    side = audit.watch(spark.range(5).groupBy("id").count(), "side")
    audit.expect(lambda c: c["side"]["rows"] == 5, findings, "never")
    joined = spark.range(10).where("id > 100").join(side, "id", "left_semi")
    assert audit.settled(joined).count() == 0 and audit.counts().get("side", {"rows": 5}) == {"rows": 5}
    assert len(asked) == ("side" not in audit.counts())
