from dosescreen import fixed_values as fixed
from dosescreen.operators import evidence
from tests.conftest import rows

SCHEMA = ("casrn string, risk_assessment_class string, species_supercategory string, toxval_type string, "
          "toxval_numeric_qualifier string, toxval_numeric double, toxval_units string")
D = "mg/kg-day"


def test_study_classes(spark):
    data = [
        ("Reproductive", "mammals", "LOAEL", "=", 50.0, D), ("Reproductive", "mammals", "LOAEL", ">", 50.0, D),
        ("Developmental", "mammals", "NOAEL", ">=", 100.0, D), ("Developmental", "mammals", "NOAEL", "<", 99.9, D),
        ("Reproductive developmental", "mammals", "LOEL", "~", 100.0, D), ("Reproductive", "mammals", "NOEL", "<", 500.0, D),
        ("Reproductive", "mammals", "NOEL", "=", 500.0, "ppm"), ("Developmental neurotoxicity", "mammals", "LOEL", "=", 1.0, D),
        ("Reproductive", "birds", "LOEL", "=", 1.0, D), ("chronic", "mammals", "LOEL", "=", 1.0, D),
        ("Reproductive", "mammals", "LD50", "=", 1.0, D), (None, "mammals", "LOEL", "=", 1.0, D),
        ("Developmental", "mammals", "LOAEL", None, 1.0, D),
    ]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(data)], SCHEMA)
    got = [r["summary"] for r in sorted(evidence.classify_studies(df).collect(), key=lambda r: int(r["casrn"]))]
    vague = "uncategorized (vague toxicity value or different units)"
    none = "not a developmental or reproductive risk assessment"
    assert got == [
        "reproductive - toxicant with effect level < 100", f"reproductive - {vague}",
        "developmental - unlikely (NOEL over 100 mg/kg-day)", "developmental - NOEL less than 100 mg/kg-day",
        "repro/dev - toxicant with effect level >= 100", f"reproductive - {vague}", f"reproductive - {vague}",
        none, none, none, f"reproductive - {vague}", none, f"developmental - {vague}",
    ]


def test_evidence_flags(spark):
    data = [("a", "Reproductive", "mammals", "LOAEL", "=", 5.0, D), ("a", "Developmental", "mammals", "NOEL", "=", 500.0, D),
            ("b", "chronic", "mammals", "LOAEL", "=", 5.0, D), ("c", "reproductive developmental", "mammals", "LOEL", ">", 1.0, D)]
    flags = evidence.evidence_flags(evidence.classify_studies(spark.createDataFrame(data, SCHEMA)))
    got = {r["casrn"]: [n for n in evidence.EVIDENCE_FLAGS if r[n]] for r in flags.collect()}
    assert got == {"a": ["tested", "dev_unlikely", "repro_below"], "b": [],
                   "c": ["tested", "repro_imprecise", "dev_imprecise"]}


def test_call_priority(spark):
    calls = spark.createDataFrame([
        ("a", "Not Yet  Determined"), ("a", "Likely Human Carcinogen"), ("a", "Not Likely to Be Carcinogenic in Humans"),
        ("b", "Not Yet  Determined"), ("b", "Not Likely to Be Carcinogenic in Humans"), ("c", "Not Yet  Determined"),
        ("d", "odd"), ("e", None)], "casrn string, cancer_call string")
    assert rows(evidence.call_classes(calls)) == [
        ("a", "Likely"), ("b", "Unlikely"), ("c", "Inadequate evidence"), ("d", "FIX"), ("e", "FIX")]


LIST = [("x (Delisted)", "1-1-1", "cancer"), ("two", "50-00-0; 50-00-1", "cancer, developmental"), ("none", "---", "cancer"),
        ("three", "1/2/3", "developmental"), ("null", None, "cancer"), (None, " 7 ", None)]


def test_list_cleanup(spark):
    df = spark.createDataFrame(LIST, "Chemical string, `CAS No.` string, `Type of Toxicity` string")
    assert rows(evidence.clean_list(df, max_ids=2), "CAS No.") == [("1",), ("2",), ("50-00-0",), ("50-00-1",), ("7",)]
    assert rows(evidence.clean_list(df), "CAS No.") == [
        ("1",), ("2",), ("3",), ("50-00-0",), ("50-00-1",), ("7",)]
    assert rows(evidence.list_flags(evidence.clean_list(df))) == [
        ("1", False, True), ("2", False, True), ("3", False, True), ("50-00-0", True, True), ("50-00-1", True, True), ("7", False, False)]


def test_matrix_and_summary(spark):
    chemicals = spark.createDataFrame([(n, n) for n in ("a", "b", "c", "d", "1", "z")], "chnm string, casn string")
    studies = spark.createDataFrame([
        ("a", "Reproductive", "mammals", "LOAEL", "=", 5.0, D), ("a", "Developmental", "mammals", "NOEL", "=", 500.0, D),
        ("b", "reproductive developmental", "mammals", "NOEL", "=", 500.0, D),
        ("c", "reproductive developmental", "mammals", "LOEL", ">", 1.0, D), ("d", "chronic", "mammals", "LOEL", "=", 1.0, D),
    ], SCHEMA)
    calls = spark.createDataFrame([("a", "Likely Human Carcinogen"), ("b", "Not Likely to Be Carcinogenic in Humans")],
                                  "casrn string, cancer_call string")
    listed = spark.createDataFrame(LIST, "Chemical string, `CAS No.` string, `Type of Toxicity` string")
    dev = spark.createDataFrame([("d",), ("z",)], "CAS_No string")
    cancer = spark.createDataFrame([("z",), ("c",)], "CAS_No string")
    survey = spark.createDataFrame([("b",), ("b",)], "CASRN string")
    matrix = evidence.evidence_matrix(
        chemicals, evidence.evidence_flags(evidence.classify_studies(studies)), evidence.call_classes(calls),
        evidence.list_flags(evidence.clean_list(listed)), survey, dev, cancer)
    both = "Reproductive and developmental"
    assert rows(matrix.drop("chnm")) == [
        ("1", 0, "", "No assessment", "", "", "no repro nor dev tests in ToxValDb", "Developmental"),
        ("a", 0, "", "Likely", "Reproductive", "Developmental", "", ""),
        ("b", 1, "", "Unlikely", "", both, "", ""),
        ("c", 0, "Mammary carcinogen", "No assessment", "", "",
         "repro/dev - imprecise toxicity value or different units", ""),
        ("d", 0, "Mammary developmental toxicant", "No assessment", "", "", "no repro nor dev tests in ToxValDb", ""),
        ("z", 0, "Mammary carcinogen and developmental toxicant", "No assessment", "", "",
         "no repro nor dev tests in ToxValDb", ""),
    ]
    summary = evidence.evidence_summary(matrix)
    assert rows(summary, "casn", fixed.CANCER_SUMMARY, fixed.TOXICITY_SUMMARY) == [
        ("1", "Inadequate evidence", "Likely"), ("a", "Likely", "Likely"), ("b", "Unlikely", "Unlikely"),
        ("c", "Likely", "Inadequate evidence"), ("d", "Inadequate evidence", "Likely"), ("z", "Likely", "Likely")]


def test_calls_by_source(spark):
    df = spark.createDataFrame(
        [("a", "n", "s1", "B", "-"), ("a", "n", "s1", "A", "oral"), ("a", "n", "s2", "C", None)],
        "casrn string, name string, source string, cancer_call string, exposure_route string")
    assert rows(evidence.calls_by_source(df, ["s1", "s2", "s3"])) == [("a", "n", "A (oral), B", "C", None)]
