import datetime
import itertools
import random
import math

from pyspark.sql import functions as F

from dosescreen.operators import assay
from tests.conftest import rows


def literal_rule(h):
    """The rule for six doses written out dose by dose."""
    def hit(k):
        return h[k - 1] == 1

    def open_or_hit(k):
        return h[k - 1] is None or h[k - 1] == 1

    return [
        hit(1) and hit(2), hit(2) and (hit(1) or open_or_hit(3)), hit(3) and (hit(2) or open_or_hit(4)),
        hit(4) and (hit(3) or open_or_hit(5)), hit(5) and (hit(4) or open_or_hit(6)), hit(6),
    ]


def test_consecutive_rule_on_all_vectors(spark):
    vectors = list(itertools.product([0, 1, -1, None], repeat=6))
    data = [(i, k + 1, h, float(k + 1), 10.0 * (k + 1)) for i, v in enumerate(vectors) for k, h in enumerate(v)]
    df = spark.createDataFrame(data, "id int, dose_level int, hitd int, conc double, foldchange double")
    got = {}
    for r in assay.consecutive_hits(df, ["id"]).select("id", "dose_level", "counts").collect():
        got.setdefault(r[0], {})[r[1]] = r[2]
    want = {i: dict(enumerate(literal_rule(v), 1)) for i, v in enumerate(vectors)}
    assert got == want
    effects = {r["id"]: (r["LEC"], r["MFC"]) for r in assay.lec_mfc(df, ["id"]).collect()}
    for i, v in enumerate(vectors):
        doses = [k for k, ok in enumerate(literal_rule(v), 1) if ok]
        assert effects[i] == ((min(doses), 10.0 * max(doses)) if doses else (math.inf, -math.inf))


def test_missing_slots_are_open_ends(spark):
    df = spark.createDataFrame([("a", 2, 1, 2.0, 1.6), ("b", 1, 1, 1.0, 1.7)],
                               "id string, dose_level int, hitd int, conc double, foldchange double")
    # a second dose without a third one counts, a first dose without a second one does not
    assert rows(assay.lec_mfc(df, ["id"]), "id", "LEC", "MFC") == [("a", 2.0, 1.6), ("b", math.inf, -math.inf)]


def test_any_number_of_doses_and_repeated_ones(spark):
    kind = "id string, dose_level double, hitd int, conc double, foldchange double"
    eight = [("a", float(k), 1, float(k), 2.0 + k) for k in range(1, 9)]
    other = [("b", 2.0, 1, 5.0, 3.0), ("b", 2.0, 0, 1.0, 7.0), ("b", 2.5, 1, 0.1, 9.0), ("c", None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(eight + other, kind)
    # a repeated dose is read as its hit row, whole; half levels and missing ones do not count
    assert rows(assay.lec_mfc(df, ["id"]), "id", "LEC", "MFC") == [
        ("a", 1.0, 10.0), ("b", 5.0, 3.0), ("c", math.inf, -math.inf)]
    assert assay.consecutive_hits(df, ["id"]).where("counts").count() == 9
    assert assay.lec_mfc(df.limit(0), ["id"]).count() == 0


def test_plate_parts(spark):
    df = spark.createDataFrame([("20130320_a_b_Plate10",), ("20130320_x_Plate2",), ("bad",)], "date_chnm_plate string")
    assert rows(assay.plate_parts(df), "date", "chnm", "plate") == [
        ("20130320", "a_b", 10.0), ("20130320", "x", 2.0), (None, None, None)]


def test_direction_table_lowest_plate_is_numeric(spark):
    df = spark.createDataFrame([("Estradiol", 1, 0), ("Progesterone", -1, 1)],
                               "steroid string, d1_x_Plate10 int, d1_x_Plate2 int")
    got = rows(assay.direction_table(df, df.columns[1:]), "date_chnm_plate", "steroid", "direction")
    assert got == [("d1_x_Plate2", "Estradiol", 0), ("d1_x_Plate2", "Progesterone", 1)]


def test_unpack_hits(spark):
    df = spark.createDataFrame([("p", "x", "1", "c(0, 1)", "c(NA, 1, 1, 1, 1, 1)")],
                               "date_chnm_plate string, chnm string, casn string, a string, b string")
    out = assay.unpack_hits(df, ["date_chnm_plate", "chnm", "casn"], ["a", "b"])
    assert out.count() == 12
    assert rows(out.where("steroid = 'a' and hit is not null"), "dose_level", "hit", "hits") == [
        (1, 0.0, "c(0, 1)"), (2, 1.0, "c(0, 1)")]


def test_dose_levels_with_tie_and_null(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 5.0), ("p", 5.0), ("p", None), ("q", 3.0)], "id string, conc double")
    assert rows(assay.dose_levels(df, ["id"])) == [
        ("p", 1.0, 1.0), ("p", 5.0, 2.5), ("p", 5.0, 2.5), ("p", None, None), ("q", 3.0, 1.0)]


def test_tidy_wells(spark):
    df = spark.createDataFrame([("02Jul2014.x.3", "ND"), ("04112017.x.2", "5"), ("junk", None)],
                               "apid string, ceetox_raw string")
    assert rows(assay.tidy_wells(df), "date", "plate", "flag") == [
        (None, None, 0), (datetime.date(2011, 4, 11), 2.0, 0), (datetime.date(2014, 7, 2), 3.0, 1)]


def test_replicates_and_fold_change(spark):
    wells = spark.createDataFrame(
        [("E", 1, 1.0, 0), ("E", 1, 3.0, 1), ("E", 2, 1.0, 0), ("E", 2, None, 0), ("P", 1, 5.0, 0), ("Q", 1, 1.0, 0)],
        "steroid string, conc int, uM double, flag int")
    means = assay.collapse_replicates(wells, ["steroid", "conc"], "uM", "flag", "uM_bar", "flag_bar")
    assert rows(means) == [("E", 1, 2.0, 1), ("E", 2, None, 0), ("P", 1, 5.0, 0), ("Q", 1, 1.0, 0)]
    controls = spark.createDataFrame([("E", 1.5), ("P", 0.0)], "steroid string, control_bar double")
    got = rows(assay.fold_change(means, controls, ["steroid"]), "steroid", "conc", "foldchange")
    # a zero control gives an infinite ratio, which has no fraction to round
    assert got == [("E", 1, 1.33), ("E", 2, None), ("P", 1, None), ("Q", 1, None)]


def test_signed_hits(spark):
    df = spark.createDataFrame([(1.0, 1), (1.004, 1), (0.5, 1), (2.0, 0), (None, 1), (2.0, None)], "foldchange double, hit int")
    assert [r["hitd"] for r in assay.signed_hits(df).collect()] == [0, 1, -1, 0, None, None]


def test_tested_range(spark):
    df = spark.createDataFrame([("p", 0.1, 1.0), ("p", 9.0, 3.0), ("p", 4.0, 2.0), ("p", None, None)],
                               "id string, conc double, dose_level double")
    assert rows(assay.tested_range(df, ["id"])) == [("p", 9.0, 0.1)]


def test_responders(spark):
    effects = spark.createDataFrame([("p", "x", "E", 1.0, 2.0, "c(1)"), ("p", "x", "T", 9.0, 9.0, "c(2)"),
                                     ("q", "y", "P", 3.0, 4.0, "c(3)")],
                                    "plate string, chnm string, steroid string, LEC double, MFC double, hits string")
    ways = spark.createDataFrame([("x", "E", 1), ("x", "P", -1), ("x", "T", 1), ("y", "P", 1), ("z", "E", -1)],
                                 "chnm string, steroid string, direction int")
    got = assay.responders(effects, ways, ["plate", "chnm"], "chnm", ["E", "P"])
    assert rows(got, "chnm", "LEC_E", "LEC_P", "MFC_E", "hits_P", "E", "P") == [
        ("x", 1.0, None, 2.0, None, 1, -1), ("y", None, 3.0, None, "c(3)", None, 1)]


def test_attach_matrix_and_distance(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "casn string")
    matrix = spark.createDataFrame([("C1", 33.005, 0.0, 1.0), ("C2", 1000000.0, None, 1.0)],
                                   "code string, up double, down double, other double")
    codes = spark.createDataFrame([("C1", "1"), ("C2", "2")], "code string, casn string")
    got = assay.attach_matrix(df, matrix, codes, {"up": "AC50_E", "down": "AC50_P"})
    assert rows(got, "casn", "AC50_E", "AC50_E_text", "AC50_P_text") == [
        ("1", 33.01 if "%.2f" % 33.005 == "33.01" else 33.0, "%.2f" % 33.005, "0.00"),
        ("2", 1000000.0, "1000000.00", None), ("3", None, None, None)]
    distances = spark.createDataFrame([("1", 0.004), ("2", 1.239)], "casn string, d double")
    assert rows(assay.attach_distance(df, distances, ["casn"], "d"), "casn", "d", "d_text") == [
        ("1", 0.0, "0.00"), ("2", 1.24, "1.24"), ("3", None, None)]


def test_attach_prediction(spark):
    df = spark.createDataFrame([("1", "A x"), ("2", "PharmaGSID48509"), ("3", "Terbutylazine"), ("4", "none")],
                               "casn string, chnm string")
    table = spark.createDataFrame(
        [("1", '"A x"', 0.0123, 0.12345), ("2", "PharmaGSID_48509", 0.00001, None), ("3", "Terbuthylazine", 1.0, 2.567)],
        "CAS string, Substance_Name string, seem3 double, u double")
    table = table.withColumn("chnm", assay.clean_names(F.col("Substance_Name")))
    got = assay.attach_prediction(df, table, {"casn": "CAS", "chnm": "chnm"}, upper="u")
    assert rows(got, "casn", "seem") == [("1", "0.12 (u)"), ("2", "0.00001 (m)"), ("3", "2.57 (u)"), ("4", None)]


def test_matrix_with_calls_and_labels(spark):
    values = spark.createDataFrame([("C1", 1.0, 0.0), ("C2", None, 2.0)],
                                   "code string, CEETOX_H295R_ESTRADIOL_up double, CEETOX_H295R_PROG_up double")
    calls = spark.createDataFrame([("C1", 1, 0), ("C2", None, -1)],
                                  "code string, CEETOX_H295R_ESTRADIOL_up int, CEETOX_H295R_PROG_up int")
    codes = spark.createDataFrame([("C1", "1"), ("C2", "2")], "code string, casn string")
    out = assay.matrix_with_calls(values, calls, codes)
    out = out.select("casn", "hormone", assay.active_value(F.col("AC10"), F.col("hitcall")).alias("v"),
                     assay.active_label(F.col("AC10"), F.col("hitcall")).alias("l"))
    assert rows(out) == [("1", "Estradiol", 1.0, "10"), ("1", "Progesterone", None, "1 (not active)"),
                         ("2", "Estradiol", None, None), ("2", "Progesterone", None, None)]


def test_bioactivity(spark):
    df = spark.createDataFrame([("a", 0.1, 0.05), ("b", 0.01, None), ("c", 0.0, 0.001)], "k string, g double, n double")
    assert rows(assay.label_areas(df, "k", "g", "n", "top")) == [
        ("a", "0.1 (active)", "0.05 (ambiguous)", "0.1 (active)"), ("b", "0.01 (ambiguous)", None, None),
        ("c", "0", "0.001", "0.001")]


def test_consecutive_rule_over_many_doses(spark):
    """Series that cross the borders of blocks, with gaps, against the rule in plain Python."""
    pick = random.Random(3)
    series = {f"k{i}": {d: pick.choice([0, 1, 1, -1, None]) for d in range(1, 41) if pick.random() < 0.8} for i in range(60)}
    data = [(k, float(d), h, float(d), 1.0 + d) for k, s in series.items() for d, h in s.items()]
    data += [("k0", None, 1, 1.0, 1.0), ("k1", 2.5, 1, 1.0, 1.0), ("only", None, 1, 3.0, 4.0)]
    df = spark.createDataFrame(data, "id string, dose_level double, hitd int, conc double, foldchange double")
    want = {(k, d): h == 1 and (s.get(d - 1) == 1 or s.get(d + 1) == 1 or (d > 1 and s.get(d + 1) is None))
            for k, s in series.items() for d, h in s.items()}
    found = {(r["id"], r["dose_level"]): r["counts"] for r in assay.consecutive_hits(df, ["id"]).collect()}
    assert found == want
    lowest = {k: min([float(d) for d in s if want[k, d]], default=float("inf")) for k, s in series.items()} | {"only": float("inf")}
    assert {r["id"]: r["LEC"] for r in assay.lec_mfc(df, ["id"]).collect()} == lowest
