import datetime
import math
import random

from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.functions import text as txt
from dosescreen.functions.rules import Rule, append_match, class_of, first_match
from tests.conftest import rows


def reference_signif(x):
    whole = math.floor(x)
    f = x - whole
    if f == 0:
        return float(whole)
    k = 10.0 ** (1 - math.floor(math.log10(f)))
    return whole + round(f * k) / k


def test_signif_frac_edges(values):
    got = values([0.994, 0.996, 1.0, 1.004, 1.125, 12.3456, 0.0, math.inf, None], "double", num.signif_frac)
    assert got == [0.99, 1.0, 1.0, 1.004, 1.12, 12.35, 0.0, None, None]


def test_signif_frac_random(values):
    rng = random.Random(1)
    inputs = [rng.uniform(0, 50) for _ in range(500)] + [rng.uniform(0, 1e-4) for _ in range(200)]
    assert values(inputs, "double", num.signif_frac) == [reference_signif(x) for x in inputs]


def test_ratio(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None)], "a double, b double"
    )
    got = [r[0] for r in df.select(num.ratio("a", "b")).collect()]
    assert got == [0.5, math.inf, -math.inf, None, None, None]


def test_log10(values):
    assert values([100.0, 0.0, math.inf, -1.0, None], "double", num.log10) == [2.0, -math.inf, math.inf, None, None]


def test_row_extremes(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(num.row_max_strict("a", "b"), num.row_max_strict("a", "c")).collect()
    assert [tuple(r) for r in got] == [(None, 3.0), (None, None)]


def test_parse_number(values):
    got = values(["0.012 (u)", "12.3 (m)", "1,234.5 x", "a", None, "-2e-3"], "string", num.parse_number)
    assert got == [0.012, 12.3, 1234.5, None, None, -0.002]


def test_number_text(values):
    inputs = [1.0, 0.00001, 12.34, 1e6, 1234567.5, 1e15, 0.0, -0.5, None, 5e-4]
    assert values(inputs, "double", num.number_text) == [
        "1", "0.00001", "12.34", "1000000", "1234567.5", "1000000000000000", "0", "-0.5", None, "0.0005",
    ]
    extremes = [1.25e-18, -1.2345678901234568e-10, 2.5e20, -1e22, 123456789.125, 1.7976931348623157e308, 5e-324]
    assert [float(x) for x in values(extremes, "double", num.number_text)] == extremes
    assert values([1.25e-18, 2.5e20, -1e22], "double", num.number_text) == [
        "0.00000000000000000125", "250000000000000000000", "-10000000000000000000000"]


def test_round_decimals_at_any_magnitude(values):
    inputs = [1e12 + 0.126, 5e13 + 0.37, -4e13 - 0.015625, 2.0 ** 46 + 0.015625, 1e15 + 0.125, 1e300]
    assert values(inputs, "double", num.round_decimals) == [round(x, 2) for x in inputs]


def test_fixed_decimals_like_printf(values):
    rng = random.Random(2)
    inputs = [0.125, 1.005, 2.675, 33.005, -0.001, 0.004, 1000000.0, -1.115, 0.375]
    inputs += [round(rng.uniform(-1000, 1000), 3) for _ in range(3000)]
    inputs += [(2 * rng.randrange(10 ** 6) + 1) / 200 for _ in range(3000)]
    assert values(inputs, "double", num.fixed_decimals) == ["%.2f" % x for x in inputs]


def test_mean_strict(spark):
    df = spark.createDataFrame([("a", 1.01), ("a", 2.02), ("b", 1.0), ("b", None)], "k string, x double")
    got = rows(df.groupBy("k").agg(num.mean_strict("x").alias("m"), num.mean_strict("x", 2).alias("e")))
    assert got == [("a", (1.01 + 2.02) / 2, 1.515), ("b", None, None)]


def test_exact_total_negative_and_large(spark):
    df = spark.createDataFrame([(-1.25,), (9e13,), (0.01,)], "x double")
    assert df.agg(num.exact_total("x", 2)).first()[0] == 89999999999998.76


def test_null_safe_text_tests(spark):
    df = spark.createDataFrame([("abc",), (None,)], "x string")
    got = df.select(txt.matches("x", "b"), txt.not_matches("x", "b"), txt.in_values("x", ["abc"]), txt.null_or("x", "q"))
    assert [tuple(r) for r in got.collect()] == [(True, False, True, False), (False, True, False, True)]


def test_title_case(values):
    inputs = ["pest. ,cons.", "drinking_water", "all-purpose CLEANER", "child's toy", "éclair", None, " "]
    assert values(inputs, "string", txt.title_case) == [
        "Pest. ,Cons.", "Drinking_water", "All-Purpose Cleaner", "Child's Toy", "Éclair", None, " ",
    ]


def test_dates(values):
    got = values(["02Jul2014", "04112017", "20130320", "garbage", None], "string",
                 lambda c: txt.day_month_year(c, fixed.DATE_CORRECTIONS))
    assert got == [datetime.date(2014, 7, 2), datetime.date(2011, 4, 11), datetime.date(2013, 3, 20), None, None]


def test_guard_and_recode(values):
    assert values(["'50-00-0"], "string", txt.strip_guard) == ["50-00-0"]
    assert values(["50-00-0"], "string", txt.add_guard) == ["'50-00-0"]
    assert values(["Bisphenol A", "C.I. Dichlorophenol", "CxI. Q", None], "string",
                  lambda c: txt.abbreviate(txt.recode(c, fixed.SYNONYMS), fixed.ABBREVIATIONS)) == [
        "BPA", "DCP", "Q", None]  # the dots of the pattern stand for any character
    assert len(fixed.SYNONYMS) == 46 and len(fixed.HORMONE_IDS) == 14
    assert [len(v) for v in fixed.CANCER_CALLS.values()] == [23, 2, 8]


def test_rules_first_match_and_exception(spark):
    rules = [Rule("x", "a", "A"), Rule("x", "b", "A"), Rule("x", "c", "C", "y", "no"), Rule("x", "c|d", "D")]
    df = spark.createDataFrame([("ab", None), ("b", None), ("c", "no"), ("c", None), ("z", None), (None, None)],
                               "x string, y string")
    got = [r[0] for r in df.select(first_match(rules, F.lit("-"))).collect()]
    assert got == ["A", "A", "D", "C", "-", "-"]


def test_append_match(spark):
    df = spark.createDataFrame([("hair_dye|fragrance", "pers."), ("fragrance", "fragrance"), ("none", "x")],
                               "p string, l string")
    got = [r[0] for r in df.select(append_match(fixed.USE_APPENDS, F.col("p"), F.col("l"))).collect()]
    assert got == ["pers., hair_dye", "fragrance", "x"]


def test_class_of(values):
    assert values(["Likely Human Carcinogen", "Not Yet  Determined", "?", None], "string",
                  lambda c: class_of(F.col(c), fixed.CANCER_CALLS)) == ["Likely", "Inadequate evidence", None, None]
