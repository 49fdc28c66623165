import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosescreen.operators import statistics
from tests.conftest import rows


def t_tail(t, df):
    """Two-sided tail by numeric integration of the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    low = math.atan(t / math.sqrt(df))
    high = min(math.pi / 2, low + 14 / math.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(400)
    theta = (high - low) / 2 * nodes + (high + low) / 2
    return 2 * float((weights * c * math.sqrt(df) * np.cos(theta) ** (df - 1)).sum() * (high - low) / 2)


def test_t_tail(spark):
    cases = [(t, n) for t in (0.0, 0.3, 1.7, 4.0) for n in (1, 2, 3, 4, 9, 10, 271, 5000, 9999, 10000, 10001, 50000)]
    df = spark.createDataFrame(cases, "t double, n int")
    for r in df.select("t", "n", statistics.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["p"] == pytest.approx(t_tail(r["t"], r["n"]), rel=1e-9), (r["t"], r["n"])


def beta_series(t, n):
    """The same tail by the incomplete beta function's series of positive terms, in 50 digits; for t*t near n or above."""
    with decimal.localcontext() as context:
        context.prec = 50
        a, root_pi = decimal.Decimal(n) / 2, decimal.Decimal("1.7724538509055160272981674833411451827975494561224")
        ratio, k = (root_pi / 2, decimal.Decimal(1)) if n % 2 == 0 else (1 / root_pi, decimal.Decimal("0.5"))
        while k < a:
            ratio, k = ratio * (k + decimal.Decimal("0.5")) / k, k + 1
        x = n / (n + decimal.Decimal(t) ** 2)
        term, total = decimal.Decimal(1), decimal.Decimal(0)
        for j in range(20000):
            total += term / (a + j)
            term *= (j + decimal.Decimal("0.5")) / (j + 1) * x
        return float((x.ln() * a).exp() * ratio / root_pi * total)


def test_t_tail_extremes(spark):
    cases = [(12.0, 180), (20.0, 300), (9.0, 180), (60.0, 300), (36.0, 20000), (200.0, 1), (1.5, 2), (1e6, 3)]
    df = spark.createDataFrame(cases + [(float("inf"), 5), (60.0, 20000)], "t double, n int")
    got = [r[0] for r in df.select(statistics.t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert got[-2:] == [0.0, 0.0]
    for (t, n), p in zip(cases, got):
        assert p == pytest.approx(beta_series(t, n), rel=1e-11), (t, n)


def test_t_quantile(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (200,), (201,), (10000,), (10 ** 9,)], "n int")
    got = [r[0] for r in df.select(statistics.t_quantile(F.col("n"), 0.95)).collect()]
    want = [12.7062047362, 4.3026527297, 2.2281388520, 1.9718962236, 1.9718365, 1.9602012, 1.9599639869]
    assert got == pytest.approx(want, abs=1e-7)
    for level in (0.2, 0.9999):
        back = df.select(statistics.t_two_sided(statistics.t_quantile(F.col("n"), level), F.col("n"))).collect()
        assert [r[0] for r in back] == pytest.approx([1 - level] * 7, rel=1e-11)


def test_pearson(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = 0.3 * x + rng.normal(size=300)
    data = [("n", float(a), float(b)) for a, b in zip(x, y)]
    data += [("n", math.inf, 1.0), ("n", None, 1.0), ("n", 1.0, float("nan"))]
    data += [("two", 1.0, 1.0), ("two", 2.0, 3.0)] + [("flat", 1.0, float(i)) for i in range(5)]
    data += [("line", float(i), 2.0 * i) for i in range(6)] + [("three", 1.0, 1.0), ("three", 2.0, 3.0), ("three", 3.0, 2.0)]
    got = {r["g"]: r for r in statistics.pearson_test(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y").collect()}
    r = np.corrcoef(x, y)[0, 1]
    t = r * math.sqrt(298 / (1 - r * r))
    n = got["n"]
    assert (n["n"], n["df"]) == (300, 298)
    assert n["r"] == pytest.approx(r, abs=1e-12) and n["t"] == pytest.approx(t, abs=1e-9)
    assert n["p_value"] == pytest.approx(t_tail(abs(t), 298), abs=1e-10)
    half = 1.959963984540054 / math.sqrt(297)
    assert n["ci_low"] == pytest.approx(math.tanh(math.atanh(r) - half), abs=1e-12)
    assert n["ci_high"] == pytest.approx(math.tanh(math.atanh(r) + half), abs=1e-12)
    assert got["two"]["r"] is None and got["two"]["p_value"] is None and got["flat"]["r"] is None
    assert got["line"]["r"] == 1.0 and got["line"]["p_value"] == 0.0 and got["line"]["ci_low"] == 1.0
    assert got["three"]["p_value"] == pytest.approx(t_tail(got["three"]["t"], 1), abs=1e-10)
    assert got["three"]["ci_low"] is None


def test_regression(spark):
    data = [("g", 1.0, 2.1), ("g", 2.0, 3.9), ("g", 3.0, 6.2), ("g", 4.0, 7.8), ("h", 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    x, y = np.array([1, 2, 3, 4.0]), np.array([2.1, 3.9, 6.2, 7.8])
    slope, intercept = np.polyfit(x, y, 1)
    line = {r["g"]: r for r in statistics.regression_line(df, ["g"], "x", "y").collect()}
    assert line["g"]["slope"] == pytest.approx(slope) and line["g"]["intercept"] == pytest.approx(intercept)
    s = math.sqrt(((y - slope * x - intercept) ** 2).sum() / 2)
    assert line["g"]["residual_error"] == pytest.approx(s) and line["h"]["slope"] is None
    band = rows(statistics.regression_band(df, ["g"], "x", "y", points=4))
    assert len(band) == 4
    half = 4.302652730 * s * math.sqrt(0.25 + (1 - 2.5) ** 2 / 5)
    assert band[0][2:] == pytest.approx((1.0, slope + intercept, slope + intercept - half, slope + intercept + half))
