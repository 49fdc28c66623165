"""Correlation tests and regression lines of three measures against the quantity, per return flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.operators import statistics
from dosescreen.operators.reshape import unpivot
from workload.registry import query, table

MEASURES = ["l_extendedprice", "l_discount", "l_tax"]


def long(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", *MEASURES)
    return unpivot(rows, ["l_returnflag", "l_quantity"], MEASURES, "measure", "value")


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag, l_quantity AS x, '{m}' AS measure, {m} AS y FROM lineitem" for m in MEASURES) + ")"
# exact finite sum for the tail of Student's distribution, its terms through the gamma function
PEARSON = f"""WITH {LONG}, g AS (
  SELECT l_returnflag, measure, count(*) AS n, corr(y, x) AS r FROM long GROUP BY 1, 2),
t AS (SELECT *, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM g),
a AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM t),
s AS (SELECT l_returnflag, measure, sum(CASE WHEN df % 2 = 0
      THEN exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5) + 2.0 * k * ln(cos(th)))
      ELSE exp(lgamma(k + 1.0) - lgamma(k + 1.5) + lgamma(1.5) + (2.0 * k + 1) * ln(cos(th))) END) AS series
  FROM (SELECT *, unnest(range(0, CAST(floor((df - CASE WHEN df % 2 = 0 THEN 2 ELSE 3 END) / 2) AS BIGINT) + 1)) AS k FROM a)
  GROUP BY 1, 2)
SELECT a.l_returnflag, a.measure, n, round(r, 9) AS r, round(t, 6) AS t, df,
  round(CASE WHEN df % 2 = 0 THEN 1 - sin(th) * series ELSE 1 - 2 / pi() * (th + sin(th) * series) END, 6) AS p_value,
  round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 9) AS ci_low,
  round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 9) AS ci_high
FROM a JOIN s ON a.l_returnflag = s.l_returnflag AND a.measure = s.measure"""
LINES = LONG + """, f AS (SELECT l_returnflag, measure, count(*) AS n, avg(x) AS mx, avg(y) AS my, min(x) AS x0,
  max(x) AS x1, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx,
  regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM long GROUP BY 1, 2),
lines AS (SELECT *, sqrt((syy - slope * sxy) / (n - 2)) AS se FROM f)"""


@query("pearson_test", PEARSON)
def pearson_test(spark, folder):
    out = statistics.pearson_test(long(spark, folder), ["l_returnflag", "measure"], "l_quantity", "value")
    return rounded(out, 9).withColumns({"t": F.round("t", 6), "p_value": F.round("p_value", 6)})


# tail of Student's distribution as the incomplete beta function's series of positive terms
STRONG = """WITH g AS (
  SELECT l_partkey, count(*) AS n, corr(l_extendedprice * (1 - l_discount), l_quantity) AS r FROM lineitem GROUP BY 1
  HAVING count(*) >= 3),
s AS (SELECT l_partkey, n, r, (n - 2) / 2.0 AS a, 1 - r * r AS x, r * r AS y FROM g),
t AS (SELECT l_partkey, sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + k * ln(x)) / (a + k)) AS series
  FROM (SELECT *, unnest(range(0, 200)) AS k FROM s WHERE abs(r) >= 0.5) GROUP BY 1),
u AS (SELECT l_partkey, sum(exp(lgamma(a + 0.5 + k) - lgamma(a + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(y))) AS series
  FROM (SELECT *, unnest(range(0, 200)) AS k FROM s WHERE abs(r) < 0.5 AND r <> 0) GROUP BY 1)
SELECT l_partkey, n, round(r, 9) AS r, round(CASE WHEN abs(r) >= 0.5
  THEN (a * ln(x) + lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + ln(t.series)) / ln(10)
  WHEN r <> 0 THEN log10(1 - exp(0.5 * ln(y) + a * ln(x) + lgamma(a + 0.5) - lgamma(a) - lgamma(1.5)) * u.series)
  ELSE 0 END, 6) AS log10_p FROM s LEFT JOIN t USING (l_partkey) LEFT JOIN u USING (l_partkey)"""


@query("pearson_strong", STRONG)
def pearson_strong(spark, folder):
    """How the net price of each part goes with the quantity, and how surely: p values of many magnitudes.

    The SQL sums one series for strong correlations and another one for weak ones.
    """
    rows = table(spark, folder, "lineitem").select(
        "l_partkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    )
    out = statistics.pearson_test(rows, ["l_partkey"], "l_quantity", "net")
    return out.select("l_partkey", "n", F.round("r", 9).alias("r"), F.round(F.log10("p_value"), 6).alias("log10_p"))


@query("regression_line", f"""WITH {LINES} SELECT l_returnflag, measure, n, round(slope, 9) AS slope,
  round(intercept, 6) AS intercept, round(se, 6) AS residual_error, round(se / sqrt(sxx), 9) AS slope_error FROM lines""")
def regression_line(spark, folder):
    out = statistics.regression_line(long(spark, folder), ["l_returnflag", "measure"], "l_quantity", "value")
    return out.select(
        "l_returnflag", "measure", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"),
        F.round("residual_error", 6).alias("residual_error"), F.round("slope_error", 9).alias("slope_error"),
    )


Z = 1.959963984540054
# quantile of Student's distribution as a series in 1/df
QUANTILE = (f"({Z} + {(Z**3 + Z) / 4} / (n - 2) + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / pow(n - 2, 2)"
            f" + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / pow(n - 2, 3))")


@query("regression_band", f"""WITH {LINES}, grid AS (SELECT *, x0 + p * (x1 - x0) / 79 AS x
  FROM lines CROSS JOIN range(0, 80) t(p)),
w AS (SELECT *, intercept + slope * x AS fit, {QUANTILE} * se * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx) AS half FROM grid)
SELECT l_returnflag, measure, CAST(p AS INTEGER) AS point, round(x, 6) AS x, round(fit, 6) AS fit,
  round(fit - half, 6) AS low, round(fit + half, 6) AS high FROM w""")
def regression_band(spark, folder):
    return rounded(
        statistics.regression_band(long(spark, folder), ["l_returnflag", "measure"], "l_quantity", "value"), 6
    )
