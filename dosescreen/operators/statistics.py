"""Grouped correlation test and regression line with its confidence band.

One aggregation yields the moments of every group; all that follows is arithmetic on one row per group. Values are
shifted by the group's mean before squares are summed (that is how Spark merges its moment aggregates), so the result
does not suffer from cancellation.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen.functions.numeric import INF
from dosescreen.operators.reshape import quoted

#: Gauss-Legendre nodes of each part of an integral, and the parts of the tail's integral.
NODES = 24
PARTS = ((0.0, 1.5), (1.5, 3.5), (3.5, 9.5))
#: Series of gamma(a + 1/2) / gamma(a) / sqrt(a) in 1/a.
GAMMA_RATIO = (1, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
#: The series is used from here on; smaller arguments get there by so many steps of the recurrence.
GAMMA_SHIFT = 30
#: Newton steps of a quantile; each doubles the right digits, and a normal quantile is the start.
QUANTILE_STEPS = 12


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def _nodes(parts: tuple[tuple[float, float], ...]) -> Column:
    """Nodes ``v`` and weights ``w`` of all parts as a constant array."""
    places, weights = np.polynomial.legendre.leggauss(NODES)
    return F.array(*[
        F.struct(F.lit(float((b - a) / 2 * x + (a + b) / 2)).alias("v"), F.lit(float((b - a) / 2 * w)).alias("w"))
        for a, b in parts for x, w in zip(places, weights)
    ])


def _t_scale(n: Column) -> Column:
    """Height of Student's density at 0: gamma((n + 1) / 2) / gamma(n / 2) / sqrt(n pi)."""
    a = n / 2
    steps = F.sequence(F.lit(0), F.lit(GAMMA_SHIFT - 1))
    below = F.aggregate(steps, F.lit(1.0), lambda total, j: total * (a + j) / (a + j + 0.5))
    series = F.lit(0.0)
    for c in reversed(GAMMA_RATIO):
        series = series / (a + GAMMA_SHIFT) + c
    return below * series * F.sqrt((a + GAMMA_SHIFT) / (n * math.pi))


def _t_density(t: Column, n: Column, scale: Column) -> Column:
    return scale * F.exp(-(n + 1) / 2 * F.log1p(t * t / n))


def _t_tail(t: Column, n: Column, scale: Column) -> Column:
    """P(|T| > t) for t >= 0.

    Beyond 1 the tail is integrated over v with (n + u^2) / (n + t^2) = exp(2 v^2 / (n + 1)), u being the place under
    the tail: the density at t goes before the integral and a smooth, decaying function is left, so that the relative
    error stays near 1e-13 however small the tail is. Up to 1 the middle is integrated.
    """
    def beyond(total: Column, x: Column) -> Column:
        square = x["v"] * x["v"]
        u = F.sqrt(t * t + (n + t * t) * F.expm1(2 * square / (n + 1)))
        return total + x["w"] * 2 * x["v"] * F.exp(-square * (n - 1) / (n + 1)) / u

    def within(total: Column, x: Column) -> Column:
        return total + x["w"] * t * _t_density(x["v"] * t, n, scale)

    far = 2 * _t_density(t, n, scale) * (n + t * t) / (n + 1) * F.aggregate(_nodes(PARTS), F.lit(0.0), beyond)
    near = 1 - 2 * F.aggregate(_nodes(((0.0, 1.0),)), F.lit(0.0), within)
    return F.when(t > 1, far).otherwise(near)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|), by one formula for any number of degrees of freedom; 0 only below the smallest double."""
    t, n = F.abs(t), df.cast("double")
    return F.when(t == INF, F.lit(0.0)).otherwise(_t_tail(t, n, _t_scale(n)))


def t_quantile(df: Column, level: float) -> Column:
    """Two-sided t quantile: :func:`t_two_sided` inverted by Newton's method on the logarithms of t and of the tail."""
    n = df.cast("double")
    start = F.struct(F.lit(NormalDist().inv_cdf(0.5 + level / 2)).alias("t"), _t_scale(n).alias("scale"))

    def step(state: Column, _: Column) -> Column:
        t, scale = state["t"], state["scale"]
        tail = _t_tail(t, n, scale)
        slope = -2 * t * _t_density(t, n, scale) / tail
        return F.struct((t * F.exp((math.log(1 - level) - F.log(tail)) / slope)).alias("t"), scale.alias("scale"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(QUANTILE_STEPS)), start, step, lambda state: state["t"])


def moments(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Count, means, centred sums and the range of x over the pairs in which both values are finite numbers."""
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    pairs = df.select(*[quoted(c) for c in by], a.alias("__x"), b.alias("__y"))
    pairs = pairs.where(_finite(F.col("__x")) & _finite(F.col("__y")))
    return pairs.groupBy(*[quoted(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("mean_x"), F.avg("__y").alias("mean_y"),
        F.regr_sxx("__y", "__x").alias("sxx"), F.regr_syy("__y", "__x").alias("syy"),
        F.regr_sxy("__y", "__x").alias("sxy"),
        F.min("__x").alias("min_x"), F.max("__x").alias("max_x"),
    )


def pearson_test(df: DataFrame, by: list[str], x: str, y: str, level: float = 0.95) -> DataFrame:
    """Pearson correlation per group with t, df, two-sided p and the confidence interval by Fisher's z.

    Needs three complete pairs; with fewer, or with a constant column, all statistics are NULL. The interval needs four.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    r = F.least(F.greatest(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")), F.lit(-1.0)), F.lit(1.0))
    usable = (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    base = moments(df, by, x, y).withColumn("r", F.when(usable, r)).withColumn(
        "df", F.when(usable, F.col("n") - 2)
    )
    rest = 1 - F.col("r") * F.col("r")
    t = F.when(rest == 0, F.signum("r") * F.lit(INF)).otherwise(F.col("r") * F.sqrt(F.try_divide(F.col("df"), rest)))
    tested = base.withColumn("t", F.when(F.col("r").isNotNull(), t))
    fisher = F.when(F.abs("r") < 1, F.atanh("r"))
    half = F.when(F.col("n") > 3, F.lit(z) / F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3)))
    return tested.select(
        *[quoted(c) for c in by], "n", "r", "t", "df",
        F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("df"))).alias("p_value"),
        F.coalesce(F.tanh(fisher - half), F.when(F.col("n") > 3, F.col("r"))).alias("ci_low"),
        F.coalesce(F.tanh(fisher + half), F.when(F.col("n") > 3, F.col("r"))).alias("ci_high"),
    )


def regression_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group with its residual standard error."""
    usable = (F.col("n") >= 3) & (F.col("sxx") > 0)
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    base = moments(df, by, x, y).withColumn("slope", F.when(usable, slope))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return base.withColumns({
        "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
        "residual_error": F.when(usable, F.sqrt(F.try_divide(rest, F.col("n") - 2))),
    }).withColumn("slope_error", F.try_divide(F.col("residual_error"), F.sqrt("sxx")))


def regression_band(
    df: DataFrame, by: list[str], x: str, y: str, level: float = 0.95, points: int = 80
) -> DataFrame:
    """Line and confidence limits of the mean response at evenly spaced places over the group's range of x."""
    line = regression_line(df, by, x, y).where(F.col("slope").isNotNull()).withColumn(
        "__t", t_quantile(F.col("n") - 2, level)
    )
    step = (F.col("max_x") - F.col("min_x")) / (points - 1)
    grid = line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("min_x") + F.col("point") * step
    )
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    distance = F.col("x") - F.col("mean_x")
    width = F.col("__t") * F.col("residual_error") * F.sqrt(1 / F.col("n") + distance * distance / F.col("sxx"))
    return grid.select(
        *[quoted(c) for c in by], "point", "x", fit.alias("fit"), (fit - width).alias("low"), (fit + width).alias("high")
    )
