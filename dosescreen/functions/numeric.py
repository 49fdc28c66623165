"""Number expressions. All are plain Column expressions that stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signif_frac(x: Column | str, digits: int = 2) -> Column:
    """Keep the whole part of ``x`` and round its fraction to ``digits`` significant digits.

    Ties go to the even digit. An infinite ``x`` has no fraction and gives NULL.
    """
    x = col(x)
    whole = F.floor(x).cast("double")
    frac = x - whole
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(frac)).cast("double"))
    return (
        F.when(F.abs(x) == INF, F.lit(None).cast("double"))
        .when(frac == 0, whole)
        .otherwise(whole + F.rint(frac * scale) / scale)
    )


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` where a zero denominator gives a signed infinity, and 0/0 gives NULL."""
    num, den = col(num), col(den)
    return (
        F.when((den == 0) & (num == 0), F.lit(None).cast("double"))
        .when(den == 0, F.signum(num) * F.lit(INF))
        .otherwise(F.try_divide(num, den))
    )


def log10(x: Column | str) -> Column:
    """Base-10 logarithm with log10(0) = -Infinity; negative input gives NULL."""
    x = col(x)
    return F.when(x == 0, F.lit(-INF)).when(x == INF, F.lit(INF)).when(x > 0, F.log10(x))


def row_max_strict(*cols: Column | str) -> Column:
    """Largest value in the row, NULL as soon as one value is NULL."""
    cols = [col(c) for c in cols]
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(complete, F.greatest(*cols) if len(cols) > 1 else cols[0])


def to_number(text: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return col(text).try_cast("double")


def parse_number(text: Column | str) -> Column:
    """First number inside a text, thousands separators removed: ``"1,234.5 (u)"`` gives 1234.5."""
    found = F.regexp_extract(col(text), r"(-?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")


def number_text(x: Column | str) -> Column:
    """Shortest text of a double without exponent and without a trailing ``.0``; no digit is lost at any magnitude."""
    plain = col(x).cast("string")

    def part(i: int) -> Column:
        return F.regexp_extract(plain, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i)

    decimals = F.regexp_replace(part(3), "^0$", "")
    shift = part(4).try_cast("int")
    digits = F.concat(part(2), decimals)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift - 1), digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), shift - F.length(decimals)))
    split = F.concat(F.substr(digits, F.lit(1), shift + 1), F.lit("."), F.substr(digits, shift + 2))
    expanded = F.when(shift < 0, small).when(shift >= F.length(decimals), whole).otherwise(split)
    return (
        F.when(F.contains(plain, F.lit("E")), F.concat(part(1), expanded))
        .when(plain.endswith(".0"), plain.substr(F.lit(1), F.length(plain) - 2)).otherwise(plain)
    )


def round_decimals(x: Column | str, digits: int = 2) -> Column:
    """Round the exact binary value of ``x`` to ``digits`` decimals, true ties to even.

    ``x * 10^digits`` is itself rounded, so values next to a tie could go the wrong way. The product's rounding error is
    recovered by splitting ``x`` into two halves of 26 bits, and settles those cases. Where neighbouring doubles are
    farther apart than 10^-digits, the double next to the rounded value is ``x`` itself.
    """
    x = col(x)
    double_scale = F.lit(2.0 * 10 ** digits)
    product = x * double_scale
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * double_scale - product) + (x - high) * double_scale
    nearest = F.rint(product / 2)
    gap = product - nearest * 2
    settled = (
        F.when((gap == 1) & (error > 0), nearest + 1).when((gap == -1) & (error < 0), nearest - 1).otherwise(nearest)
    )
    coarse = 2.0 ** math.ceil(52 - digits * math.log2(10))
    return F.when(F.abs(x) < coarse, settled / F.lit(10.0 ** digits)).otherwise(x)


def fixed_decimals(x: Column | str, digits: int = 2) -> Column:
    """Text with a fixed number of decimals; NULL stays NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", round_decimals(x, digits)))


def exact_total(x: Column | str, scale: int) -> Column:
    """Group sum of numbers with ``scale`` decimals that does not depend on the order of partial sums.

    Values are summed as whole multiples of 10^-scale, split into a high and a low part so that neither sum overflows
    even for a group of 10^12 rows.
    """
    units = F.rint(col(x) * F.lit(10.0 ** scale)).cast("bigint")
    high = F.sum(F.shiftright(units, 20)).cast("double")
    low = F.sum(units.bitwiseAND(F.lit((1 << 20) - 1))).cast("double")
    return (high * F.lit(float(1 << 20)) + low) / F.lit(10.0 ** scale)


def mean_strict(x: Column | str, scale: int | None = None) -> Column:
    """Group mean that is NULL as soon as one value in the group is NULL.

    With ``scale`` the sum is exact for values with that many decimals (see :func:`exact_total`).
    """
    x = col(x)
    total = F.sum(x) if scale is None else exact_total(x, scale)
    return F.when(F.count(F.lit(1)) == F.count(x), total / F.count(x))


def max_strict(x: Column | str) -> Column:
    """Group maximum that is NULL as soon as one value in the group is NULL."""
    x = col(x)
    return F.when(F.count_if(x.isNull()) == 0, F.max(x))
