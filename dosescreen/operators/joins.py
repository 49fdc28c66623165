"""Equi-joins with explicit keys, membership tests and key checks.

No join carries a broadcast hint: Spark broadcasts a side whose measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, with adaptive splitting of hot keys.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.operators.reshape import named, quoted

if TYPE_CHECKING:
    from dosescreen.operators.quality import Audit


def join_on(
    left: DataFrame,
    right: DataFrame,
    on: list[str] | dict[str, str],
    how: str = "left",
    null_keys_match: bool = False,
    suffixes: tuple[str, str] = (".x", ".y"),
) -> DataFrame:
    """Join with keys given as a list or as ``{left name: right name}``.

    The result has the left columns, then the right columns without its keys. Names that both sides use get a suffix.
    With ``null_keys_match`` a NULL key equals a NULL key.
    """
    pairs = on if isinstance(on, dict) else {k: k for k in on}
    right_keys = {r: f"__key_{i}" for i, r in enumerate(pairs.values())}
    left_rest = [c for c in left.columns if c not in pairs]
    right_rest = [c for c in right.columns if c not in right_keys]
    clash = set(left_rest) & set(right_rest)
    a = left.selectExpr(*[named(c, c + suffixes[0] if c in clash else c) for c in left.columns]) if clash else left
    final = {c: c + suffixes[1] if c in clash or c in pairs else c for c in right_rest}
    b = right.selectExpr(
        *[named(r, k) for r, k in right_keys.items()], *[named(c, final[c]) for c in right_rest]
    )
    equal = "<=>" if null_keys_match else "="
    tests = [f"{named(l)} {equal} {right_keys[r]}" for l, r in pairs.items()]
    joined = a.join(b, F.expr(" AND ".join(tests)), how)
    if how == "right":
        # the universe is on the right: keys must come from there
        restored = [named(right_keys[pairs[c]], c) if c in pairs else named(c) for c in a.columns]
        return joined.selectExpr(*restored, *[named(final[c]) for c in right_rest])
    return joined.drop(*right_keys.values())


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """The columns that both sides have, in the left order; they are the keys of a natural join."""
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def key_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_type, right_type, left_nulls, right_nulls) of the keys that a natural join would use."""
    keys = common_columns(left, right)
    spark, types = left.sparkSession, [dict(side.dtypes) for side in (left, right)]
    schema = spark.createDataFrame([(k, types[0][k], types[1][k]) for k in keys], "key string, left_type string, right_type string")
    for name, side in (("left_nulls", left), ("right_nulls", right)):
        if not keys:
            return schema.selectExpr("*", "0L AS left_nulls", "0L AS right_nulls")
        counts = side.agg(F.array(*[F.struct(F.lit(k).alias("key"), F.count_if(quoted(k).isNull()).alias(name)) for k in keys]).alias("__k"))
        schema = schema.join(counts.select(F.inline("__k")), "key")
    return schema


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "left", keys: list[str] | None = None, null_keys_match: bool = True,
    audit: Audit | None = None,
) -> DataFrame:
    """Join on all columns that both sides have.

    ``keys`` states what these are expected to be; another set is an error, as is a key of different types, or none. NULL
    keys match NULL keys by default. Where they must not occur instead, ``audit`` counts them in the pass that writes the
    result, and they are an error then (counts ``natural_left`` and ``natural_right``).
    """
    found = common_columns(left, right)
    if not found:
        raise ValueError("the tables have no column in common")
    if keys is not None and set(keys) != set(found):
        raise ValueError(f"the tables share {found}, not {sorted(keys)}")
    types = [dict(side.dtypes) for side in (left, right)]
    odd = [f"{k} ({types[0][k]}, {types[1][k]})" for k in found if types[0][k] != types[1][k]]
    if odd:
        raise ValueError(f"keys of different types: {', '.join(odd)}")
    if audit and not null_keys_match:
        some = reduce(lambda a, b: a | b, [quoted(k).isNull() for k in found])
        sides = {"natural_left": left, "natural_right": right}
        for name, side in sides.items():
            audit.expect(lambda c, n=name: not c[n]["null_keys"], lambda s=side: s.where(some), f"NULL in the keys {found} ({name})")
        left, right = (audit.watch(side, name, null_keys=F.count_if(some)) for name, side in sides.items())
    return join_on(left, right, found, how, null_keys_match)


def member_of(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value occurs in another table; NULL is never a member."""
    keys = other.selectExpr(named(other_column, "__member"))
    return df.join(keys, quoted(column) == F.col("__member"), "left_semi")


def not_member_of(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value does not occur in another table; rows with a NULL value are kept."""
    keys = other.selectExpr(named(other_column, "__member"))
    return df.join(keys, quoted(column) == F.col("__member"), "left_anti")


def membership_flags(sets: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """One row per key that occurs in any of the sets and one boolean column per set.

    All sets are stacked and reduced in one aggregation, so a later test against many sets costs a single join.
    """
    marked = [
        table.select(quoted(column).alias(key), *[F.lit(n == name).alias(n) for n in sets])
        .where(quoted(key).isNotNull())
        for name, (table, column) in sets.items()
    ]
    stacked = reduce(DataFrame.union, marked)
    return stacked.groupBy(quoted(key)).agg(*[F.max(quoted(n)).alias(n) for n in sets])


def with_membership(df: DataFrame, column: str, sets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Add one never-NULL boolean column per set telling whether ``column`` occurs in it."""
    flags = membership_flags(sets, "__member")
    joined = df.join(flags, quoted(column) == F.col("__member"), "left").drop("__member")
    return joined.withColumns({n: F.coalesce(quoted(n), F.lit(False)) for n in sets})
