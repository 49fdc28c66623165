"""Group summaries. Every one is reduced inside the map tasks first, so a hot group costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen.operators.reshape import named, quoted


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return count_by(df, keys).where("n > 1")


def distinct_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of some columns; what 'first row per group' means when only these are read later."""
    return df.select(*[named(c) for c in columns]).distinct()


def collapse_distinct(df: DataFrame, keys: list[str], value: str, out: str, sep: str = ", ", shown=None) -> DataFrame:
    """Sorted distinct texts of a group in one cell.

    Repeats are removed by a first aggregation on key and value, so only distinct texts reach the group's task.
    ``shown`` changes the remaining texts, for instance their case, before they are joined.
    """
    single = distinct_by(df, keys + [value])
    text = quoted(value) if shown is None else shown(quoted(value))
    return single.groupBy(*[named(k) for k in keys]).agg(
        F.array_join(F.array_sort(F.collect_set(text)), sep).alias(out)
    )


def collapse_all(df: DataFrame, keys: list[str], value: str, out: str, sep: str = ", ") -> DataFrame:
    """Sorted texts of a group in one cell, repeats kept.

    What is shuffled is each text with its count; the repeats are written out again inside the result cell.
    """
    tally = count_by(df.where(quoted(value).isNotNull()), keys + [value], "__n")
    entries = F.array_sort(F.collect_list(F.struct(quoted(value).alias("v"), F.col("__n").alias("n"))))
    repeated = F.flatten(F.transform(entries, lambda e: F.array_repeat(e["v"], e["n"].cast("int"))))
    return tally.groupBy(*[named(k) for k in keys]).agg(F.array_join(repeated, sep).alias(out))


def has_any(test: Column) -> Column:
    """True if a row of the group meets the condition; NULL conditions count as false."""
    return F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False))
