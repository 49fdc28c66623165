"""Column selection and wide/long reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen.functions.numeric import to_number


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the contiguous columns from ``first`` to ``last``."""
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.columns[start:stop + 1]


def columns_containing(df: DataFrame, part: str, ignore_case: bool = True) -> list[str]:
    if ignore_case:
        return [c for c in df.columns if part.lower() in c.lower()]
    return [c for c in df.columns if part in c]


def quoted(name: str) -> Column:
    """Column reference for a name that may hold dots or other special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def named(name: str, alias: str | None = None) -> str:
    """The same reference as text, for methods that take names or SQL expressions; cheaper to build than a Column."""
    def tick(text: str) -> str:
        return "`" + text.replace("`", "``") + "`"

    return tick(name) if alias is None or alias == name else f"{tick(name)} AS {tick(alias)}"


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[named(n) for n in names])


def to_front(df: DataFrame, names: list[str]) -> DataFrame:
    return pick(df, names + [c for c in df.columns if c not in names])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; others are ignored."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def on_text_columns(df: DataFrame, change) -> DataFrame:
    """Apply ``change`` to every text column."""
    return df.select(*[change(quoted(n)).alias(n) if t == "string" else quoted(n) for n, t in df.dtypes])


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; rows with a NULL value are kept."""
    return df.unpivot([named(c) for c in ids], [named(c) for c in values], name, value)


def unpivot_groups(
    df: DataFrame, groups: list[str], measures: list[str], group_name: str, sep: str = "_", drop_empty: bool = True
) -> DataFrame:
    """Columns ``<measure><sep><group>`` become one row per group with one column per measure.

    A column that does not exist counts as NULL. With ``drop_empty`` a group without any value gives no row.
    """
    used = {f"{m}{sep}{g}" for m in measures for g in groups}
    ids = [c for c in df.columns if c not in used]
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(measure: str, group: str) -> Column:
        full = f"{measure}{sep}{group}"
        if full in types:
            return quoted(full)
        kind = next(types[f"{measure}{sep}{g}"] for g in groups if f"{measure}{sep}{g}" in types)
        return F.lit(None).cast(kind)

    rows = F.array(*[
        F.struct(F.lit(g).alias(group_name), *[cell(m, g).alias(m) for m in measures]) for g in groups
    ])
    long = df.select(*[named(c) for c in ids], F.inline(rows))
    return long.dropna("all", subset=measures) if drop_empty else long


def widen(
    df: DataFrame, keys: list[str], name: str, names: list[str], values: list[str]
) -> DataFrame:
    """Long to wide with an explicit list of names, so that no extra job is needed to find them.

    With one value column the new columns are called after the names, with several ``<value>_<name>``.
    """
    single = len(values) == 1
    cells = [
        F.max(F.when(F.col(name) == n, quoted(v))).alias(n if single else f"{v}_{n}") for v in values for n in names
    ]
    return df.groupBy(*[named(k) for k in keys]).agg(*cells)


def split_columns(df: DataFrame, source: str, into: list[str], separator: str, remove: bool = False) -> DataFrame:
    """Split a text into a fixed number of columns: surplus pieces are dropped, missing ones are NULL."""
    pieces = F.split(quoted(source), separator)
    out = df.withColumns({n: F.get(pieces, F.lit(i)) for i, n in enumerate(into)})
    return out.drop(source) if remove else out


def explode_tokens(df: DataFrame, source: str, separator: str, token: str, position: str | None = None) -> DataFrame:
    """One row per piece of a separated text; a NULL text gives no row. Positions start at 1."""
    if position is None:
        return df.withColumn(token, F.explode(F.split(quoted(source), separator)))
    return (
        df.select("*", F.posexplode(F.split(quoted(source), separator)).alias("__pos", token))
        .withColumn(position, F.col("__pos") + 1)
        .drop("__pos")
    )


def explode_slots(df: DataFrame, vector: str, slots: int, slot: str, value: str) -> DataFrame:
    """A packed vector such as ``c(0, 1, NA)`` becomes one row per piece; shorter ones are filled up to ``slots`` rows."""
    pieces = F.split(F.regexp_replace(quoted(vector), r"c\(|\)", ""), ", ")
    return (
        df.withColumn("__pieces", pieces)
        .withColumn(slot, F.explode(F.sequence(F.lit(1), F.greatest(F.size("__pieces"), F.lit(slots)))))
        .withColumn(value, to_number(F.get("__pieces", F.col(slot) - 1)))
        .drop("__pieces", vector)
    )


def stack_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    return first.unionByName(second, allowMissingColumns=True)
