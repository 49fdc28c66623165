"""Ranks inside groups of any size.

A window partitioned by the group would sort a whole group in one task. Here rows are range-partitioned by group *and*
value, so a group with a third of all rows is spread over a third of the partitions. Each partition ranks its own
slice; the number of rows in earlier slices of the same group is added afterwards. The range-partitioned rows are
written to a table with their slice number, because numbers and contents of slices must come from the same run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosescreen.functions.numeric import INF
from dosescreen.operators.quality import Audit
from dosescreen.operators.reshape import quoted
from dosescreen.session import cut_lineage


def _sliced(df: DataFrame, order: list[Column], slices: int | None) -> DataFrame:
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(slices, *order).withColumn("__slice", F.spark_partition_id()))


def _with_offsets(ranged: DataFrame, groups: list[str], inside: Column, weight: Column) -> DataFrame:
    """Add ``__before`` and ``__total``: weight before the row in its group, and weight of the whole group.

    ``inside`` is the weight before the row in its slice. Only groups that cross a slice border need more than that.
    Slices are contiguous, so a border is crossed by one group at most and the table of crossing parts has no more than
    two rows per slice; that bound is what allows the broadcast.
    """
    keys = [quoted(g) for g in groups]
    whole = Window.partitionBy(*keys)
    parts = ranged.groupBy(*keys, "__slice").agg(F.sum(weight).alias("__w"))
    crossing = parts.withColumn("__n", F.count(F.lit(1)).over(whole)).where("__n > 1").select(
        *[k.alias(f"__g{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__s"),
        F.coalesce(
            F.sum("__w").over(whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__earlier"),
        F.sum("__w").over(whole).alias("__all"),
    )
    local = ranged.withColumns({
        "__inside": inside, "__here": F.sum(weight).over(Window.partitionBy("__slice", *keys)),
    })
    same = [k.eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
    joined = local.join(
        F.broadcast(crossing), reduce(lambda a, b: a & b, same + [F.col("__slice") == F.col("__s")]), "left"
    )
    return joined.withColumns({
        "__before": F.col("__inside") + F.coalesce("__earlier", F.lit(0)),
        "__total": F.coalesce("__all", "__here"),
    }).drop("__s", "__earlier", "__all", "__inside", "__here", *[f"__g{i}" for i in range(len(keys))])


def value_ranks(df: DataFrame, groups: list[str], values: list[str], slices: int | None = None) -> DataFrame:
    """One row per group, value column and distinct value of it.

    Gives ``measure`` (index into ``values``), ``value``, ``below`` (rows smaller), ``ties`` (rows equal) and
    ``group_rows`` (rows in all). NULL values are left out and not counted. All columns are ranked in one pass.
    """
    keys = [quoted(g) for g in groups]
    cells = F.array(*[
        F.struct(F.lit(i).alias("measure"), quoted(v).cast("double").alias("value")) for i, v in enumerate(values)
    ])
    tally = (
        df.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())
        .groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("ties"))
    )
    ranged = _sliced(tally, [*keys, F.col("measure"), F.col("value")], slices)
    order = Window.partitionBy("__slice", *keys, "measure").orderBy("value")
    inside = F.coalesce(F.sum("ties").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _with_offsets(ranged, [*groups, "measure"], inside, F.col("ties")).select(
        *keys, "measure", "value", F.col("__before").alias("below"), "ties", F.col("__total").alias("group_rows")
    )


def attach_ranks(df: DataFrame, groups: list[str], out: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns ``{name: (value column, expression)}``; NULL where the value is NULL.

    Expressions use ``below``, ``ties`` and ``group_rows`` of the row's value inside its group.
    """
    values = list(dict.fromkeys(v for v, _ in out.values()))
    ranks = value_ranks(df, groups, values)
    for i, value in enumerate(values):
        lookup = ranks.where(F.col("measure") == i).select(
            *[quoted(g).alias(f"__k{j}") for j, g in enumerate(groups)], F.col("value").alias("__v"),
            *[e.alias(n) for n, (v, e) in out.items() if v == value],
        )
        same = [quoted(g).eqNullSafe(F.col(f"__k{j}")) for j, g in enumerate(groups)]
        test = reduce(lambda a, b: a & b, same + [quoted(value).cast("double") == F.col("__v")])
        df = df.join(lookup, test, "left").drop("__v", *[f"__k{j}" for j in range(len(groups))])
    return df


def average_rank(df: DataFrame, groups: list[str], value: str, out: str, ties: str | None = None) -> DataFrame:
    """Rank from 1 inside the group, ties sharing their mean rank; ``ties`` names a column for the rows of one rank."""
    wanted = {out: (value, F.col("below") + (F.col("ties") + 1) / F.lit(2.0))}
    return attach_ranks(df, groups, wanted | ({ties: (value, F.col("ties"))} if ties else {}))


def percent_rank(df: DataFrame, groups: list[str], out: dict[str, tuple[str, bool]]) -> DataFrame:
    """(rank - 1) / (n - 1) for ``{name: (value column, descending)}``.

    ``n`` counts the non-NULL values of the group; the result is NULL for a NULL value and in a group of one.
    """
    larger = F.col("group_rows") - F.col("below") - F.col("ties")
    return attach_ranks(df, groups, {
        name: (value, F.try_divide(larger if descending else F.col("below"), F.col("group_rows") - 1))
        for name, (value, descending) in out.items()
    })


def positions(
    df: DataFrame, groups: list[str], order: list, position: str, group_rows: str, slices: int | None = None
) -> DataFrame:
    """Number the rows of each group in the given order and add the group's size.

    Rows that are equal in every ordering column follow each other in any order. A row number is added as the last
    ordering column for them, so that even a great many equal rows spread over several slices.
    """
    keys = [quoted(g) for g in groups]
    named = df.withColumns({f"__o{i}": c for i, c in enumerate(_plain(order))}).withColumn(
        "__row", F.monotonically_increasing_id()
    )
    by = [_directed(F.col(f"__o{i}"), c) for i, c in enumerate(order)] + [F.col("__row")]
    ranged = _sliced(named, keys + by, slices)
    inside = F.row_number().over(Window.partitionBy("__slice", *keys).orderBy(*by)).cast("bigint")
    out = _with_offsets(ranged, groups, inside, F.lit(1))
    return out.withColumns({position: F.col("__before"), group_rows: F.col("__total")}).drop(
        "__slice", "__row", "__before", "__total", *[f"__o{i}" for i in range(len(order))]
    )


class Descending:
    """Marks an ordering column as descending, NULLs last."""

    def __init__(self, column: Column | str):
        self.column = F.col(column) if isinstance(column, str) else column


def _plain(order) -> list[Column]:
    return [c.column if isinstance(c, Descending) else (F.col(c) if isinstance(c, str) else c) for c in order]


def _directed(column: Column, spec) -> Column:
    return column.desc_nulls_last() if isinstance(spec, Descending) else column.asc_nulls_last()


def lowest_with_ties(
    df: DataFrame, groups: list[str], weight: str, single: str | None = None, audit: Audit | None = None,
) -> DataFrame:
    """Rows that carry the group's smallest weight, all of them on a tie; NULL weights are dropped.

    The input is computed once and settled; minima are combined in the map tasks and joined back, so that a group whose
    rows all tie stays spread over its partitions. With ``audit`` the groups whose lowest rows differ in ``single`` are
    counted as ``lowest.ambiguous``; the weight is a number then.
    """
    df = cut_lineage(df.where(quoted(weight).isNotNull()))
    wanted = [F.min(quoted(weight)).alias("__least")]
    if audit:
        low = F.min(F.struct(quoted(weight).alias("w"), quoted(single).alias("v")))["v"]
        high = F.max(F.struct((-quoted(weight)).alias("w"), quoted(single).alias("v")))["v"]
        wanted.append((low != high).alias("__several"))
    least = df.groupBy(*[quoted(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(*wanted)
    if audit:
        least = audit.watch(least, "lowest", ambiguous=F.count_if("__several"))
    same = [quoted(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    return df.join(least, reduce(lambda a, b: a & b, same + [quoted(weight) == F.col("__least")]), "left_semi")


def share_class(share: Column, cuts) -> Column:
    """Name of the first class whose upper bound is above ``share``; the last class has no bound."""
    chain = None
    for bound, name in cuts:
        test = share.isNotNull() & (share < (INF if bound is None else bound))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain
