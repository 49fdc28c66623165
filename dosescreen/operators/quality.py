"""Data-quality reports. Each returns a small table of findings; ``require_empty`` turns one into a failure.

A report is a job of its own. Inside a stage, :class:`Audit` takes counts in the pass that writes the stage's table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dosescreen.operators.aggregates import count_by, distinct_by, duplicated_keys
from dosescreen.operators.joins import not_member_of
from dosescreen.operators.reshape import quoted
from dosescreen.session import cut_lineage


def key_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows, number of distinct keys, and whether they agree."""
    return count_by(df, keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return duplicated_keys(df, keys)


def join_fanout(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Row count of the left side before and after a left join, found from key counts without joining the rows."""
    copies = count_by(right.where(quoted(right_key).isNotNull()), [right_key], "copies").withColumnRenamed(
        right_key, "__right"
    )
    rows = count_by(left, [left_key], "rows")
    joined = rows.join(copies, quoted(left_key) == F.col("__right"), "left")
    return joined.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce(F.sum(F.col("rows") * F.coalesce("copies", F.lit(1))), F.lit(0)).cast("bigint").alias("rows_after"),
    )


def null_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs per column, in one row."""
    return df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in columns])


def unmatched_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of the left side that the right side does not have."""
    return not_member_of(distinct_by(left, [left_key]), left_key, right, right_key)


def unexpected_nulls(df: DataFrame, value: str, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """Keys whose value is NULL although they are not in the list of expected gaps."""
    return unmatched_keys(df.where(quoted(value).isNull()), key, allowed, allowed_key)


def rule_gaps(df: DataFrame, columns: list[str], marker: str = "fix") -> DataFrame:
    """Number of rows per column that no rule covered."""
    counts = df.agg(*[F.count_if(F.lower(quoted(c)) == marker).alias(c) for c in columns])
    return counts.unpivot([], [quoted(c) for c in columns], "column", "n")


def parse_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per text column: how many values are present and how many of them do not parse as the wanted type."""
    def bad(c: str, t: str) -> Column:
        return F.count_if(quoted(c).isNotNull() & quoted(c).try_cast(t).isNull())

    counted = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(quoted(c)).alias("n_present"), bad(c, t).alias("n_failed"))
        for c, t in types.items()
    ]).alias("__r"))
    return counted.select(F.inline("__r"))


def require_empty(findings: DataFrame, message: str) -> None:
    """Raise if there is a finding; reads one row at most."""
    if not findings.isEmpty():
        raise ValueError(message)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``df`` after making sure that its keys are unique (what a join partner must satisfy)."""
    require_empty(duplicated_keys(df, keys), f"keys {keys} are not unique")
    return df


Counts = dict[str, dict[str, int]]


class Audit:
    """Assertions on counts that Spark takes while it writes a stage's table.

    :meth:`watch` puts counts at a point of the plan, :meth:`expect` says what must hold between them, and
    :meth:`settled` writes the table and then tests. No job is started but the write. A task that runs again after a
    lost executor may be counted twice, so a test that fails is repeated exactly, by the findings given for it, before
    it becomes an error.
    """

    def __init__(self) -> None:
        self._observed: dict[str, Observation] = {}
        self._tests: list[tuple[Callable[[Counts], bool], Callable[[], DataFrame], str]] = []
        self._counts: Counts = {}
        self._left_out: set[str] = set()

    def watch(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """``df``, its rows and the aggregates ``counts`` being counted whenever it is computed."""
        if name in self._observed or name in self._counts or name in self._left_out:
            raise ValueError(f"{name} is watched already")
        self._observed[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._observed[name], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])

    def expect(self, test: Callable[[Counts], bool], findings: Callable[[], DataFrame], message: str) -> None:
        """``test`` on the counts by name; ``findings`` gives the rows that break it, computed only if it fails."""
        self._tests.append((test, findings, message))

    def same_rows(self, before: str, after: str, findings: Callable[[], DataFrame], message: str) -> None:
        """A join neither multiplies nor loses rows."""
        self.expect(lambda c: c[before]["rows"] == c[after]["rows"], findings, message)

    def settled(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, after all tests."""
        table = cut_lineage(df)
        self.verify()
        return table

    def counts(self) -> Counts:
        """The counts of all watched tables, but for those that Spark did not need to compute.

        Waits until the plans they are in have been run once.
        """
        for name, observation in self._observed.items():
            try:
                self._counts[name] = {k: v or 0 for k, v in observation.get.items()}
            except Py4JJavaError:  # the optimizer has found that the table cannot add a row, and left it out
                self._left_out.add(name)
        self._observed = {}
        return self._counts

    def verify(self) -> None:
        counts, tests = self.counts(), self._tests
        self._tests = []
        for test, findings, message in tests:
            try:
                held = test(counts)
            except KeyError:  # without a count the findings decide
                held = False
            if not held:
                require_empty(findings(), message)

    def report(self, spark: SparkSession) -> DataFrame:
        """(name, metric, value) of all counts."""
        rows = [(n, m, v) for n, c in self.counts().items() for m, v in c.items()]
        return spark.createDataFrame(rows, "name string, metric string, value bigint")
