"""Writers for stage results and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dosescreen.functions import text as txt
from dosescreen.functions.numeric import number_text
from dosescreen.operators.reshape import quoted


def with_guard(df: DataFrame, column: str) -> DataFrame:
    """Prepend an apostrophe to identifiers that a spreadsheet would read as dates."""
    return df.withColumn(column, txt.add_guard(quoted(column)))


def write_stage(df: DataFrame, path: str) -> None:
    """Hand a table to the next stage as Parquet, which keeps types and the difference of NULL and empty text."""
    df.write.mode("overwrite").parquet(path)


def write_published(df: DataFrame, path: str, guard: str | None = None) -> None:
    """Delimited text with a header, NULL as ``NA``, numbers without exponent; one file per partition, in parallel."""
    out = with_guard(df, guard) if guard else df
    out = out.select(*[number_text(quoted(c)).alias(c) if t == "double" else quoted(c) for c, t in out.dtypes])
    out.write.mode("overwrite").options(header="true", nullValue="NA", emptyValue="").csv(path)
