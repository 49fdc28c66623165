"""Readers. Every schema is written down; nothing is inferred from the data.

Unknown columns of a file are ignored by name. A text file that is read more than once should be landed as Parquet with
:func:`land`, so that later reads fetch only the columns they need.
"""

from __future__ import annotations

import csv
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosescreen.functions import text as txt
from dosescreen.operators.quality import parse_failures
from dosescreen.operators.reshape import quoted
from dosescreen.session import STAGE_PREFIX, cut_lineage, use_checkpoints

MISSING = "NA"
#: Files that a landed matrix may have for each column.
LANDED_PARTS = 8

# column types of the known inputs; columns not named here stay text
SCHEMAS: dict[str, dict[str, str]] = {
    "concentrations": {"conc": "double"},
    "wells": {"conc_index": "int", "conc": "double", "rowi": "int", "coli": "int", "uM": "double"},
    "distances": {"adj_maxmMD": "double"},
    "predictions": {"seem3": "double", "seem3.l95": "double", "seem3.u95": "double"},
    "studies": {"toxval_numeric": "double"},
    "pesticide_status": {"Active products": "double", "Not active products": "double"},
    "areas": {"AUC.Agonist": "double", "AUC.Antagonist": "double"},
}


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", quote: str = '"', skip: int = 0, missing: str = MISSING,
    multiline: bool = False, keep_blank: bool = False,
) -> DataFrame:
    """Delimited text with a header, all columns as text; an unnamed first column is called ``code``.

    ``skip`` lines before the header are left out of every file. ``missing`` is NULL. So is the empty text, and short rows
    are filled with NULL, unless ``keep_blank``: then both are empty texts.
    """
    options = _options(sep, quote, "" if keep_blank else missing)
    if skip and not multiline:
        names, lines = _body(numbered_lines(spark, path), sep, quote, skip)
        df = lines.select(_parsed(names, options).alias("__row")).select("__row.*")
    else:
        if skip:
            path = _without_top(spark, path, skip)
        df = spark.read.options(header="true", multiLine=str(multiline).lower(), **options).csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, "code") if first in ("_c0", "", "X1") else df
    if keep_blank:
        return df.select(*[F.nullif(F.coalesce(quoted(c), F.lit("")), F.lit(missing)).alias(c) for c in df.columns])
    return df.select(*[F.nullif(quoted(c), F.lit("")).alias(c) for c in df.columns])


def _options(sep: str, quote: str, missing: str) -> dict[str, str]:
    return {"sep": sep, "quote": quote, "nullValue": missing, "emptyValue": "", "mode": "PERMISSIVE"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of all files, numbered from 1 in each, however the files are split.

    Lines keep their order inside a block of a file, so a line's number is its place in the block and the lines of the
    blocks before. The table of blocks has one row per block; the lines are settled, so that places are fixed.
    """
    lines = cut_lineage(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    ))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "start").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(blocks, ["file", "start"]).select("file", (F.col("place") + F.col("shift")).alias("line"), "value")


def _body(lines: DataFrame, sep: str, quote: str, skip: int) -> tuple[list[str], DataFrame]:
    """The names in the header, and the filled lines behind it. All files have the header of the first one."""
    filled = lines.where((F.col("line") > skip) & (F.trim("value") != ""))
    headers = filled.groupBy("file").agg(F.min(F.struct("line", "value")).alias("top")).select("file", "top.*")
    top = headers.orderBy("file").select("value").first()
    if top is None:
        raise ValueError("no header line")
    marked = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    names = next(csv.reader([top["value"].removeprefix("\ufeff")], delimiter=sep, **marked))
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    seen = [n.lower() for n in names]
    names = [f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]
    heads = headers.select(F.col("file").alias("__file"), F.col("line").alias("__line"))
    return names, filled.join(heads, F.col("file") == F.col("__file")).where("line > __line").drop("__file", "__line")


def _parsed(names: list[str], options: dict[str, str]) -> Column:
    return F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), options)


def _without_top(spark: SparkSession, path: str, skip: int) -> str:
    """Copy each file without its first lines into the shared folder, for records that span lines.

    The lines of a file are written in their order by one task, as Spark reads such files by one task too.
    """
    folder = f"{use_checkpoints(spark)}/{STAGE_PREFIX}{uuid.uuid4().hex}"
    rest = numbered_lines(spark, path).where(F.col("line") > skip).withColumn("of", F.sha1("file"))
    rest.repartition("of").sortWithinPartitions("of", "line").select("of", "value").write.partitionBy("of").text(folder)
    return f"{folder}/*"


def rejected_rows(
    spark: SparkSession, path: str, types: dict[str, str], sep: str = ",", quote: str = '"', skip: int = 0,
    missing: str = MISSING,
) -> DataFrame:
    """(file, line, reason, columns, raw): the lines that do not give a whole row of the wanted types.

    The reason is ``short`` or ``long`` for too few or too many fields, else ``type`` with the columns that do not parse,
    comma-joined. Records are single lines; ``types`` of columns that the file lacks are ignored.
    """
    names, lines = _body(numbered_lines(spark, path), sep, quote, skip)
    mark = re.escape(quote) if quote else None
    bare = F.regexp_replace("value", f"{mark}(?:[^{mark}]|{mark}{mark})*{mark}", "") if quote else F.col("value")
    fields = F.regexp_count(bare, F.lit(re.escape(sep))) + 1
    row = _parsed(names, _options(sep, quote, missing)).alias("__row")
    wrong = F.array_compact(F.array(*[
        F.when((F.col(f"__row.`{c}`") != "") & F.col(f"__row.`{c}`").try_cast(t).isNull(), F.lit(c))
        for c, t in types.items() if c in names
    ])) if any(c in names for c in types) else F.array().cast("array<string>")
    reason = (F.when(F.col("__fields") < len(names), "short").when(F.col("__fields") > len(names), "long")
              .when(F.size("__wrong") > 0, "type"))
    found = lines.select("*", row, fields.alias("__fields")).withColumn("__wrong", wrong)
    columns = F.when(F.col("reason") == "type", F.array_join("__wrong", ",")).otherwise(F.lit(""))
    return (found.withColumn("reason", reason).where("reason IS NOT NULL")
            .select("file", "line", "reason", columns.alias("columns"), F.col("value").alias("raw")))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named text columns that exist; values that do not parse become NULL (see :func:`bad_values`)."""
    return df.withColumns({c: quoted(c).try_cast(t) for c, t in types.items() if c in df.columns})


def numeric_except(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """Cast all columns but the named ones to double: the shape of an assay matrix."""
    return df.select(*[
        quoted(c) if c in text_columns else quoted(c).try_cast("double").alias(c) for c in df.columns
    ])


def bad_values(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Which columns hold values that do not parse, and how many."""
    return parse_failures(df, {c: t for c, t in types.items() if c in df.columns}).where("n_failed > 0")


def read_tabs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return typed(read_delimited(spark, path, sep="\t"), SCHEMAS.get(kind, {}))


def read_commas(spark: SparkSession, path: str, kind: str | None = None, skip: int = 0) -> DataFrame:
    return typed(read_delimited(spark, path, skip=skip), SCHEMAS.get(kind, {}))


def read_tildes(spark: SparkSession, path: str) -> DataFrame:
    """``~``-separated lines without quoting; blank fields and the missing ends of short rows are empty texts."""
    return read_delimited(spark, path, sep="~", quote="", keep_blank=True)


def read_matrix(spark: SparkSession, path: str, columns: list[str], sep: str = ",", code: str = "code") -> DataFrame:
    """A few columns of a wide assay matrix as numbers, keyed by its unnamed first column."""
    wide = read_delimited(spark, path, sep=sep)
    return numeric_except(wide.select(quoted(code), *[quoted(c) for c in columns]), [code])


def land_matrix(spark: SparkSession, path: str, folder: str, sep: str = ",", code: str = "code") -> DataFrame:
    """Read a wide assay matrix once and land it as a long table, one folder for each column, sorted by code.

    Gives (row, code, value, name), ``row`` telling rows of one code apart. Cells that are no numbers are NULL.
    """
    wide = numeric_except(read_delimited(spark, path, sep=sep), [code]).withColumn("row", F.monotonically_increasing_id())
    names = [c for c in wide.columns if c not in (code, "row")]
    # one table in wide form is settled, as the columns' folders are written by many tasks
    long = cut_lineage(wide).unpivot(["row", quoted(code)], [quoted(c) for c in names], "name", "value")
    dealt = long.repartition(F.col("name"), F.pmod("row", F.lit(LANDED_PARTS))).sortWithinPartitions("name", code)
    dealt.write.mode("overwrite").partitionBy("name").parquet(folder)
    return spark.read.parquet(folder)


def read_landed(spark: SparkSession, folder: str, columns: list[str], code: str = "code") -> DataFrame:
    """A few columns of a landed matrix in wide form: only the folders of these columns are read."""
    long = spark.read.parquet(folder).where(F.col("name").isin(columns))
    return long.groupBy("row", quoted(code)).pivot("name", columns).agg(F.first("value")).drop("row")


def without_guard(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, txt.strip_guard(quoted(column)))


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table once as Parquet and read it back from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
