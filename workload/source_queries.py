"""Readers and writers on files that Spark writes from the driver tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.session import STAGE_PREFIX, use_checkpoints
from dosescreen.sources import readers, writers
from workload.registry import query, table


def _folder(spark) -> str:
    return f"{use_checkpoints(spark)}/{STAGE_PREFIX}{uuid.uuid4().hex}"


def _written(df: DataFrame, sep: str, **options) -> str:
    path = _folder(df.sparkSession)
    df.write.options(header="true", sep=sep, nullValue="NA", **options).csv(path)
    return path


@query("read_tabs", """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS casn, l_extendedprice AS "uM",
  CASE WHEN l_discount > 0 THEN l_discount END AS conc, CASE WHEN l_returnflag = 'A' THEN l_returnflag END AS flag
FROM lineitem""")
def read_tabs(spark, folder):
    wells = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("'"), F.col("l_partkey").cast("string")).alias("casn"),
        F.col("l_extendedprice").alias("uM"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("conc"),
        F.when(F.col("l_returnflag") == "A", F.col("l_returnflag")).alias("flag"),
    )
    back = readers.read_tabs(spark, _written(wells, "\t"), "wells")
    return readers.typed(readers.without_guard(back, "casn"), {"l_orderkey": "bigint", "l_linenumber": "int"})


@query("read_tildes", """SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS "Ingredient",
  CASE WHEN p_type <> 'PROMO' THEN p_type END AS "Type" FROM part""")
def read_tildes(spark, folder):
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("Ingredient"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("Type"),
    )
    return readers.read_tildes(spark, _written(rows, "~", quote=""))


@query("read_skipped", """SELECT 'C' || c_custkey AS code, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'List of names' END
  AS note FROM customer""")
def read_skipped(spark, folder):
    """Several files, each with a title of two lines; the title's text comes again as data, the first column is unnamed."""
    lines = table(spark, folder, "customer").repartition(4, "c_custkey").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias(""), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 > 0, "List of names").alias("note"),
    )
    path = _folder(spark)
    body = lines.select(F.lit(1).alias("file"), F.concat_ws(",", F.col(""), "name", F.coalesce("note", F.lit("NA"))).alias("value"))
    # every partition becomes a file with the title, an empty line and the header before its lines
    titled = body.repartition(4).withColumn("file", F.spark_partition_id()).withColumn("at", F.lit(1))
    top = spark.range(4).select(F.col("id").cast("int").alias("file"), F.lit("List of names\n\n,name,note").alias("value"),
                                F.lit(0).alias("at"))
    (titled.unionByName(top).repartitionByRange(4, "file").sortWithinPartitions("file", "at")
     .select("file", "value").write.partitionBy("file").text(path))
    return readers.read_commas(spark, f"{path}/*", skip=2)


@query("rejected_rows", """SELECT reason, "columns", raw FROM (SELECT c_custkey % 7 AS kind, CASE c_custkey % 7 WHEN 1 THEN 'short'
  WHEN 2 THEN 'long' WHEN 3 THEN 'type' WHEN 4 THEN 'type' END AS reason, CASE c_custkey % 7 WHEN 3 THEN 'balance'
  WHEN 4 THEN 'key,balance' ELSE '' END AS "columns", CASE c_custkey % 7 WHEN 1 THEN c_custkey || ',"' || c_name || ', short"'
  WHEN 2 THEN c_custkey || ',"' || c_name || '",1.5,more' WHEN 3 THEN c_custkey || ',"' || c_name || '",one' WHEN 4
  THEN 'C' || c_custkey || ',"",two' ELSE c_custkey || ',"' || c_name || '",NA' END AS raw FROM customer) WHERE reason IS NOT NULL""")
def rejected_rows(spark, folder):
    """Customers as lines, of which some lack a field, have one too many, or hold words where numbers are wanted."""
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"'))
    kind = F.col("c_custkey") % 7
    line = (F.when(kind == 1, F.concat(key, F.lit(',"'), "c_name", F.lit(', short"'))).when(kind == 2, F.concat(key, F.lit(","), name, F.lit(",1.5,more")))
            .when(kind == 3, F.concat(key, F.lit(","), name, F.lit(",one"))).when(kind == 4, F.concat(F.lit("C"), key, F.lit(',"",two')))
            .otherwise(F.concat(key, F.lit(","), name, F.lit(",NA"))))
    rows = table(spark, folder, "customer").select(line.alias("value")).repartition(3).withColumn("file", F.spark_partition_id())
    top = spark.range(3).select(F.lit("key,name,balance").alias("value"), F.col("id").cast("int").alias("file"))
    path = _folder(spark)
    (top.withColumn("at", F.lit(0)).unionByName(rows.withColumn("at", F.lit(1))).repartitionByRange(3, "file")
     .sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path))
    found = readers.rejected_rows(spark, f"{path}/*", {"key": "bigint", "balance": "double"})
    return found.select("reason", "columns", "raw")


@query("read_matrix", """SELECT 'C' || p_partkey AS code, CASE WHEN p_size > 5 THEN p_retailprice END AS "A_up",
  CAST(p_size AS DOUBLE) AS "B_up" FROM part""")
def read_matrix(spark, folder):
    wide = table(spark, folder, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("X1"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("A_up"), F.col("p_size").alias("B_up"),
    )
    return readers.read_matrix(spark, _written(wide, ","), ["A_up", "B_up"])


@query("write_published", """SELECT '''' || c_custkey AS "CASN", c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END
  AS balance FROM customer""")
def write_published(spark, folder):
    out = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("CASN"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
    )
    path = _folder(spark)
    writers.write_published(out, path, guard="CASN")
    return readers.typed(readers.read_delimited(spark, path), {"balance": "double"})


@query("matrix_landed", """SELECT 'C' || p_partkey AS code, CASE WHEN p_size > 5 THEN p_retailprice END AS "A_up",
  CAST(p_size AS DOUBLE) AS "B_up" FROM part""")
def matrix_landed(spark, folder):
    """A wide matrix landed once by column, of which two columns are read back."""
    wide = table(spark, folder, "part").select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("X1"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("A_up"), F.col("p_size").alias("B_up"),
        *[(F.col("p_retailprice") / k).alias(f"C_{k}") for k in range(1, 20)],
    )
    path = _folder(spark)
    readers.land_matrix(spark, _written(wide, ","), path)
    return readers.read_landed(spark, path, ["A_up", "B_up"])
