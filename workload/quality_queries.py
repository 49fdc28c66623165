"""Data-quality reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosescreen.operators import quality
from dosescreen.operators.reshape import columns_containing, on_text_columns, pick
from dosescreen.functions import text as txt
from workload.evidence_queries import SUMMARY, merged
from workload.registry import query, table
from dosescreen.operators import evidence
from dosescreen import fixed_values as fixed


@query("qc_key_unique", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, sum(n) = count(*) AS is_unique
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def qc_key_unique(spark, folder):
    return quality.key_unique(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc_key_duplicates", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1""")
def qc_key_duplicates(spark, folder):
    return quality.key_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc_join_fanout", """SELECT (SELECT count(*) FROM part) AS rows_before,
(SELECT count(*) FROM part LEFT JOIN lineitem ON p_partkey = l_partkey) AS rows_after""")
def qc_join_fanout(spark, folder):
    return quality.join_fanout(
        table(spark, folder, "part"), table(spark, folder, "lineitem"), "p_partkey", "l_partkey"
    )


@query("qc_null_counts", """SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (quality IS NULL) AS quality,
count(*) FILTER (toxic IS NULL) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def qc_null_counts(spark, folder):
    both = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return quality.null_count(both, ["doc_id", "quality", "toxic"])


@query("qc_unmatched", """SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def qc_unmatched(spark, folder):
    return quality.unmatched_keys(
        table(spark, folder, "documents"), "doc_id", table(spark, folder, "labels"), "doc_id"
    )


@query("qc_unexpected_nulls", """SELECT DISTINCT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
AND o_orderstatus = 'P' WHERE o_totalprice IS NULL AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def qc_unexpected_nulls(spark, folder):
    open_orders = table(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("o_totalprice")
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    both = customers.join(open_orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return quality.unexpected_nulls(both, "o_totalprice", "c_custkey", table(spark, folder, "supplier"), "s_suppkey")


@query("qc_rule_gap", f"""WITH {SUMMARY} SELECT 'Carcinogencity' AS "column", count(*) FILTER (lower(cancer_calls) = 'fix') AS n
FROM summary UNION ALL SELECT 'summary', count(*) FILTER (lower(toxicity_summary) = 'fix') FROM summary""")
def qc_rule_gap(spark, folder):
    out = evidence.evidence_summary(merged(spark, folder)).select(
        F.col("`Carcinogencity (ToxValDb)`").alias("Carcinogencity"), F.col(f"`{fixed.TOXICITY_SUMMARY}`").alias("summary")
    )
    return quality.rule_gaps(out, ["Carcinogencity", "summary"])


@query("qc_parse_failures", """SELECT 'props' AS "column", count(props) AS n_present,
count(*) FILTER (props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL) AS n_failed FROM events
UNION ALL SELECT 'k', count(k), count(*) FILTER (k IS NOT NULL AND try_cast(k AS DOUBLE) IS NULL)
FROM (SELECT regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def qc_parse_failures(spark, folder):
    events = table(spark, folder, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1))
    return quality.parse_failures(events, {"props": "double", "k": "double"})


@query("columns_by_name_part", """SELECT l_orderkey, l_linenumber, l_discount, l_linestatus FROM lineitem""")
def columns_by_name_part(spark, folder):
    lines = table(spark, folder, "lineitem")
    wanted = columns_containing(lines, "ORDERKEY") + columns_containing(lines, "line") + columns_containing(lines, "Disc")
    return pick(lines, wanted)


@query("trim_text_columns", r"""SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM benchmark
UNION ALL SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') FROM documents""")
def trim_text_columns(spark, folder):
    texts = table(spark, folder, "benchmark").unionByName(
        table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text")
    )
    return on_text_columns(texts, txt.trim_both)
