"""Mixing sources to target weights with weighted sampling without replacement.

Targets: every source has a weight; all words are shared by weight, no target exceeds ``most`` times its source's words,
and what a source can't take is shared again by weight. Sources that can't take their share come first in the order of
(most x words / weight), so that the final level is one running sum over the table of sources.

Selection: a source first takes its complete epochs, then documents in the order of Efraimidis-Spirakis exponential keys
-ln(u) / weight, u being a hash of id and text, until the rest of the budget is filled to the nearest document. Keys are
cut into slices by a monotone function, slices are summed before anything is sorted, and the running sum goes over the
slices' sums and then inside each slice, so that no task sorts a whole source.

Defined results: NULL or empty texts have size 0 and take 0; a NULL source is a source of its own, last in order; a NULL
or non-positive document weight counts as the smallest weight; rows that repeat an id and text are sampled as rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosescreen.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SLICES = 1024
LEAST_WEIGHT = 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A text that is never NULL and differs for NULL and every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(skey, source, source_size, target) of the sources of ``rows`` (skey, source, size).

    Works on one row per source: names in code point order, NULL last, take ``weights`` in turn.
    """
    sums = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    by_limit = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
             / F.sum("share").over(after))
    leveled = (sums.withColumn("share", share).withColumn("source_size", F.col("source_size").cast("long"))
               .withColumn("limit", most * F.col("source_size") / F.col("share"))
               .withColumn("level", level).withColumn("place", F.row_number().over(by_limit)))
    final = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("place", "level"))).over(whole)["level"]
    return leveled.withColumn("final", final).select(
        "skey", "source", "source_size",
        F.coalesce(F.least(F.col("final") * F.col("share"), most * F.col("source_size").cast("double")),
                   most * F.col("source_size").cast("double")).alias("target"))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 17,
        slices: int = SLICES) -> DataFrame:
    """Decide how often each row is taken.

    ``rows`` has id, source, size (words), weight (quality) and salt (a hash of the text that tells rows of one id
    apart). Returns id, source, size, source_size, target, epochs (complete passes) and taken (words, repeats counted).
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.col("salt")), 11) + 0.5) / float(1 << 53)
    weight = F.greatest(F.coalesce(F.when(F.isnan("weight"), None).otherwise(F.col("weight")), F.lit(LEAST_WEIGHT)),
                        F.lit(LEAST_WEIGHT)).cast("double")
    keyed = cut_lineage(rows.select("id", "source", F.col("size").cast("long").alias("size"), "salt",
                                    source_key(F.col("source")).alias("skey"), (-F.log(uniform) / weight).alias("key"))
                        .withColumn("slice", F.least(F.floor(slices * (1 - F.exp(-F.col("key")))),
                                                     F.lit(slices - 1)).cast("int")))
    goals = targets(keyed, weights, most)
    below = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy("skey", "slice").agg(F.sum("size").alias("sum"))
            .withColumn("base", F.coalesce(F.sum("sum").over(below), F.lit(0))).drop("sum"))
    base = cut_lineage(base.join(goals.drop("source"), "skey"))
    inside = Window.partitionBy("skey", "slice").orderBy("key", "id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    reached = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    return (keyed.join(base, ["skey", "slice"])
            .withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
            .withColumn("extra", (reached <= rest) & (F.col("epochs") < most))
            .select("id", "source", "size", "source_size", "target", "epochs",
                    (F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))).alias("taken")))


def weighted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """Rows for :func:`mix`: size in words, weight 2 for good, 0.5 for poor and 1 for unlabelled documents."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("salt"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("good"))
    return slim.join(marks, "id", "left").withColumn(
        "weight", F.coalesce(0.5 + 1.5 * F.col("good"), F.lit(1.0))).drop("good")
