"""Chat formatting after collapsing cumulative snapshots; DataFrame functions only.

A logged conversation that is a prefix of a longer one, or equal to one with a smaller id, goes. A prefix is known by
its number of turns and two 64-bit hashes, the exclusive ors of the hashes of (place, turn) over its turns. Prefix hashes
roll over the turns in two levels, blocks of turns and turns inside a block, so no task has to hold a conversation. An
anti-join of whole conversations with all proper prefixes leaves the maximal ones, which are rendered in parts of at
most ``PART`` turns.

Defined results: turns are ordered by ``turn`` (NULL first), ties by a hash of the rendered turn; a NULL role is
"unknown", a NULL text empty; rows without conv_id belong to no conversation and are left out; repeated rows are turns of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosescreen.session import cut_lineage

PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat layout; what looks like a mark inside a text is broken up."""
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("<​|"))

    return F.concat(F.lit(OPEN), plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"),
                    plain(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    piece = rendered(F.col("role"), F.col("text"))
    return conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), piece.alias("piece"),
        F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-(1 << 62))).alias("block")).withColumn(
        "h1", F.xxhash64("piece")).withColumn("h2", F.xxhash64(F.lit("other"), F.col("piece")))


def _placed(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "h1", "h2")
    return turns.join(offsets, ["conv_id", "block"]).withColumn("place", F.col("offset") + F.row_number().over(inside))


def _offsets(turns: DataFrame) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
            .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))


def prefixes(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """(conv_id, place, x1, x2): the hashes of every prefix of every conversation."""
    placed = cut_lineage(_placed(turns.drop("piece"), offsets)
                         .select("conv_id", "block", "place", F.xxhash64("place", "h1", "h2").alias("m1"),
                                 F.xxhash64("place", "h2", "h1").alias("m2")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"))
    zero = F.lit(0).cast("long")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.bit_xor("s1").over(before), zero).alias("b1"),
                           F.coalesce(F.bit_xor("s2").over(before), zero).alias("b2"))
    return placed.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "place", F.col("b1").bitwiseXOR(F.bit_xor("m1").over(inside)).alias("x1"),
        F.col("b2").bitwiseXOR(F.bit_xor("m2").over(inside)).alias("x2"))


def maximal(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """(conv_id, turns, copies) of the conversations that no longer one starts with; the smallest id of equal ones."""
    rolled = cut_lineage(prefixes(turns, offsets))
    whole = cut_lineage(rolled.groupBy("conv_id").agg(F.max(F.struct("place", "x1", "x2")).alias("end"))
                        .select("conv_id", "end.*"))
    proper = (rolled.join(whole.select("conv_id", F.col("place").alias("turns")), "conv_id").where("place < turns")
              .select("place", "x1", "x2").distinct())
    distinct = whole.groupBy("place", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return distinct.join(proper, ["place", "x1", "x2"], "left_anti").select(
        "conv_id", F.col("place").alias("turns"), "copies")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns, copies, chat) of the maximal conversations; ``turns`` and ``copies`` are the whole's."""
    turns = _turns(conversations)
    offsets = cut_lineage(_offsets(turns))
    kept = cut_lineage(maximal(turns, offsets))
    placed = _placed(turns.join(kept.select("conv_id"), "conv_id", "left_semi"), offsets)
    parts = (placed.groupBy("conv_id", F.floor((F.col("place") - 1) / PART).cast("long").alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
             .select("conv_id", "part", F.array_join("pieces.piece", "").alias("chat")))
    return parts.join(kept, "conv_id").select("conv_id", "part", "turns", "copies", "chat")
