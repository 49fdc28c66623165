"""Shards on a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Every shard has ``nodes`` points on a ring of 64-bit hashes. The keys are the distinct texts, so that copies stay together:
a key goes to the shard of the next point clockwise. A shard takes its keys in order, large ones first and those of a size
by hash, until its capacity is full; keys that overflow continue clockwise to the next shard that still has room, round by
round. The capacity is the mean load times 1 + ``slack``, which bounds every shard from above. Where gaps are too small for
the keys that are left at last, every shard may take one more of these.

Loads are summed in cells before any shard is filled: a cell holds the keys that arrive at one point of the ring, have
sizes of one power of two and share a slice of the hash. Cells are taken whole. Their number depends on the ring and not on
the documents, so the rounds work on a table of bounded size, and a cell is a small part of a shard. A key that alone would
be a large one (more than a 1 / ``PIECES`` of a shard's bytes or rows) is dealt into pieces by id, and equal rows by a copy
number, so that a text that a third of all documents have fills several shards and no task holds it whole.

Defined results: a NULL text has no bytes, the checksum of the empty text, and the key of no other text; a NULL id is hashed
as NULL; rows that repeat id and text are rows of their own, and which of them gets which slot does not matter; the order
of rows and partitions changes nothing; an empty table gives an empty result; further columns are kept on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosescreen.llm.common import fresh
from dosescreen.session import cut_lineage

NODES = 128
SLACK = 0.001
#: Bytes that a row costs beside its text.
OVERHEAD = 8
#: Slices of the hash inside a cell, and the part of a shard that a key or a cell of one key may have.
SLICES, PIECES = 16, 64
TURN = 1 << 32


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """(node, point, shard): the points in clockwise order; ``point`` is the hash up to which keys arrive there."""
    shard = F.floor(F.col("id") / nodes).cast("int")
    points = spark.range(0, shards * nodes, 1, 1).select(
        shard.alias("shard"), F.pmod(F.xxhash64(F.lit("node"), shard, F.col("id") % nodes), F.lit(TURN)).alias("point"))
    return points.select((F.row_number().over(Window.orderBy("point", "shard")) - 1).alias("node"), "point", "shard")


def arrival(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """(arc, low, high, node): keys with low < hash <= high arrive at ``node``; arcs are cut at multiples of a step, so
    that an equality join finds them."""
    around = Window.orderBy("node")
    points = ring(spark, shards, nodes)
    arcs = points.select("node", F.lag("point", 1, -1).over(around).alias("low"), F.col("point").alias("high"))
    last = points.agg(F.max("point").alias("low")).select(F.lit(0).alias("node"), "low", F.lit(TURN - 1).alias("high"))
    step = step_of(shards, nodes)
    return arcs.unionByName(last).where("high > low").select(
        "node", "low", "high", F.explode(F.sequence(F.floor((F.col("low") + 1) / step), F.floor(F.col("high") / step))).alias("arc"))


def step_of(shards: int, nodes: int) -> int:
    return max(1, TURN // (shards * nodes))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _pieces(rows: DataFrame, total: int, count: int, shards: int) -> DataFrame:
    """``rows`` (id, key, size, part, ...) with ``piece``, 0 for all keys but those that are dealt into pieces."""
    most_bytes, most_rows = max(1.0, total / shards / PIECES), max(1.0, count / shards / PIECES)
    pieces = F.ceil(F.greatest(F.col("n") * F.col("size") / most_bytes, F.col("n") / most_rows)).cast("long")
    # at most 2 x PIECES x shards keys can have more than these parts, so they may be broadcast
    large = cut_lineage(rows.groupBy("key", "size").agg(F.count("*").alias("n")).where("n > 1")
                        .select("key", "size", pieces.alias("pieces")).where("pieces > 1"))
    met = rows.join(F.broadcast(large), ["key", "size"], "left")
    few = met.where("pieces is null").drop("pieces").withColumn("piece", F.lit(0).cast("long"))
    # copies of one row are numbered inside the parts of the written table, and the parts' numbers summed up
    many = met.where("pieces is not null")
    parts = many.groupBy("id", "key", "part").agg(F.count("*").alias("copies")).withColumn(
        "base", F.coalesce(F.sum("copies").over(Window.partitionBy("id", "key").orderBy("part")
                                                .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("copies")
    parts = parts.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("part").alias("_part"), "base")
    inside = F.row_number().over(Window.partitionBy("id", "key", "part").orderBy("size"))
    dealt = many.withColumn("copy", inside).join(
        parts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")))
    return few.unionByName(dealt.withColumn("piece", 1 + F.pmod(F.xxhash64("id", F.col("base") + F.col("copy")), "pieces"))
                           .drop("pieces", "copy", "base", "_id", "_key", "_part"))


def filled(cells: DataFrame, spark: SparkSession, shards: int, nodes: int, capacity: int, slack: float) -> DataFrame:
    """(node, class, slice, shard) of every cell (node, class, slice, load, n): rounds of filling and moving on."""
    points = cut_lineage(ring(spark, shards, nodes).select("node", "shard"))
    count = shards * nodes
    load, room = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), int(capacity * (1 + slack)) + 1)
    ready, placed = set(range(shards)), None
    waiting = cells.select("node", "class", "slice", "load", F.col("node").alias("at"))
    while True:
        # the next point of a shard with room, for every point of the ring
        twice = points.unionByName(points.select((F.col("node") + count).alias("node"), "shard"))
        ahead = F.last(F.when(F.col("shard").isin(sorted(ready)), F.struct("node", "shard")), ignorenulls=True).over(
            Window.orderBy(F.col("node").desc()).rowsBetween(Window.unboundedPreceding, 0))
        nexts = twice.select(F.col("node").alias("at"), ahead.alias("next")).where(F.col("at") < count)
        free = F.create_map(*[F.lit(x) for s in sorted(ready) for x in (s, room[s] - load[s])])
        order = Window.partitionBy("shard").orderBy(F.col("class").desc(), "slice", "node")
        going = (waiting.join(F.broadcast(nexts), "at")
                 .select("node", "class", "slice", "load", (F.col("next.node") % count).alias("at"), "next.shard"))
        sums = F.sum("load").over(order.rowsBetween(Window.unboundedPreceding, 0))
        # a shard without anything takes its first key, however large
        none = F.col("shard").isin([s for s in sorted(ready) if not load[s]]) & (F.row_number().over(order) == 1)
        going = cut_lineage(going.withColumn("stays", (sums <= F.element_at(free, F.col("shard"))) | none))
        state = going.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("load"))).alias("got"),
                                           F.count_if(~F.col("stays")).alias("rest")).collect()
        for row in state:  # one row a shard
            load[row["shard"]] += row["got"] or 0
            if row["rest"]:
                ready.discard(row["shard"])
        stays = going.where("stays").select("node", "class", "slice", "shard")
        placed = stays if placed is None else placed.unionByName(stays)
        if not any(row["rest"] for row in state):
            return placed
        waiting = going.where("not stays").select("node", "class", "slice", "load", "at")
        if not ready:  # what is left is small and fits nowhere: one more of these for each shard
            extra = waiting.agg(F.max("load")).first()[0]
            room = {s: max(room[s], load[s]) + extra for s in room}
            ready = set(room)


def placed(docs: DataFrame, shards: int, nodes: int = NODES, slack: float = SLACK, id_col: str = "doc_id",
           text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (the id by default) with size, text_crc32, shard, and slot, gapless from 0 in each shard."""
    spark, columns = docs.sparkSession, (id_col,) if columns is None else columns
    kept = [f"_c{k}" for k in range(len(columns))]
    text = F.col(text_col).cast("string")
    slim = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, kept)], F.col(id_col).cast("string").alias("id"),
                       size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       F.xxhash64(F.lit("key"), text, text.isNull()).alias("key"))
    rows = cut_lineage(slim.withColumn("part", F.spark_partition_id()))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    step = step_of(shards, nodes)
    keyed = (_pieces(rows, total, count, shards)
             .withColumn("h", F.pmod(F.xxhash64("key", "piece"), F.lit(TURN)))
             .withColumn("arc", F.floor(F.col("h") / step)))
    keyed = (keyed.join(F.broadcast(arrival(spark, shards, nodes)), "arc").where("h > low and h <= high")
             .withColumn("class", F.floor(F.log2("size")).cast("int"))
             .withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "h"), F.lit(SLICES)).cast("int")))
    keyed = cut_lineage(keyed.select(*kept, "id", "size", "text_crc32", "key", "h", "node", "class", "slice"))
    cells = cut_lineage(keyed.groupBy("node", "class", "slice").agg(F.sum("size").alias("load"), F.count("*").alias("n")))
    where = filled(cells, spark, shards, nodes, -(-total // shards), slack)
    before = Window.partitionBy("shard").orderBy("node", "class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    where = cut_lineage(where.join(cells, ["node", "class", "slice"]).withColumn(
        "base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("load", "n"))
    inside = Window.partitionBy("node", "class", "slice").orderBy("h", "key", "id")
    return keyed.join(where, ["node", "class", "slice"]).select(
        *[F.col(k).alias(c) for c, k in zip(columns, kept)], "size", "text_crc32", "shard",
        (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, nodes: int = NODES, slack: float = SLACK, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write ``docs`` as one folder a shard, in the order of the slots, and read them back with shard and slot."""
    shard, slot = fresh(docs, "shard", "slot")
    found = placed(docs, shards, nodes, slack, id_col, text_col, tuple(docs.columns))
    found = found.toDF(*docs.columns, "_size", "_crc", shard, slot).drop("_size", "_crc")
    found.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)
