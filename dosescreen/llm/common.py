"""What several operators share: shipping of task code, connected components, bounded block pairs."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.cloudpickle import dumps, register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosescreen.session import cut_lineage

#: Members of a group that one task compares with each other at once; larger groups are dealt into blocks of this size.
BLOCK = 4096


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value, so that executors need no copy of this library."""
    register_pickle_by_value(sys.modules[module])


ship(__name__)


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast ``value`` with its classes; a task gets it by :func:`received`. For values of bounded size."""
    return spark.sparkContext.broadcast(dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it, so that working columns replace none."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def components(links: DataFrame, broadcast: bool = True) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): one row (vertex, component) for each linked vertex.

    ``component`` is the smallest vertex reachable. Every round each vertex takes the smallest label of its neighbours
    and then the label of that label, so that long chains shrink quickly. Minima combine in the map tasks, and both
    sides of the joins are written tables, whose hot keys Spark can split. Links with a NULL end and loops link nothing.
    ``broadcast=False`` keeps Spark from broadcasting labels, for vertices whose files are much smaller than their rows.
    """
    def side(table: DataFrame) -> DataFrame:
        return table if broadcast else table.hint("merge")

    ends = links.select("a", "b").where("a <> b")
    both = cut_lineage(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                        .withColumnRenamed("a", "vertex"))
    while not both.isEmpty():
        heard = (both.join(side(state.select(F.col("vertex").alias("b"), "label")), "b")
                 .groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("heard")))
        near = state.join(side(heard), "vertex").select("vertex", F.col("label").alias("old"),
                                                        F.least("label", "heard").alias("near"))
        roots = state.select(F.col("vertex").alias("near"), F.col("label").alias("root"))
        moved = cut_lineage(near.join(side(roots), "near").select("vertex", "old", F.least("near", "root").alias("label")))
        state = moved.select("vertex", "label")
        if moved.where("label <> old").isEmpty():
            break
    return state.withColumnRenamed("label", "component")


def block_pairs(members: DataFrame, count: str, spread, block: int = BLOCK) -> DataFrame:
    """Add ``pair`` and ``own``: members of a group meet in groups (key, pair) of at most about two blocks.

    ``count`` names the column with the group's size and ``spread`` is a hash of the member. A group of up to ``block``
    members has the single pair 0. A larger one is dealt into blocks, and each member is repeated once per block, so
    that every two blocks meet in exactly one group and no task holds more than two blocks. ``own`` is the member's block.
    """
    return (members.withColumn("_n", F.ceil(F.col(count) / block).cast("int"))
            .withColumn("own", F.pmod(spread, F.col("_n")).cast("int"))
            .withColumn("pair", F.explode(F.when(F.col("_n") <= 1, F.array(F.lit(0))).otherwise(F.transform(
                F.sequence(F.lit(0), F.col("_n") - 1),
                lambda j: F.least(j, F.col("own")) * F.col("_n") + F.greatest(j, F.col("own"))))))
            .drop("_n"))


class Forest:
    """Union-find over the ids that a task has linked; tells which links join something new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x] = top
            x = above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def runs(batches: Iterator, keys: int) -> Iterator[list[np.ndarray]]:
    """Cut sorted batches of numeric columns into pieces that hold whole groups; the first ``keys`` columns are the key.

    A piece has the rows of one batch and the rest of the group that the batch before ended in.
    """
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        same = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = int(np.argmax(same))
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None:
        yield rest
