"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors of one label are projected on ``PROJECTIONS`` random directions. Every projection is sorted, and a query's
window in it holds the points within ``WIDTH`` of the query's own projection. Points are counted over all windows; a pair
that collides at least as often as a pair at the threshold does with probability ``RECALL`` is verified by its cosine in
double precision.

Equal vectors are one point with a weight. A label with more points than a block is dealt into blocks that meet in pairs,
so no task holds more than two blocks; collisions are counted and links verified there, and neither leaves the task, only
one row for each linked point does: the rows it links with and one point of its component among these blocks. The number
of windows is fixed, so the work for a label grows with the square of its distinct vectors, in array operations.

A written table can hold many times more rows than its bytes tell, so Spark is kept from broadcasting those that grow with
the input; the sizes that are broadcast are those of labels with more points than a block.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components and vectors without label link
with nothing and are returned with 0 links; vectors without id link like any other, but name no component (one of vectors
without ids only has none, and all of them are kept); vectors of different length have no cosine and do not link; very
small and very large vectors have the cosine of their directions; rows that repeat an id are vectors of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.llm.common import block_pairs, components, ship
from dosescreen.session import cut_lineage

ship(__name__)

COSINE = 0.93
PROJECTIONS = 96
WIDTH = 0.15
RECALL = 0.9995
BLOCK = 2048
SEED = 11


def needed(cosine: float = COSINE, projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``.

    On a random direction such a pair differs by a normal variable whose deviation is its distance.
    """
    p = math.erf(width / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return max(1, count)
    return projections


def scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is about 1 and squares neither vanish nor overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def linked(queries: np.ndarray, points: np.ndarray, cosine: float, projections: int, width: float, least: int,
           after: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of queries, each with the rows of points that collide often enough and have the cosine; ``after``: later ones."""
    queries, points = scaled(queries), scaled(points)
    size = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (queries, points)]
    lines = np.random.default_rng(SEED).standard_normal((queries.shape[1], projections))
    at, among = (queries / size[0][:, None]) @ lines, (points / size[1][:, None]) @ lines
    order = np.argsort(among, axis=0).astype(np.int32)
    low, high = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
    for j in range(projections):
        line = among[order[:, j], j]
        low[:, j] = np.searchsorted(line, at[:, j] - width, "left")
        high[:, j] = np.searchsorted(line, at[:, j] + width, "right")
    order = np.ascontiguousarray(order.T)
    for q in range(len(queries)):
        window = [row[a:b] for row, a, b in zip(order, low[q].tolist(), high[q].tolist())]
        met = np.flatnonzero(np.bincount(np.concatenate(window), minlength=len(points)) >= least)
        if after:
            met = met[met > q]
        met = met[points[met] @ queries[q] >= cosine * size[1][met] * size[0][q]]
        if len(met):
            yield q, met


def gathered(links: Iterable[tuple[int, np.ndarray]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the weight of the rows it links with, and the first row of its component; each link comes once."""
    others, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for q, met in links:
        others[q] += weight[met].sum()
        others[met] += weight[q]
        near = np.append(root[met], root[q])
        first = near.min()
        if (near != first).any():
            root[near] = first
            root = root[root]
    return others, root


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, width: float = WIDTH,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id, label, embedding)."""
    usable = (F.col("label").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("v", lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label",
                          F.col("embedding").cast("array<double>").alias("v")).withColumn(
        "kind", F.when(usable, F.struct("label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"),
                                        F.size("v").alias("width"))))
    points = cut_lineage(rows.where("kind is not null").groupBy("kind")
                         .agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("v").alias("v"))
                         .withColumn("point", F.monotonically_increasing_id()))
    group = F.struct("kind.label", "kind.width")
    large = cut_lineage(points.groupBy(group.alias("group")).agg(F.count("*").alias("members"))
                        .where(F.col("members") > block))
    dealt = block_pairs(points.select("point", "weight", "v", group.alias("group")).join(large, "group", "left")
                        .withColumn("members", F.coalesce("members", F.lit(1))), "members", F.xxhash64("point"), block)
    least = needed(cosine, projections, width, recall)

    def work(part: pa.Table) -> pa.Table:
        own = part.column("own").to_numpy()
        ids = part.column("point").to_numpy()
        order = np.lexsort((ids, own))
        own, ids, weight = own[order], ids[order], part.column("weight").to_numpy()[order]
        flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), -1)[order]
        cut = np.flatnonzero(own != own[0])
        pair = part.column("pair")[0].as_py()
        links: Iterable[tuple[int, np.ndarray]] = ()  # if the other block of this pair is empty
        if len(cut):
            links = linked(v[:cut[0]], v[cut[0]:], cosine, projections, width, least, False)
            links = ((q, met + cut[0]) for q, met in links)
        elif pair % (part.column("blocks")[0].as_py() + 1) == 0:
            links = linked(v, v, cosine, projections, width, least, True)
        others, root = gathered(links, weight)
        met = np.flatnonzero(others)
        return pa.table({"point": pa.array(ids[met], pa.int64()), "others": pa.array(others[met], pa.int64()),
                         "root": pa.array(ids[root[met]], pa.int64())})

    dealt = dealt.withColumn("blocks", F.greatest(F.ceil(F.col("members") / block), F.lit(1)).cast("long"))
    shares = cut_lineage(dealt.select("group", "pair", "own", "blocks", "point", "weight", "v").groupBy("group", "pair")
                         .applyInArrow(work, "point long, others long, root long"))
    degree = shares.groupBy("point").agg(F.sum("others").alias("others"))
    groups = components(shares.select(F.col("point").alias("a"), F.col("root").alias("b")), broadcast=False)
    owned = cut_lineage(points.select("kind", "point", "first", "weight").join(degree.hint("merge"), "point", "left")
                        .join(groups.withColumnRenamed("vertex", "point").hint("merge"), "point", "left")
                        .select("kind", "first", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                                F.coalesce("component", "point").alias("group")))
    least = cut_lineage(owned.groupBy("group").agg(F.min("first").alias("component")))
    named = cut_lineage(owned.join(least.hint("merge"), "group").select("kind", "n_links", "component"))
    found = rows.select("id", "kind").join(named.hint("merge"), "kind", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("kind").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
