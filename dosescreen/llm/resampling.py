"""Importance resampling towards a target: hashed word features, log ratio weights, exact draw without replacement.

Words and runs of words are hashed into buckets, counted over all documents and all target texts (one short array a task,
summed by Spark), and give an array of gains, one for each bucket. A document's weight is the sum of the gains of its
features; a hashed Gumbel variable of its id makes the highest scores a draw without replacement by weight.

The cutoff is found by weighted median-of-medians selection: every task gives the median of its remaining keys and their
number, the median of these weighted by the numbers is the pivot, and at least about a quarter of all keys lies on either
side of it. The side without the cutoff is discarded, the rest written, and so on until ``FINISH`` keys at most are
left, which one task sorts. Keys are distinct, so the cutoff is one row. The winners alone are sorted, by ranges.

Defined results: a NULL or empty text has no words, weight 0 and is never drawn; a NULL id is hashed as the empty text and
comes last among equal scores; of rows that tie in score and id those with fewer features come first, and rows equal in
these are alike but for columns that were asked for; without target texts the gains still follow the formula; an empty
table gives an empty result; further columns are ignored unless asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dosescreen.llm.common import fresh, received, send, ship
from dosescreen.session import cut_lineage

ship(__name__)

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
#: Share of the eligible documents to draw, in hundredths.
PERCENT = 10
#: Features whose buckets a task remembers.
REMEMBERED = 200_000
#: Keys that are few enough to be sorted by one task.
FINISH = 4096
#: Digits, letters (A-Z in lower case) and bytes of other characters stay; everything else parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Hashed:
    """The buckets of a text's features; those of frequent ones are remembered."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.seen = buckets, longest, {}

    def __call__(self, text: bytes | None) -> tuple[int, list[int]]:
        """The number of words, and the bucket of each run of 1 to ``longest`` words."""
        words = (text or b"").translate(WORDS).split()
        runs = words if self.longest == 1 else [b" ".join(words[k:k + n]) for n in range(1, self.longest + 1)
                                                for k in range(len(words) - n + 1)]
        seen, buckets, found = self.seen, self.buckets, []
        for run in runs:
            bucket = seen.get(run)
            if bucket is None:
                bucket = crc32(run) % buckets
                if len(seen) < REMEMBERED:
                    seen[run] = bucket
            found.append(bucket)
        return len(words), found


def counted(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket; one row a bucket comes to the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sums = Hashed(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                found = hashed(text.as_py())[1]
                if found:
                    sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "bucket long, n long")
    sums = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share in the target and in the documents."""
    n, all_raw, all_target = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_raw / ((float(raw[b]) + 1) * all_target)))
                     for b in range(n)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
           seed: int = SEED, columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of ``docs`` with n_words, n_features, weight and score."""
    shared, buckets, width = send(docs.sparkSession, gain), len(gain), len(columns)
    slim = docs.select(*[f"`{c}`" for c in columns], F.col(id_col).cast("long").alias("n_words"),
                       F.col(text_col).cast("string").alias("n_features"))
    names = ["n_words", "n_features", "weight", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, hashed = received(shared), Hashed(buckets, longest)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(width).to_pylist(), batch.column(width + 1).cast(pa.large_binary())):
                n, found = hashed(text.as_py())
                weight = int(gain[found].sum()) if found else 0
                rows.append((n, len(found), weight, weight + gumbel(doc_id, seed)))
            added = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], [*batch.schema.names[:width], *names])

    kept = slim.select(*[f"`{c}`" for c in columns]).schema.fields
    return slim.mapInArrow(work, StructType([*kept, *[StructField(n, LongType()) for n in names]]))


def _median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower median of a task's keys (rows of whole numbers, by column), and their number."""
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if parts:
        keys = np.concatenate(parts, 1)
        at = np.lexsort(keys[::-1])[(keys.shape[1] - 1) // 2]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in [*keys[:, at].tolist(), keys.shape[1]]],
                                         [*(f"k{i}" for i in range(len(keys))), "n"])


def before(keys: list[str], cut: tuple[int, ...]) -> Column:
    """Whether a row's key is at most ``cut``, column by column."""
    found = F.lit(True)
    for name, value in reversed(list(zip(keys, cut))):
        found = (F.col(name) < value) | ((F.col(name) == value) & found)
    return found


def cutoff(rows: DataFrame, keys: list[str], place: int, finish: int = FINISH) -> tuple[int, ...]:
    """The key that has ``place`` - 1 smaller ones. ``rows`` is a written table; keys are distinct, without NULL."""
    schema = ", ".join(f"k{i} long" for i in range(len(keys))) + ", n long"
    rest = rows.select(keys)
    left = rest.count()
    while left > finish:
        # one row for each task that has keys
        medians = sorted(tuple(r) for r in rest.mapInArrow(_median, schema).collect())
        half, seen = left / 2, 0
        for *key, n in medians:
            seen += n
            if seen >= half:
                break
        low = rest.where(before(keys, key))
        smaller = low.count()
        if place <= smaller:
            rest, left = low, smaller
        else:
            rest, left, place = rest.where(~before(keys, key)), left - smaller, place - smaller
        rest = cut_lineage(rest)
    return tuple(rest.orderBy(*keys).limit(place).collect()[-1])


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS,
              buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id",
              text_col: str = "text", columns: tuple[str, ...] | None = None, finish: int = FINISH) -> DataFrame:
    """``columns`` of ``docs`` (the id by default) with n_words, n_features, weight, score and rank.

    ``rank`` counts the drawn documents from 1 on by score; it is NULL for all others.
    """
    columns = (id_col,) if columns is None else columns
    gain = gains(counted(docs, text_col, buckets, longest), counted(target, text_col, buckets, longest))
    id_name, = fresh(docs, "_id")
    asked = [*columns, id_name]
    slim = scored(docs.withColumn(id_name, F.col(id_col).cast("long")), gain, id_name, text_col, longest, seed, tuple(asked))
    keys = fresh(slim, "_k_score", "_k_none", "_k_id", "_k_size", "_k_row")
    rows = cut_lineage(slim.select(
        "*", (-F.col("score")).alias(keys[0]), F.col(id_name).isNull().cast("long").alias(keys[1]),
        F.coalesce(id_name, F.lit(0).cast("long")).alias(keys[2]), F.col("n_features").alias(keys[3]),
        F.monotonically_increasing_id().alias(keys[4])))
    eligible = F.col("n_words") >= least
    drawn = rows.where(eligible).count() * percent // 100
    shown = [*[f"`{c}`" for c in columns], "n_words", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    wins = eligible & before(keys, cutoff(rows.where(eligible), keys, drawn, finish))
    part, offset = fresh(rows, "_part", "_offset")
    winners = cut_lineage(rows.where(wins).repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    offsets = winners.groupBy(part).agg(F.count("*").alias(offset)).withColumn(
        offset, F.coalesce(F.sum(offset).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*keys))
    ranked = winners.join(offsets, part).withColumn("rank", (F.col(offset) + inside).cast("long"))
    return ranked.select(*shown, "rank").unionByName(rows.where(~wins).select(*shown, F.lit(None).cast("long").alias("rank")))
