"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into three segments. Of four differing bits some segment gets at most one (else there would be
six), so two linked fingerprints agree in a segment but for one bit: they share the variant of that segment in which
this bit is a wildcard. Each fingerprint is indexed under its 64 one-wildcard variants, fingerprints meet by equality of
variants, and every meeting is verified by its Hamming distance.

Equal fingerprints are one entry of the index. Within a variant a task emits only links that join something new, so a
group of near copies costs about as many links as it has members; a variant with more than :data:`~common.BLOCK`
fingerprints is dealt into blocks that meet in pairs.

Defined results: a NULL, empty or blank text has fingerprint zero and links like any other; texts of fewer words than a
shingle are one shingle; rows that repeat an id are rows of their own with the same id; NULL ids count towards no
smallest id, and :func:`keep_one` keeps a row without id if its group has no other row, or one row if none of them has an
id; an empty table gives an empty result; further columns are ignored or, by :func:`keep_one`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dosescreen.llm.common import BLOCK, Forest, block_pairs, components, fresh, runs, ship
from dosescreen.session import cut_lineage

ship(__name__)

SEGMENTS = (22, 21, 21)
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: The bits of each byte value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLANES = np.arange(8, dtype=np.int64) * 256
#: Groups up to this size are compared by shifting whole batches against themselves.
SMALL = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the hashes of a text's word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in
                       zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())], "<u8")
    planes = hashes.view(np.uint8).reshape(-1, 8) + PLANES
    ones = np.einsum("pv,vb->pb", np.bincount(planes.ravel(), minlength=2048).reshape(8, 256), BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as signed 64-bit number), one row for each row of ``docs``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            marks = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["id", "mark"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(work, "id long, mark long")


def variants(mark: Column) -> Column:
    """The 64 one-wildcard segment variants of a fingerprint, each tagged with its wildcard's place."""
    keys, low = [], 0
    for width in SEGMENTS:
        value = F.shiftrightunsigned(mark, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            kept = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(kept.bitwiseOR(F.lit((low + bit) << 22)))
        low += width
    return F.array(*keys)


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most


def _spanning(marks: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over distinct fingerprints: each is compared with those not reached yet."""
    todo = marks
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            near = _close(todo, at, most)
            for other in todo[near]:
                yield int(at), int(other)
            front.extend(todo[near])
            todo = todo[~near]


def _link(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for key, pair, marks in runs(batches, 2):
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            size = np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), size)
            small = np.repeat(size <= SMALL, size)
            found = []
            for shift in range(1, int(size[size <= SMALL].max(initial=0))):
                hit = (group[shift:] == group[:-shift]) & small[shift:]
                hit &= _close(marks[shift:], marks[:-shift], most)
                found.extend(zip(marks[:-shift][hit].tolist(), marks[shift:][hit].tolist()))
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                found.extend(_spanning(marks[s:s + n], most))
            new = [(a, b) for a, b in found if forest.join(a, b)]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new)], ["a", "b"])

    return work


def links(marks: DataFrame, most: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``mark``) that keep every component whole."""
    if most > DISTANCE:
        raise ValueError("three segments with one wildcard find at most four differing bits")
    keyed = marks.select("mark", F.explode(variants(F.col("mark"))).alias("key"))
    hot = cut_lineage(keyed.groupBy("key").count().where(F.col("count") > block))
    met = block_pairs(keyed.join(hot, "key", "left").withColumn("count", F.coalesce("count", F.lit(1))), "count",
                      F.xxhash64("mark"), block)
    return (met.select("key", "pair", "mark").repartition("key", "pair").sortWithinPartitions("key", "pair", "mark")
            .mapInArrow(_link(most), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE,
                    shingle: int = SHINGLE) -> DataFrame:
    """(id, mark, component), one row for each row of ``docs``; ``component`` is the smallest id of the linked group."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    marks = cut_lineage(rows.groupBy("mark").agg(F.min("id").alias("first")))
    groups = components(links(marks, most))
    owned = marks.join(groups, marks["mark"] == groups["vertex"], "left").select(
        "mark", "first", F.coalesce("component", "mark").alias("group"))
    owned = cut_lineage(owned)
    least = cut_lineage(owned.groupBy("group").agg(F.min("first").alias("component")))
    named = cut_lineage(owned.join(least, "group").select("mark", "component"))
    return rows.join(named, "mark").select("id", "mark", "component")


def hexadecimal(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def keep_rows(rows: DataFrame, mark: str, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with the smallest id of every group of linked fingerprints; of a group without ids one row.

    ``rows`` is a written table whose column ``mark`` holds the fingerprint, and ``groups`` has the ``component`` of each
    linked fingerprint (``vertex``). Rows of one group that share an id stay or go together.
    """
    group, least, count = fresh(rows, "_group", "_first", "_n")
    own = F.col(id_col).cast("long")
    marks = cut_lineage(rows.groupBy(mark).agg(F.min(own).alias(least), F.count("*").alias(count)))
    owned = cut_lineage(marks.join(groups, marks[mark] == groups["vertex"], "left").select(
        mark, least, count, F.coalesce("component", mark).alias(group)))
    firsts = cut_lineage(owned.groupBy(group).agg(F.min(least).alias(least), F.sum(count).alias(count))
                         .where(F.col(count) > 1).drop(count))
    named = cut_lineage(owned.select(mark, group).join(firsts, group))
    # the groups grow with the documents, so their table is never broadcast
    joined = rows.join(named.hint("merge"), mark, "left")
    stay = joined.where(F.col(group).isNull() | (own == F.col(least))).select(rows.columns)
    # combined in the map tasks
    lone = joined.where(F.col(group).isNotNull() & F.col(least).isNull()).groupBy(group).agg(
        F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("row")).select("row.*")
    return stay.unionByName(lone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = DISTANCE,
             shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the smallest id of every group of near-duplicates; of a group without ids one row."""
    at, (mark,) = docs.columns.index(text_col), fresh(docs, "_mark")
    names = [*docs.columns, mark]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            marks = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names)

    rows = cut_lineage(docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(mark, LongType())])))
    groups = components(links(rows.select(F.col(mark).alias("mark")).distinct(), most))
    return keep_rows(rows, mark, groups, id_col).select(docs.columns)
