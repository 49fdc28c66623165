"""Repeated passages through a sparse suffix array.

Suffixes are kept only at minimiser positions: a place whose hash of ``GRAM`` words is the smallest of some ``WINDOW``
consecutive ones. Every run of ``PASSAGE`` words has such a place, and equal runs have it at the same word. A suffix is
represented by the words around its place, ``LEFT`` before and ``PASSAGE`` from it on: a longer match is certified piece
by piece by its next places.

Places whose first words occur once are dropped by a count. Equal surroundings are one suffix with a weight, and match in
full. The others are sorted by (first words, words to the right, words to the left) in range partitions, and neighbours
are extended to the right and to the left; the first and last suffix of every partition meet in one small pass. The same
is done once more with the words to the left before those to the right. Matches of at least ``PASSAGE`` words are joined back to all places and merged into spans of words.

Defined results: words are separated by ASCII white space and compared as they are; NULL, empty and shorter texts have no
spans; repeats inside one document count; a document is known by id and text, so rows that repeat both are one document in
the result and repeat all their passages, and rows that share an id or have none have spans of their own for each text; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.llm.common import ship
from dosescreen.session import cut_lineage

ship(__name__)

PASSAGE = 50
GRAM = 8
LAST = (1 << 63) - 1
#: A document: its id, and a hash of its text that tells rows of one id, or without id, apart.
DOC = ["id", "r"]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STORE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64."""
    if base not in STORE or len(STORE[base]) < n:
        size = max(1 << 16, 2 * n)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        STORE[base] = np.multiply.accumulate(factors)
    return STORE[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end) of ``values``, from one running sum."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * powers(INVERSE, len(values) + 1)[starts])


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    return rolled(raw.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64)


def slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every window, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = pick(values[:-step], values[step:])
        span += step
    return values


def places(text: bytes, passage: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(word hashes, places, hashes of their first words, hashes of their surroundings, words left, words right)."""
    hashes = word_hashes(text)
    none = np.zeros(0, np.int64)
    if len(hashes) < passage:
        return hashes, none, none, none, none, none
    window, n = passage - gram + 1, len(hashes)
    at = np.arange(n - gram + 1)
    grams = rolled(hashes, at, at + gram)
    least = slid(grams, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(slid(np.concatenate((pad, least, pad)), window, np.maximum) == grams)
    start, end = np.maximum(at - (window - 1), 0), np.minimum(at + passage, n)
    around = rolled(hashes, start, end) ^ mixed(((at - start) * 4096 + (end - at)).astype(np.uint64))
    return hashes, at, grams[at].view(np.int64), around.view(np.int64), at - start, end - at


def _anchors(passage: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for (i, r), text in zip(keys, batch.column(2).cast(pa.large_binary())):
                _, at, first, around, left, right = places(text.as_py() or b"", passage, gram)
                found.append((np.full(len(at), i), np.full(len(at), r), at, first, around, left, right))
            if found:
                columns = [pa.array(np.concatenate(c), k) for c, k in zip(
                    zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int16(), pa.int16()))]
                yield pa.RecordBatch.from_arrays(columns, [*DOC, "at", "first", "around", "lefts", "rights"])

    return work


def _content(passage: int, gram: int):
    """Words around the wanted places of a text, as fixed-width big-endian hashes, so that bytes sort like words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).cast(pa.large_binary()), batch.column(1)):
                hashes, at, first, around, left, right = places(text.as_py() or b"", passage, gram)
                short = (hashes >> np.uint64(32)).astype(">u4")
                known = {int(p): k for k, p in enumerate(at)}
                for w in wanted.as_py():
                    k = known.get(w["at"])
                    # texts with one hash
                    if k is None or (int(first[k]), int(around[k])) != (w["first"], w["around"]):
                        continue
                    p, l, r = int(at[k]), int(left[k]), int(right[k])
                    rows.append((w["first"], w["around"], l, r, short[p:p + r].tobytes().ljust(4 * passage, b"\0"),
                                 short[p - l:p][::-1].tobytes().ljust(4 * passage, b"\0")))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["first", "around", "lefts", "rights", "right", "left"])

    return work


def _common(words: list[bytes], size: np.ndarray) -> np.ndarray:
    """How many words neighbours have in common, from the start."""
    table = np.frombuffer(b"".join(words), ">u4").reshape(len(words), -1)
    differ = table[1:] != table[:-1]
    count = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    return np.minimum(count, np.minimum(size[1:], size[:-1]))


EXTENT = ["first", "around", "lefts", "rights"]
FIELDS = "first long, around long, lefts short, rights short, right binary, left binary"


def _neighbours(passage: int):
    """Matches of neighbouring suffixes, and (``edge``) the first and last suffix of the partition."""
    names = ["first", "around", "lefts", "rights", "right", "left", "edge"]

    def marked(batch: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([edge] * batch.num_rows)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield marked(batch.slice(0, 1), True)
            else:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = batch.slice(batch.num_rows - 1, 1)
            first, around, lefts, rights = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            right = _common(batch.column(4).to_pylist(), rights)
            left = _common(batch.column(5).to_pylist(), lefts)
            hit = np.flatnonzero((first[1:] == first[:-1]) & (right + left >= passage))
            if len(hit):
                both = np.concatenate((hit, hit + 1))
                none = pa.nulls(len(both), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[both]), pa.array(around[both]), pa.array(np.tile(left[hit], 2), pa.int16()),
                     pa.array(np.tile(right[hit], 2), pa.int16()), none, none, pa.array([False] * len(both))], names)
        if last is not None:
            yield marked(last, True)

    return work


def passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, spans): the spans (start, end) of words, end excluded, that occur at least twice in the corpus."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("r"), text.alias("text"))
    found = cut_lineage(slim.mapInArrow(_anchors(passage, gram), "id long, r long, at int, first long, around long, "
                                                                 "lefts short, rights short"))
    shared = cut_lineage(found.groupBy("first").count().where("count > 1").select("first"))
    live = cut_lineage(found.join(shared, "first"))
    suffixes = cut_lineage(live.groupBy("first", "around").agg(
        F.count("*").alias("n"), F.min(F.struct(*DOC, "at")).alias("at"), F.first("lefts").alias("lefts"),
        F.first("rights").alias("rights")))
    several = cut_lineage(suffixes.groupBy("first").count().where("count > 1").select("first"))
    wanted = (suffixes.join(several, "first").select("at.id", "at.r", F.struct("at.at", "first", "around").alias("place"))
              .groupBy(*DOC).agg(F.collect_list("place").alias("places")))
    content = cut_lineage(slim.join(wanted, DOC).select("text", "places").mapInArrow(_content(passage, gram), FIELDS))
    # the best partner of a suffix is its neighbour by what follows or by what comes before
    matched = suffixes.where((F.col("n") > 1) & (F.col("lefts") + F.col("rights") >= passage))
    for order in (["first", "right", "left"], ["first", "left", "right"]):
        step = cut_lineage(content.repartitionByRange(*order, "around").sortWithinPartitions(*order)
                           .mapInArrow(_neighbours(passage), FIELDS + ", edge boolean"))
        edges = (step.where("edge").drop("edge").coalesce(1).sortWithinPartitions(*order)
                 .mapInArrow(_neighbours(passage), FIELDS + ", edge boolean"))
        matched = matched.select(*EXTENT).union(step.union(edges).where("not edge").select(*EXTENT))
    matched = cut_lineage(matched.distinct())
    spans = (live.select(*DOC, "at", "first", "around").join(matched, ["first", "around"])
             .select(*DOC, F.struct((F.col("at") - F.col("lefts")).alias("start"),
                                    (F.col("at") + F.col("rights")).alias("end")).alias("span"))
             .groupBy(*DOC).agg(F.array_sort(F.collect_set("span")).alias("spans")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(
        "spans", empty, lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    return spans.select(F.nullif("id", F.lit(LAST)).alias("id"), merged.alias("spans"))
