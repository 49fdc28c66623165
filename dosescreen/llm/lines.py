"""Repeated lines, paragraphs or sentences: the earliest occurrence stays, later ones go.

Texts are cut into units, which are normalised (lower case, single spaces) and known by a 128-bit digest. Digests are
counted over all documents with map-side combining; those that repeat are written and joined back to the occurrences,
both as plain tables, so that Spark can split a digest that a third of all units has. Offsets are code points of the
original text.

A passage pasted into longer lines repeats no whole line. :func:`passages` therefore takes sentences, and reports the runs of
neighbouring sentences that other documents have: a short sentence is common, a run of ``RUN`` words is a passage.

Defined results: NULL and empty texts have no units; units of fewer than ``least`` words are never removed, which by
default are blank ones alone; occurrences rank by id (NULL last), text, then place; rows that repeat id and text are one
document and keep or lose a unit together, rows that share an id or have none but differ in the text are judged each by
itself (by :func:`passages` every row is a document of its own); an empty table gives an empty result; further columns are
ignored or, by :func:`removed`, kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.llm.common import fresh, runs, ship
from dosescreen.session import cut_lineage

ship(__name__)

UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*"),
         "sentence": re.compile(r"[^\n.!?]+")}
LAST = (1 << 63) - 1
#: Words of neighbouring sentences that make a repeated passage.
RUN = 25
#: A document: its id, and two hashes of its text that tell rows of one id apart.
DOC = ["id", "r1", "r2"]


def units(text: str | None, unit: str = "line", least: int = 1) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units with at least ``least`` words."""
    for found in UNITS[unit].finditer(text or ""):
        words = found[0].lower().split()
        if len(words) >= least:
            yield found.start(), found.end(), len(words), xxhash.xxh3_128_digest(" ".join(words))


def _cut(docs: DataFrame, unit: str, least: int, totals: bool = False) -> DataFrame:
    """The columns of ``docs`` but the last, which is the text, for each unit, with place, first, last, words, digest.

    ``place`` counts a text's units. With ``totals`` each text has one more row, with place -1 and its number of units as
    words.
    """
    keys = docs.columns[:-1]
    names = [*keys, "place", "first", "last", "words", "digest"]
    kinds = [pa.int64()] * len(keys) + [pa.int32()] * 4 + [pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for *key, t in zip(*(batch.column(k).to_pylist() for k in range(len(keys))), batch.column(len(keys))):
                n = len(found)
                found.extend((*key, k, *u) for k, u in enumerate(units(t.as_py(), unit, least)))
                if totals:
                    found.append((*key, -1, 0, 0, len(found) - n, None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    schema = [*(f"{k} long" for k in keys), "place int", "first int", "last int", "words int", "digest binary"]
    return docs.mapInArrow(work, ", ".join(schema))


def occurrences(docs: DataFrame, unit: str = "line", least: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(id, r1, r2, place, first, last, words, digest) of the units of all texts; ``place`` counts a text's units."""
    text = F.col(text_col).cast("string")
    return _cut(docs.select(F.col(id_col).cast("long").alias("id"), *_hashes(text), text.alias("text")), unit, least)


def _hashes(text) -> list:
    return [F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def _rank():
    """The rank of an occurrence; the earliest one stays."""
    return F.struct(F.coalesce("id", F.lit(LAST)).alias("rank"), "r1", "r2", "first")


def _earliest(found: DataFrame) -> DataFrame:
    """(digest, kept): the smallest rank of the digests that occur more than once."""
    return cut_lineage(found.groupBy("digest").agg(F.min(_rank()).alias("kept"), F.count("*").alias("n"))
                       .where("n > 1").drop("n"))


def repeats(docs: DataFrame, unit: str = "line", least: int = 1, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, r1, r2, first, last, kept_id, kept_first) of every unit to remove and of the occurrence that stays."""
    found = cut_lineage(occurrences(docs, unit, least, id_col, text_col))
    return found.join(_earliest(found), "digest").where(_rank() != F.col("kept")).select(
        *DOC, "first", "last", F.nullif(F.col("kept.rank"), F.lit(LAST)).alias("kept_id"),
        F.col("kept.first").alias("kept_first"))


def _runs(run: int):
    """Rows (row, place, id, first, last, words, later), sorted by the first two; place -1 has the number of units."""
    names = ["id", "units", "repeated_units", "later_units", "longest_run", "spans"]

    def tops(values: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(breaks)
        return starts, np.add.reduceat(values, starts) if len(starts) else values[:0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, place, ids, first, last, words, later in runs(batches, 1):
            head = np.flatnonzero(place < 0)
            of = np.cumsum(place < 0) - 1  # the document of each row
            unit = np.flatnonzero(place >= 0)
            d, w, gone, n = of[unit], words[unit].astype(np.int64), later[unit].astype(bool), len(head)
            longest = np.zeros(n, np.int64)
            # neighbours are next to each other in their text
            apart = np.ones(len(unit), bool)
            apart[1:] = (np.diff(d) != 0) | (np.diff(place[unit]) != 1)
            start, size = tops(w, apart)
            np.maximum.at(longest, d[start], size)
            dg, pg, wg, fg, lg = d[gone], place[unit][gone], w[gone], first[unit][gone], last[unit][gone]
            apart = np.ones(len(dg), bool)
            apart[1:] = (np.diff(dg) != 0) | (np.diff(pg) != 1)
            start, size = tops(wg, apart)
            end = np.append(start[1:], len(dg)) - 1
            wide = size >= run
            spans: list[list] = [[] for _ in range(n)]
            for k, a, b in zip(dg[start[wide]].tolist(), fg[start[wide]].tolist(), lg[end[wide]].tolist()):
                spans[k].append({"first": a, "last": b})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[head]), pa.array(words[head].astype(np.int64)),
                 pa.array(np.bincount(d, minlength=n)), pa.array(np.bincount(dg, minlength=n)), pa.array(longest),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names)

    return work


def passages(docs: DataFrame, unit: str = "sentence", run: int = RUN, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, units, repeated_units, later_units, longest_run, spans).

    ``repeated_units`` are those that another document has too, ``later_units`` of them not the earliest occurrence;
    ``longest_run`` is the largest number of words in neighbouring repeated units; ``spans`` are the runs of later units of
    at least ``run`` words.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    found = cut_lineage(_cut(slim, unit, 1, totals=True))
    rank = F.struct(F.coalesce("id", F.lit(LAST)).alias("rank"), "row", "first")
    earliest = cut_lineage(found.where("place >= 0").groupBy("digest").agg(
        F.min(rank).alias("kept"), F.max(F.struct(F.coalesce("id", F.lit(LAST)).alias("rank"), "row")).alias("last_doc"))
        .where("kept.row <> last_doc.row").drop("last_doc"))
    columns = ["row", "place", F.coalesce("id", F.lit(LAST)).alias("id"), "first", "last", "words"]
    met = found.join(earliest, "digest").select(*columns, (rank != F.col("kept")).cast("int").alias("later"))
    heads = found.where("place < 0").select(*columns, F.lit(0).alias("later"))
    spans = "array<struct<first:int,last:int>>"
    found = met.unionByName(heads).repartition("row").sortWithinPartitions("row", "place").mapInArrow(
        _runs(run), f"id long, units long, repeated_units long, later_units long, longest_run long, spans {spans}")
    return found.withColumn("id", F.nullif("id", F.lit(LAST)))


def removed(docs: DataFrame, unit: str = "line", least: int = 1, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``docs`` without repeated units and the line breaks after them."""
    held = fresh(docs, "_line_id", "_line_r1", "_line_r2", "_r1", "_r2", "_spans")
    spans = repeats(docs, unit, least, id_col, text_col).select(*DOC, "first", "last").distinct().groupBy(*DOC).agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias(held[5])).withColumnsRenamed(dict(zip(DOC, held)))
    marked = docs.select("*", *[h.alias(n) for h, n in zip(_hashes(F.col(text_col).cast("string")), held[3:])])
    same = (marked[id_col].cast("long").eqNullSafe(spans[held[0]]) & (marked[held[3]] == spans[held[1]])
            & (marked[held[4]] == spans[held[2]]))
    joined = marked.join(spans, same, "left")
    order, at = docs.columns, docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(order))):
                text, pieces, start = text.as_py(), [], 0
                for span in spans.as_py() or ():
                    pieces.append(text[start:span["first"]])
                    start = span["last"] + (text[span["last"]:span["last"] + 1] == "\n")
                texts.append(text if text is None else "".join([*pieces, text[start:]]))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, order)

    return joined.select(*[marked[c] for c in order], held[5]).mapInArrow(work, docs.schema)
