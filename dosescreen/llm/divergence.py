"""How far the sources of a language diverge in their words, with identical texts collapsed first.

Identical texts of a language meet by digest, with the number of copies in each source, and are tokenised once; a text's
counts and document frequencies are weighted by the copies. Every task sends a text once and its copies as numbers, so a
text that a third of all documents have costs one row for each task. A language keeps the terms that enough of its
documents hold; counts are exchanged once, by language and term. Every source, and the language, gives a kept term ``p = 1 + floor(SCALE * (count + 2) /
(N + 2 V))``, and two distributions differ by the sum over the kept terms of ``floor((p - q)^2 / (p + q))``.

Pairs are evaluated on the sparse counts: a term that neither source holds adds the same to the sum, so the sum starts
from V times that, is corrected for the terms of either source by a histogram of its values, and only terms that both hold
are compared. Sources are dealt into blocks that meet in tiles and terms into slices, so that a task streams over one slice
of one tile and holds a square of 2 x ``BLOCK`` sums; no row is made for a pair and a term.

Defined results: a NULL text, language or source is the empty one; repeated rows are documents of their own; a group
without kept terms has count 0 for all; a language without kept terms has distances of 0 and no terms; a language with a
single source has no pairs; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosescreen.llm.common import ship
from dosescreen.session import cut_lineage

ship(__name__)

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Sources that a tile holds on each side, and the slices that the terms of a tile are cut into.
BLOCK, SLICES = 256, 32
#: Texts and terms that a task counts before it hands its sums on.
TEXTS, HELD = 200_000, 600_000
LOW = (1 << 64) - 1
#: Letters stay, A-Z in lower case, as do bytes of other characters; everything else parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def collapsed(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, digest, source, n, text), dealt and sorted by language and digest.

    The first row of a digest has the text; others may repeat it, or have a source and the number of its copies.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    names = ["lang", "digest", "source", "n", "text"]
    kinds = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[tuple[str, bytes], Counter] = {}

        def numbers() -> Iterator[pa.RecordBatch]:
            rows = [(lang, digest, source, n, None) for (lang, digest), held in copies.items() for source, n in held.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            first, digests = [], []
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (lang, source, text) in enumerate(zip(langs, sources, batch.column(2).cast(pa.large_binary()))):
                digest = xxhash.xxh3_128_digest(memoryview(text.as_buffer()))
                held = copies.get((lang, digest))
                if held is None:
                    held = copies[lang, digest] = Counter()
                    first.append(k)
                    digests.append(digest)
                held[source] += 1
            if first:
                at = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(digests, pa.binary()), pa.nulls(len(first), pa.string()),
                     pa.nulls(len(first), pa.int64()), batch.column(2).take(at)], names)
            if len(copies) > TEXTS:
                yield from numbers()
                copies = {}
        yield from numbers()

    slim = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    sent = slim.mapInArrow(work, "lang string, digest binary, source string, n long, text string")
    return sent.repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("n").asc_nulls_first())


def counted(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, in each group; parts of the sums.

    Every group also has the empty term, with 0.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # occurrences and documents of a term in one whole number, which is exact at any size
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size, key, found, copies = 0, None, [], Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), sums in held.items():
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, k), pa.repeat(source, k), pa.array(sums, pa.binary()).cast(pa.string()),
                     pa.array([v >> 64 for v in sums.values()], pa.int64()),
                     pa.array([v & LOW for v in sums.values()], pa.int64())], ["lang", "source", "term", "n", "docs"])

        def add() -> int:
            grown = 0
            for source, n in copies.items():
                sums = held.setdefault((key[0], source), {b"": 0})
                grown -= len(sums)
                if n == 1:
                    for term, number in found:
                        sums[term] = sums.get(term, 0) + number
                else:
                    for term, number in found:
                        sums[term] = sums.get(term, 0) + number * n
                grown += len(sums)
            return grown

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).cast(pa.large_binary()))
            for lang, digest, source, n, text in rows:
                if (lang, digest) != key:
                    size += add()
                    key, copies = (lang, digest), Counter()
                    found = [(term, (k << 64) + 1) for term, k in Counter(terms(text.as_py())).items()]
                if n is not None:
                    copies[source] += n
            if size > HELD:
                yield from flushed()
                held, size = {}, 0
        add()
        yield from flushed()

    return texts.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) in whole numbers; NULL where nothing is kept."""
    return F.expr(f"""CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))
        DIV CAST({total} + 2 * {kept} AS DECIMAL(20, 0))) END""")


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tile:
    """Partial distances between the sources of one or two blocks, over one slice of the terms."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.heads: list[tuple[np.ndarray, ...]] = []
        self.place: np.ndarray | None = None

    def head(self, place: np.ndarray, own: np.ndarray, absent: np.ndarray, kept: np.ndarray) -> None:
        """Sources of the tile: their numbers, blocks, values for terms they lack, and the number of kept terms."""
        self.heads.append((place, own, absent, kept))

    def settle(self) -> None:
        place, own, absent, kept = (np.concatenate(c) for c in zip(*self.heads))
        order = np.argsort(place)
        self.place, self.own, self.absent = place[order], own[order], absent[order]
        self.neither = difference(self.absent[:, None], self.absent[None, :])
        self.sums = int(kept[0]) * self.neither if self.key[3] == 0 else np.zeros_like(self.neither)

    def add(self, place: np.ndarray, p: np.ndarray, start: np.ndarray) -> None:
        """Values of whole terms, each beginning at one of ``start``."""
        if self.place is None:
            self.settle()
        at = np.searchsorted(self.place, place)
        for a in np.unique(at):
            value, times = np.unique(p[at == a], return_counts=True)
            alone = (times[:, None] * (difference(value[:, None], self.absent[None, :]) - self.neither[a][None, :])).sum(0)
            self.sums[a] += alone
            self.sums[:, a] += alone
        size = np.diff(np.append(start, len(place)))
        for m in np.unique(size[size > 1]).tolist():
            first = start[size == m]
            step = max(1, 200_000 // (m * m))
            for k in range(0, len(first), step):
                rows = first[k:k + step, None] + np.arange(m)
                i, v = at[rows], p[rows]
                none = self.absent[i]
                both = (difference(v[:, :, None], v[:, None, :]) - difference(v[:, :, None], none[:, None, :])
                        - difference(none[:, :, None], v[:, None, :]) + difference(none[:, :, None], none[:, None, :]))
                np.add.at(self.sums, (i[:, :, None], i[:, None, :]), both)

    def result(self) -> pa.RecordBatch:
        if self.place is None:
            self.settle()
        lang, low, high, part = self.key
        a, b = np.triu_indices(len(self.place), 1)
        met = (self.own[a] == low) & (self.own[b] == high)
        if part:
            met &= self.sums[a, b] != 0
        a, b = a[met], b[met]
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(a)), pa.array(self.place[a], pa.int64()),
             pa.array(self.place[b], pa.int64()), pa.array(self.sums[a, b], pa.int64())], ["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, low, high, part, term, place, own, p, kept), sorted by the first five; an empty term is a head."""
    tile: Tile | None = None
    rest: pa.Table | None = None

    def changes(columns) -> np.ndarray:
        changed = np.ones(len(columns[0]), bool)
        changed[1:] = False
        for c in columns:
            changed[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return changed

    def taken(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal tile
        columns = [c.combine_chunks() for c in rows.columns]
        starts = np.flatnonzero(changes(columns[:4]))
        terms = changes(columns[:5])
        place, own, p, kept = (c.to_numpy() for c in columns[5:])
        heads = pc.equal(columns[4], "").to_numpy(zero_copy_only=False)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(heads)]):
            key = tuple(columns[k][a].as_py() for k in range(4))
            if tile is None or tile.key != key:
                if tile is not None:
                    yield tile.result()
                tile = Tile(key)
            n = int(heads[a:b].sum())  # the heads of a tile come first
            if n:
                tile.head(place[a:a + n], own[a:a + n], p[a:a + n], kept[a:a + n])
            if a + n < b:
                tile.add(place[a + n:b], p[a + n:b], np.flatnonzero(terms[a + n:b]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows]).combine_chunks()
        last = int(np.flatnonzero(changes([c.combine_chunks() for c in rows.columns[:5]]))[-1])
        rest = rows.slice(last)
        if last:
            yield from taken(rows.slice(0, last))
    if rest is not None:
        yield from taken(rest)
    if tile is not None:
        yield tile.result()


def distances(sparse: DataFrame, groups: DataFrame, block: int = BLOCK, slices: int = SLICES) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, by their numbers, a < b.

    ``sparse`` has (lang, source, term, n) with n > 0, and ``groups`` (lang, source, total, kept, place, members).
    """
    named = groups.where("members > 1").withColumn("own", F.floor(F.col("place") / block).cast("int")).withColumn(
        "last", F.floor((F.col("members") - 1) / block).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    order = ["lang", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    values = sparse.join(named, ["lang", "source"]).select(
        "*", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("part"), share("n", "total", "kept").alias("p"), meets)
    heads = (named.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"),
                          F.coalesce(share("0", "total", "kept"), F.lit(1)).alias("p")).select("*", meets))
    rows = heads.select(*order, "part", F.lit("").alias("term"), "place", "own", "p", "kept").unionByName(
        values.select(*order, "part", "term", "place", "own", "p", "kept"))
    tile = ["lang", "low", "high", "part"]
    partial = rows.repartition(*tile).sortWithinPartitions(*tile, "term").mapInArrow(
        _tiles, "lang string, a long, b long, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", block: int = BLOCK, slices: int = SLICES) -> DataFrame:
    """(lang, source, part, item, value, rank), ranked from 1 for each source and part.

    Part ``pair`` has the distance to each other source, ``term`` the ``top`` terms that the source has more of than its
    language, by their share of the distance to the language.
    """
    parts = counted(collapsed(docs, lang_col, source_col, text_col))
    # tasks have combined their counts; dealt by language and term, sums by source and over all sources need no other exchange
    cells = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    cells = cut_lineage(cells.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("of_lang"),
                                     F.sum("docs").over(of_term).alias("docs")).where((F.col("docs") >= least) | (F.col("term") == "")))
    sparse, present = cells.where("term <> ''").drop("docs"), cells.where("term = ''").select("lang", "source")
    kept = sparse.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(present.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")],
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place"),
        F.count("*").over(Window.partitionBy("lang")).alias("members")))

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    p, q = share("n", "total", "kept").alias("p"), share("of_lang", "lang_total", "kept").alias("q")
    more = sparse.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p, q).where("p > q")
    words = (more.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) DIV (p + q)").alias("value"))
             .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))

    half = cut_lineage(distances(sparse, groups, block, slices))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    mine = groups.select("lang", F.col("place").alias("a"), "source")
    other = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    pairs = both.join(mine, ["lang", "a"]).join(other, ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(words)
