"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Documents are cut into overlapping passages, twice as long as the longest item and starting every item length, so that
every stretch of an item's length lies whole in some passage. Every passage is a query against all items. A term's
impact on an item is its BM25 weight as a share of the item's score with itself, so one threshold serves items of any
length. A hit is verified by the five-word shingles of the item's question and answer (its last sentence).

The index has a posting list for each term: items in order with their impacts, and for each block of items the largest
impact. As in WAND, lists are parted into leading ones and ones that cannot reach the threshold by themselves, here for
each item: an item becomes a pivot of a passage only through its leading postings. A pivot is given up when its leading
postings and the rest of its impacts stay below the threshold, then when the maxima of its block do; for the remaining
ones all lists are moved to the pivot and it is scored in full. Pivots of many passages are handled at once, in arrays.
All items at or above the threshold are found.

Equal item texts are indexed once. Items are grouped by length, so that a long one does not lengthen the passages of the
others, and dealt into shards of at most ``WORDS`` words (a longer item is alone). Impacts come from an aggregation over
the whole benchmark, copies counted; a task builds a shard's index, and one pass over the documents serves ``SCAN``
shards, each broadcast by itself.

Defined results: NULL or empty texts have no passages; items without words match nothing; an item without a sentence end
has no answer and is verified by its question alone; items with the same text are all reported; rows are judged one by
one, so repeated rows give repeated hits and NULL ids stay NULL; empty tables give empty results; further columns are
ignored or, by :func:`keep_clean`, kept. Thresholds are above zero.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosescreen.llm.common import ship
from dosescreen.session import cut_lineage

ship(__name__)

THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
#: Words of the items of a shard, which bound its postings.
WORDS = 1 << 18
#: Shards that one pass over the documents serves.
SCAN = 32
#: Distinct texts numbered in one task, on average.
NUMBERED = 1 << 16
#: Items up to this length are of one group; from there on lengths of a group differ by a factor of two at most.
LEAST_SPAN = 64
#: Items of a block of the posting lists.
ITEM_BLOCK = 16
#: Postings that follow hold less than this share of the threshold.
FOLLOW = 0.5
#: Passages handled at once, and characters of the texts cut at once.
PASSAGES = 1024
CHARACTERS = 1 << 21
#: What sums in another order may differ by.
SLACK = 1e-9
K1, B = 1.2, 0.75
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.?!]\s+(?=\S)")


class Index(NamedTuple):
    """``postings`` are (term, item) as one number in order, with ``impacts``; ``blocks`` are (term, block of items)
    with the largest impact, ``bounds`` the largest of a term. Leading postings of term t are ``lead_items`` and
    ``lead_impacts`` from ``leads[t]`` to ``leads[t + 1]``; ``follow`` is what an item's other impacts sum up to.
    ``questions`` and ``answers`` are the items' shingles."""

    questions: list[frozenset]
    answers: list[frozenset]
    terms: dict[str, int]
    bounds: np.ndarray
    postings: np.ndarray
    impacts: np.ndarray
    blocks: np.ndarray
    block_bounds: np.ndarray
    leads: np.ndarray
    lead_items: np.ndarray
    lead_impacts: np.ndarray
    follow: np.ndarray
    stride: int


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(tokens: list[str], n: int = SHINGLE) -> frozenset:
    n = min(n, len(tokens))
    return frozenset(zip(*[tokens[i:] for i in range(n)])) if n else frozenset()


def parts(text: str) -> tuple[frozenset, frozenset]:
    """Shingles of question and answer."""
    ends = [m.end() for m in SENTENCE.finditer(text)]
    cut = next((e for e in reversed(ends) if words(text[e:])), len(text))
    return shingles(words(text[:cut])), shingles(words(text[cut:]))


def build(texts: list[str], item: np.ndarray, word: np.ndarray, tf: np.ndarray, frequency: np.ndarray, total: int,
          mean: float, threshold: float = THRESHOLD) -> Index:
    """The index of ``texts`` with the postings (item, word, tf, frequency); an item is its text's place."""
    n = len(texts)
    lengths = np.bincount(item, tf, n)
    impact = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5)) * tf * (K1 + 1)
    impact = impact / (tf + K1 * (1 - B + B * lengths[item] / mean))
    impact = impact / np.bincount(item, impact, n)[item]
    # from each item's largest impact on; those leave the lead with which the rest falls below its limit
    order = np.lexsort((-impact, item))
    summed = np.cumsum(impact[order])
    own = np.searchsorted(item[order], np.arange(n))
    before = summed - impact[order] - np.concatenate(([0.0], summed))[own][item[order]]
    lead = np.empty(len(item), bool)
    lead[order] = 1 - before >= FOLLOW * threshold - SLACK
    follow = 1 - np.bincount(item[lead], impact[lead], n)

    names, term = np.unique(word, return_inverse=True)
    order = np.lexsort((item, term))
    item, term, impact, lead = item[order], term[order], impact[order], lead[order]
    blocks, at = np.unique(term * -(-n // ITEM_BLOCK) + item // ITEM_BLOCK, return_index=True)
    return Index(*map(list, zip(*map(parts, texts))), {w: k for k, w in enumerate(names.tolist())},
                 np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(names)))),
                 term * n + item, impact, blocks, np.maximum.reduceat(impact, at),
                 np.searchsorted(term[lead], np.arange(len(names) + 1)), item[lead], impact[lead], follow,
                 max(LEAST_SPAN // 2, int(lengths.max())))


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of ``count`` from ``first`` on, and the range that each belongs to."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(first - np.cumsum(count) + count, count)


def above(index: Index, passage: np.ndarray, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of all scores that reach the threshold, by passage.

    ``passage`` and ``terms`` are the distinct terms of the passages, in order.
    """
    n = len(index.questions)
    # passages whose terms' bounds stay below the threshold have no pivot
    held = (np.bincount(passage, index.bounds[terms]) >= threshold - SLACK)[passage]
    passage, terms = passage[held], terms[held]
    if not len(terms):
        return
    start = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    count = np.diff(np.append(start, len(terms)))

    def moved(who: np.ndarray, to: np.ndarray, keys: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        """Sum of the values that the lists of passage ``who`` have at ``to``."""
        owner, at = _spread(start[who], count[who])
        wanted = terms[at] * width + to[owner]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.bincount(owner, values[place] * (keys[place] == wanted), len(who))

    for some in range(0, len(start), PASSAGES):
        few = slice(start[some], start[some:some + PASSAGES][-1] + count[some:some + PASSAGES][-1])
        number = np.repeat(np.arange(some, some + len(start[some:some + PASSAGES])), count[some:some + PASSAGES])
        owner, at = _spread(index.leads[terms[few]], index.leads[terms[few] + 1] - index.leads[terms[few]])
        pivots, back = np.unique(number[owner] * n + index.lead_items[at], return_inverse=True)
        led = np.bincount(back, index.lead_impacts[at], len(pivots))
        pivots = pivots[led + index.follow[pivots % n] >= threshold - SLACK]
        who, item = pivots // n, pivots % n
        n_blocks = -(-n // ITEM_BLOCK)
        pairs, back = np.unique(who * n_blocks + item // ITEM_BLOCK, return_inverse=True)
        enough = moved(pairs // n_blocks, pairs % n_blocks, index.blocks, index.block_bounds, n_blocks) >= threshold - SLACK
        who, item = who[enough[back]], item[enough[back]]
        scores = moved(who, item, index.postings, index.impacts, n)
        for k in np.flatnonzero(scores >= threshold).tolist():
            yield int(passage[start[who[k]]]), int(item[k]), float(scores[k])


def _share(part: frozenset, seen: dict[int, set]) -> float:
    if not part:
        return 1.0
    size = len(next(iter(part)))
    return sum(s in seen[size] for s in part) / len(part)


def hits(index: Index, texts: list[list[str]], threshold: float = THRESHOLD,
         overlap: float = OVERLAP) -> dict[tuple[int, int], tuple[float, float, float]]:
    """The items that texts, given by their words, hold: (text, item) with the best score and the overlaps of question
    and answer there."""
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    stride = index.stride
    lengths = np.array([len(t) for t in texts], np.int64)
    passages = -(-np.maximum(1, lengths - stride) // stride)
    first = np.cumsum(passages) - passages
    ids = np.fromiter((index.terms.get(w, -1) for t in texts for w in t), np.int64, int(lengths.sum()))
    known = np.flatnonzero(ids >= 0)
    # a word belongs to the passage that starts with its stretch and to the one before
    text = np.repeat(np.arange(len(texts)), lengths)[known]
    stretch = (known - (np.cumsum(lengths) - lengths)[text]) // stride
    code = [((first[text] + s) * len(index.terms) + ids[known])[(s >= 0) & (s < passages[text])] for s in (stretch, stretch - 1)]
    code = np.unique(np.concatenate(code))
    at, seen, holder = -1, {}, 0
    for p, number, score in above(index, code // len(index.terms), code % len(index.terms), threshold):
        if p != at:
            at, seen, holder = p, {}, int(np.searchsorted(first, p, "right")) - 1
            place = (p - int(first[holder])) * stride
            passage = texts[holder][place:place + 2 * stride]
        question, answer = index.questions[number], index.answers[number]
        for part in (question, answer):
            size = len(next(iter(part), ()))
            if size and size not in seen:
                seen[size] = set(zip(*[passage[i:] for i in range(size)]))
        q, a = _share(question, seen), _share(answer, seen)
        if q >= overlap and a >= overlap and (score, q, a) > found.get((holder, number), (0, 0, 0)):
            found[holder, number] = (score, q, a)
    return found


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """The words of a column's texts, piece by piece, with the place of a piece's first text."""
    at, piece, size = 0, [], 0
    for k, text in enumerate(column):
        text = text.as_py() or ""
        piece.append(words(text))
        size += len(text)
        if size >= CHARACTERS:
            yield at, piece
            at, piece, size = k + 1, [], 0
    if piece:
        yield at, piece


def _loaded(shared: list[Broadcast]) -> Iterator[Iterator[tuple[int, Index]]]:
    """Again and again the indexes, of which one is held at a time."""
    only = Index(*pickle.loads(shared[0].value)) if len(shared) == 1 else None
    while True:
        yield ((k, only or Index(*pickle.loads(s.value))) for k, s in enumerate(shared))


def numbered(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """Distinct texts with words (text, copies, length, shard, item), the postings (shard, item, word, tf, frequency),
    the number of items and their mean length."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("length", pa.array([len(words(t.as_py())) for t in batch.column(0)], pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, copies, shard, item in zip(*(batch.column(c) for c in ("text", "copies", "shard", "item"))):
                held = Counter(words(text.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * len(held)), pa.array([item.as_py()] * len(held), pa.int64()), pa.array(held.keys()),
                     pa.array(held.values(), pa.int64()), pa.array([copies.as_py()] * len(held), pa.int64())],
                    ["shard", "item", "word", "tf", "copies"])

    texts = benchmark.select(F.col("text").cast("string").alias("text"))
    sized = cut_lineage(texts.groupBy("text").agg(F.count("*").alias("copies"))
                        .mapInArrow(measured, "text string, copies long, length long"))
    total, filled, length = sized.select(F.sum("copies"), F.sum(F.when(F.col("text").isNotNull(), F.col("copies"))),
                                         F.sum(F.col("copies") * F.col("length"))).first()
    span = F.greatest(F.lit(LEAST_SPAN), F.pow(F.lit(2), F.ceil(F.log2("length")))).cast("long")
    sized = sized.where("length > 0").withColumn("span", span)
    # a few rows: one for each power of two
    dealt = sized.groupBy("span").agg(F.ceil(F.count("*") / NUMBERED).alias("deals"))
    deal = F.pmod(F.xxhash64("text"), F.col("deals"))
    place = F.row_number().over(Window.partitionBy("span", "deal").orderBy("text")) - 1
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(WORDS) / F.col("span")))
    items = cut_lineage(sized.join(dealt, "span").withColumn("deal", deal).withColumn("place", place)
                        .select("text", "copies", F.concat_ws("/", "span", "deal", F.floor(F.col("place") / size)).alias("shard"),
                                (F.col("place") % size).alias("item")))
    cells = cut_lineage(items.mapInArrow(cut, "shard string, item long, word string, tf long, copies long"))
    frequency = cells.groupBy("word").agg(F.sum("copies").alias("frequency"))
    return items, cells.drop("copies").join(frequency, "word"), total or 0, (length or 0) / (filled or 1)


def indexes(items: DataFrame, postings: DataFrame, total: int, mean: float, threshold: float) -> DataFrame:
    """(shard, index): the index of each shard, pickled."""
    def assembled(items: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        columns = [postings[c].to_numpy() for c in ("item", "word", "tf", "frequency")]
        index = build(items.sort_values("item")["text"].tolist(), *columns, total, mean, threshold)
        return pd.DataFrame({"shard": items["shard"][:1], "index": [pickle.dumps(tuple(index))]})

    return (items.groupBy("shard").cogroup(postings.groupBy("shard"))
            .applyInPandas(assembled, "shard string, index binary"))


def _passes(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, list[tuple[list[str], list[Broadcast]]]]:
    """The numbered items, and for each pass over the documents its shards and their indexes."""
    items, postings, total, mean = numbered(benchmark)
    built = cut_lineage(indexes(items, postings, total, mean, threshold))
    context = docs.sparkSession.sparkContext
    sent = ((r["shard"], context.broadcast(bytes(r["index"]))) for r in built.toLocalIterator())
    return items, [tuple(map(list, zip(*some))) for some in batched(sent, SCAN)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every test item that a document holds."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = "score double, question_overlap double, answer_overlap double"
    items, passes = _passes(docs, benchmark, threshold)
    found = docs.sparkSession.createDataFrame([], f"doc_id long, shard string, item long, {marks}")
    for shards, shared in passes:
        def work(batches: Iterator[pa.RecordBatch], shards=shards, shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = _loaded(shared)
            for batch in batches:
                for at, texts in _pieces(batch.column(1)):
                    rows = [(batch.column(0)[at + t].as_py(), shards[k], n, *marks) for k, index in next(loaded)
                            for (t, n), marks in sorted(hits(index, texts, threshold, overlap).items())]
                    if rows:
                        types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows), types)],
                            ["doc_id", "shard", "item", "score", "question_overlap", "answer_overlap"])

        found = found.union(slim.mapInArrow(work, found.schema))
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids = ids.join(items, "text").select("shard", "item", "item_id")
    return found.join(ids, ["shard", "item"]).select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
               overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without those that hold a test item."""
    at = docs.columns.index(text_col)
    _, passes = _passes(docs, benchmark, threshold)
    for _, shared in passes:
        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = _loaded(shared)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, texts in _pieces(batch.column(at)):
                    for _, index in next(loaded):
                        clean[[start + t for t, _ in hits(index, texts, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
