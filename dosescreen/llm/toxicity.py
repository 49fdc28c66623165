"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector serves all thresholds, which are kept in order. Features
are log(1 + count) of the lower-cased words of a text and of their onsets, the first four to six characters of longer
words, so that inflected and compound forms not seen in the sample count too. The output is the expected severity, sum
over k of P(grade > k).

Fitting uses a bounded sample: at most ``per_class`` labelled documents of each label value, those with the smallest
hash of their id. The labels say only whether a document is toxic, so severity grades are set within the sample: a toxic
document gets grade 1 to ``GRADES`` - 1 by how many of its features are clearly more frequent among toxic documents
than among others. Scoring reads whole texts of all documents.

Defined results: NULL or empty texts have no features and the severity of the empty text; rows are scored one by one, so
repeated rows and NULL ids change nothing; labels that are NULL or without document are left out; without labelled
documents of both kinds the severity is 0 for all; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen.llm.common import fresh, received, send, ship

ship(__name__)

GRADES = 4
PER_CLASS = 3000
LEAST_DOCS = 5
WORD = re.compile(r"\w+")
ONSETS = (4, 5, 6)
#: Weight of the squared weights against the mean log likelihood.
RIDGE = 4e-3
#: Smaller weights count as none.
LEAST_WEIGHT = 0.01
#: Words whose features a scoring task keeps at hand.
REMEMBERED = 200_000
#: Documents whose expected severity reaches this are rejected.
REJECT = 0.5


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: tuple[float, ...]


def counts(text: str | None) -> Counter:
    """How often a text has each feature."""
    found = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for x in forms(word):
            found[x] += n
    return found


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
           text_col: str = "text") -> Iterator[tuple[str, int]]:
    """At most ``per_class`` texts of each label value, as (text, toxic); the labels of the sample are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    picks = []
    for value in (0, 1):
        picks.append(known.where(F.col("_toxic") == value).where("_id is not null").distinct()
                     .orderBy(F.xxhash64(F.lit(7), "_id"), "_id").limit(per_class))
    chosen = F.broadcast(picks[0].union(picks[1]))
    slim = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    texts = slim.join(chosen, F.col("_doc") == F.col("_id")).select("_id", "_text", "_toxic")
    # an id may be repeated; the bound holds for rows as well
    rows = texts.orderBy(F.xxhash64(F.lit(7), "_id"), "_id", "_toxic", "_text").limit(2 * per_class).toLocalIterator()
    return ((r["_text"] or "", r["_toxic"]) for r in rows)


def grades(column: np.ndarray, row: np.ndarray, count: np.ndarray, toxic: np.ndarray, top: int = GRADES) -> np.ndarray:
    """0 for documents that are not toxic, else 1 to ``top`` - 1 by the number of their telling features."""
    words = int(column.max(initial=-1)) + 1
    seen = [np.bincount(column[toxic[row] == t], minlength=words) for t in (0, 1)]
    share = [max(1, int((toxic == t).sum())) for t in (0, 1)]
    telling = (seen[1] >= 0.02 * share[1]) & (seen[1] / share[1] > 10 * (seen[0] + 1) / share[0])
    hits = np.bincount(row, count * telling[column], len(toxic))
    marked = np.sort(hits[(toxic == 1) & (hits > 0)])
    cuts = [marked[len(marked) * k // (top - 1)] if len(marked) else 1 for k in range(1, top - 1)]
    return np.where(toxic == 1, 1 + sum((hits > c).astype(int) for c in cuts), 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: Iterable[tuple[str, int]], top: int = GRADES, ridge: float = RIDGE, rounds: int = 200) -> Model:
    """Fit by gradient descent on the mean log likelihood with a ridge penalty; steps are sized per weight (Adam) and
    shrink to nothing over the rounds, so that the fit settles."""
    place: dict[str, int] = {}
    grown, columns, values = [], [], []
    for text, t in rows:
        found = counts(text)
        grown.append(t)
        columns.append(np.array([place.setdefault(w, len(place)) for w in found], np.int32))
        values.append(np.array(list(found.values()), np.int32))
    toxic = np.array(grown, int)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model({}, (np.inf,) * (top - 1))
    row = np.repeat(np.arange(len(toxic)), [len(c) for c in columns])
    column, count = np.concatenate(columns), np.concatenate(values)
    grade = grades(column, row, count, toxic, top)
    often = np.bincount(column, minlength=len(place)) >= LEAST_DOCS
    held = often[column]
    row, column, value = row[held], (np.cumsum(often) - 1)[column[held]], np.log1p(count[held])
    place = {w: k for k, w in enumerate(w for w, i in place.items() if often[i])}
    # both kinds weigh the same, whatever their number in the sample
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    w, first, gaps = np.zeros(len(place)), 0.0, np.zeros(top - 2)
    moment = [np.zeros(len(place) + top - 1), np.zeros(len(place) + top - 1)]
    n = len(toxic)
    for step in range(1, rounds + 1):
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(row, value * w[column], n)
        edge = np.concatenate((np.zeros((n, 1)), sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))), 1)
        high, low = edge[np.arange(n), grade + 1], edge[np.arange(n), grade]
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        share = np.maximum(high - low, 1e-12)
        by_score = weight * (slope_high - slope_low) / share
        by_cut = np.zeros((n, top + 1))
        by_cut[np.arange(n), grade + 1] -= weight * slope_high / share
        by_cut[np.arange(n), grade] += weight * slope_low / share
        by_cut = by_cut[:, 1:-1].sum(0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate((np.bincount(column, value * by_score[row], len(place)) + ridge * w, [tail[0]],
                                tail[1:] * np.exp(gaps)))
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope ** 2
        move = 0.1 * (1 - (step - 1) / rounds) * (moment[0] / (1 - 0.9 ** step)) / (np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:len(place)]
        first -= move[len(place)]
        gaps -= move[len(place) + 1:]
    return Model({x: float(w[i]) for x, i in place.items() if abs(w[i]) > LEAST_WEIGHT},
                 tuple(float(c) for c in first + np.concatenate(([0], np.cumsum(np.exp(gaps))))))


def forms(word: str) -> list[str]:
    """A word and its onsets; onsets end in a mark that no word holds."""
    return [word, *[word[:k] + "*" for k in ONSETS if len(word) > k]]


def severity(text: str | None, model: Model, seen: dict[str, list[str]] | None = None) -> float:
    """Expected severity: the sum over the thresholds of the probability of a higher grade.

    ``seen`` remembers the known features of at most ``REMEMBERED`` words from one text to the next.
    """
    known, found = model.weights, {}
    seen = {} if seen is None else seen
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        held = seen.get(word)
        if held is None:
            held = [x for x in forms(word) if x in known]
            if len(seen) < REMEMBERED:
                seen[word] = held
        for x in held:
            found[x] = found.get(x, 0) + n
    score = sum([known[x] * log1p(n) for x, n in found.items()])
    return float(sum(sigmoid(np.array(score) - c) for c in model.thresholds))


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None,
          output: str = "severity") -> DataFrame:
    """``columns`` of ``docs`` (all by default) with a column ``output``, which replaces one of that name."""
    shared = send(docs.sparkSession, model)
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() != output.lower()]
    docs = docs.select(*[f"`{c}`" for c in kept], F.col(text_col).cast("string").alias(output))
    schema = docs.select(*[f"`{c}`" for c in kept], F.lit(0.0).alias(output)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = received(shared), {}
        for batch in batches:
            marks = [severity(t.as_py(), model, seen) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.float64())], batch.schema.names)

    return docs.mapInArrow(work, schema)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
           text_col: str = "text") -> Model:
    return fit(sample(docs, labels, per_class, id_col, text_col))


def keep_mild(docs: DataFrame, labels: DataFrame, reject: float = REJECT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``docs`` without those whose expected severity reaches ``reject``."""
    (mark,) = fresh(docs, "_severity")
    scored = score(docs, fitted(docs, labels, id_col=id_col, text_col=text_col), text_col, output=mark)
    return scored.where(F.col(mark) < reject).select(docs.columns)
