"""Retrieval by pivots and block maxima against scoring of every passage with every item."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from dosescreen.llm import decontaminate


def sentences(pick, n, often):
    """Words of which some are in many items, so that posting lists have several blocks."""
    return " ".join(f"c{pick.randrange(often)}" if pick.random() < 0.5 else f"r{pick.randrange(400)}" for _ in range(n))


def scored(items, texts, span, threshold):
    """(text number, item number) to the best score, by the formula alone; ``span`` tells an item's passage step."""
    bags = [Counter(decontaminate.words(t)) for t in items]
    frequency = Counter(w for b in bags for w in b)
    n, mean = len(items), sum(sum(b.values()) for b in bags) / len(items)
    shares = []
    for b in bags:
        length = sum(b.values())
        impact = {w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * f * 2.2
                  / (f + 1.2 * (0.25 + 0.75 * length / mean)) for w, f in b.items()}
        shares.append({w: x / sum(impact.values()) for w, x in impact.items()})
    found = {}
    for d, text in enumerate(texts):
        tokens = decontaminate.words(text)
        for i, share in enumerate(shares):
            step = span[i]
            for s in range(0, max(1, len(tokens) - step), step):
                score = sum(share.get(w, 0) for w in set(tokens[s:s + 2 * step]))
                if score >= threshold:
                    found[d, i] = max(score, found.get((d, i), 0))
    return found


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.6, 0.9])
def test_pivots_find_all_scores_above_the_threshold(threshold):
    pick = random.Random(17)
    items = [sentences(pick, 6 + i % 30, 25) for i in range(150)]
    texts = [sentences(pick, 10 * k % 700, 25) for k in range(1, 40)] + [items[3], "", items[140] + " " + items[9]]
    bags = [Counter(t.split()) for t in items]
    frequency = Counter(w for b in bags for w in b)
    cells = [(i, w, f, frequency[w]) for i, b in enumerate(bags) for w, f in b.items()]
    item, word, tf, df = (np.array(c) for c in zip(*cells))
    index = decontaminate.build(items, item, word.astype(object), tf, df, len(items),
                                sum(map(len, map(str.split, items))) / len(items), threshold)
    # overlaps of zero accept whatever reaches the score
    found = decontaminate.hits(index, [decontaminate.words(t) for t in texts], threshold, 0.0)
    want = scored(items, texts, [index.stride] * len(items), threshold)
    assert len(want) > 2 and found.keys() == want.keys()
    assert all(found[k][0] == pytest.approx(want[k]) for k in want)
    assert len(index.blocks) > len(index.terms) and (threshold < 0.5 or len(index.lead_items) < len(index.postings))


def test_shards_copies_and_long_items(spark, docs, monkeypatch):
    pick = random.Random(23)
    items = [(i, sentences(pick, 20 + i % 25, 40) + ". " + sentences(pick, 7, 40) + ".") for i in range(60)]
    items.append((60, sentences(pick, 900, 40) + ". " + sentences(pick, 8, 40) + "."))
    copies = [(100 + i, items[5][1]) for i in range(30)] + [(None, items[6][1]), (6, items[6][1]), (70, None), (71, "..")]
    benchmark = spark.createDataFrame(items + copies, "item_id long, text string")
    rows, want = [(None, None), (1, ""), (2, "word " * 20000)], []
    for d in range(40):
        tokens = sentences(pick, 150 + 20 * d, 40).split()
        at = [60, 5, 6][d] if d < 3 else d
        if d % 2 == 0 or d < 3:
            tokens[40 + d:40 + d] = items[at][1].split()
            same = {5: [5, *range(100, 130)], 6: [6, None, 6]}.get(at, [at])
            want += [(10 + d, i) for i in same]
        rows.append((10 + d, " ".join(tokens)))
    rows.append(rows[3])
    want += [(10, 60)]
    results = []
    for limit, scan in ((1 << 18, 32), (300, 2), (1, 3)):
        monkeypatch.setattr(decontaminate, "WORDS", limit)
        monkeypatch.setattr(decontaminate, "SCAN", scan)
        found = decontaminate.contaminated(docs(rows), benchmark).collect()
        results.append(sorted(map(str, found)))
        assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=str) == sorted(want, key=str)
        left = decontaminate.keep_clean(docs(rows), benchmark).collect()
        assert len(left) == len(rows) - 1 - len({d for d, _ in want})
    assert results[0] == results[1] == results[2]


def test_a_shard_has_bounded_words(spark, monkeypatch):
    pick = random.Random(29)
    monkeypatch.setattr(decontaminate, "WORDS", 512)
    monkeypatch.setattr(decontaminate, "NUMBERED", 16)
    rows = [(i, sentences(pick, 5 + (i * 37) % 200, 40)) for i in range(300)] + [(i, "the same item") for i in range(200)]
    items, postings, total, mean = decontaminate.numbered(spark.createDataFrame(rows, "item_id long, text string"))
    assert total == 500 and mean == pytest.approx(sum(len(t.split()) for _, t in rows) / 500)
    assert items.count() == len({t for _, t in rows}) and items.select("shard").distinct().count() > 20
    words = postings.groupBy("shard").agg({"tf": "sum"}).collect()
    assert all(r["sum(tf)"] <= 512 for r in words)
    assert {r["word"]: r["frequency"] for r in postings.collect()}["same"] == 200
