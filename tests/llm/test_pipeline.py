"""The mix and all five stages of the pipeline, rebuilt in plain Python on a small corpus."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dosescreen.llm import mixture, toxicity
from tests.llm.test_distribution import Int, prose, signed, spark_hash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets_by_hand(sizes):
    """{source: words to take}: shares by weight, what a source can't take being shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > mixture.MOST * sizes[s]}
        if not full:
            return found | {s: weight[s] * level for s in open_}
        found |= {s: float(mixture.MOST * sizes[s]) for s in full}
        left -= sum(found[s] for s in full)
        open_ -= full
    return found


def mix_by_hand(rows):
    """[(id, source, size, source_size, target, taken)] for rows (id, source, text, weight)."""
    by_source = defaultdict(list)
    for i, source, text, weight in rows:
        salt = signed(spark_hash(text))
        u = ((spark_hash(Int(17), i, salt) >> 11) + 0.5) / (1 << 53)
        key = -math.log(u) / weight
        part = min(math.floor(mixture.SLICES * (1 - math.exp(-key))), mixture.SLICES - 1)
        by_source[source].append((part, key, i is not None, i or 0, salt, len(words_of(text)), i))
    sizes = {s: sum(r[5] for r in held) for s, held in by_source.items()}
    goals, out = targets_by_hand(sizes), []
    for source, held in by_source.items():
        epochs = min(goals[source] // sizes[source], mixture.MOST) if sizes[source] else 0
        rest, before = goals[source] - epochs * sizes[source], 0
        for *_, size, i in sorted(held):
            extra = before + size / 2 <= rest and epochs < mixture.MOST
            before += size
            out.append((i, source, size, sizes[source], pytest.approx(goals[source]), int(size * (epochs + extra))))
    return out


def compared(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    return sorted(found, key=key) == sorted(want, key=key)


def test_mix_against_plain_python(docs, spark):
    rows = [(i, prose(i, 1 + i % 60)) for i in range(500)] + [(900, None), (901, ""), (902, "  "), (None, "no id here")]
    source = F.when(F.col("doc_id") % 9 == 0, "b").when(F.col("doc_id") % 9 < 3, "a").when(F.col("doc_id") < 5, None).when(
        F.col("doc_id") % 9 < 8, "c")
    frame = docs(rows).withColumn("source", source).repartition(6)
    quality = {i: i % 2 for i in range(0, 500, 3)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    found = mixture.mix(mixture.weighted(frame, labels)).select("id", "source", "size", "source_size", "target", "taken")
    want = mix_by_hand([(r["doc_id"], r["source"], r["text"], 0.5 + 1.5 * quality[r["doc_id"]] if r["doc_id"] in quality else 1.0)
                        for r in frame.collect()])
    assert compared([tuple(r) for r in found.collect()], want) and len(want) == len(rows)
    assert len({r[1] for r in want}) == 4 and any(0 < r[5] for r in want) and any(r[5] == 0 < r[2] for r in want)


def fingerprint_by_hand(text):
    words = words_of((text or "").translate(AZ))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(marks):
    """The group of each place in a list of fingerprints that link at four differing bits."""
    group = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return group


def redacted(text):
    """Secrets of the fixture's kinds, by the patterns of the contract."""
    rules = [(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
             (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]
    spans = sorted(m.span() for p, g, n in rules for m in re.finditer(p, text) if len(m[g]) >= n)
    out, at = [], 0
    for a, b in spans:
        if b > at:
            out += [text[at:a], "[SECRET]"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(6)
    bad = ["vile", "foul", "nasty", "rotten"]
    items = [(i, prose(4000 + i, 14) + ". " + prose(5000 + i, 6) + ".") for i in range(12)] + [(50, None), (51, "")]
    rows, toxic, leaked = [], set(), set()
    for i in range(260):
        words = prose(i, 40 + i % 50).split()
        if i % 5 == 0:
            words += pick.choices(bad, k=6 + i % 7)
            toxic.add(i)
        elif i % 5 == 1 and i % 3 == 0:
            words[20:20] = items[i % 12][1].split()
            leaked.add(i)
        elif i % 5 == 2:
            words[10:10] = [f"token={'k%09d' % i}", "AKIA" + "B2" * 8, "and", "0" * 33]
        rows.append((i, " ".join(words), pick.choice(["a", "a", "a", "b", None])))
    copies = [(300 + k, rows[7 * (k % 9) + 3][1], "b") for k in range(40)]  # groups of exact copies
    near = [(400 + k, rows[k][1].replace(" ", "  ") + " End", "a") for k in range(13, 113, 10)]
    odd = [(500, None, "a"), (501, "", "a"), (502, " \n ", "b"), (None, prose(9001, 50), "a"), (None, prose(9002, 50), "b"),
           (None, prose(9002, 50), "b"), (None, rows[4][1], "a"), (503, "é ß 漢字 " * 9000, "b")]
    labels = [(i, int(i % 4 == 0), int(i in toxic)) for i in range(0, 260) if i % 3] + [(None, 1, 1), (9999, 0, 0)]
    return rows + copies + near + odd, items, labels, toxic, leaked


def test_stages_against_plain_python(spark, corpus, tmp_path):
    rows, items, labels, toxic, leaked = corpus
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), f"own {k}", k) for k, (i, t, s) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars int, severity string, spans int")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    texts = {i: t for i, t, _ in rows if i is not None}
    model = toxicity.fit([(texts[i] or "", t) for i, _, t in labels if i in texts])
    mild = [r for r in rows if toxicity.severity(r[1], model) < toxicity.REJECT]
    assert toxic <= {r[0] for r in rows} - {r[0] for r in mild} and len(mild) > 200
    group = groups_by_hand([fingerprint_by_hand(t) for _, t, _ in mild])
    least = {}
    for g, (i, _, _) in zip(group, mild):
        least[g] = min(least.get(g, math.inf), math.inf if i is None else i)
    single, seen = [], set()
    for g, r in zip(group, mild):
        if r[0] == least[g] or (least[g] == math.inf and g not in seen):
            single.append(r)
            seen.add(g)
    clean = [r for r in single if r[0] not in leaked]
    safe = [(i, t if t is None else redacted(t), s) for i, t, s in clean]
    good = defaultdict(list)
    for i, q, _ in labels:
        good[i].append(q)
    want = mix_by_hand([(i, s, t, 0.5 + 1.5 * sum(good[i]) / len(good[i]) if i is not None and i in good else 1.0) for i, t, s in safe])

    expected, frame = [mild, single, clean, safe], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), rows_due in zip(corpus_pipeline.STAGES, expected):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns, name
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        left = frame.collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in left) == Counter(rows_due), name
        assert all(r["severity"].startswith("own ") for r in left) and all(f"own {r['spans']}" == r["severity"] for r in left), name
        assert all(r["n_chars"] == len(r["text"] or "") for r in left if r["text"] is not None), name
    mixed = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert compared(mixed, [r for r in want if r[5] > 0])
    assert len(toxic) > 40 and len(leaked) > 10 and len(single) < len(mild) - 40 and any("[SECRET]" in (r[1] or "") for r in safe)
