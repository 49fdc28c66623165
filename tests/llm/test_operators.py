"""Operators on small hand-made tables: brute force, held-out accuracy, round trips and edge rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dosescreen.llm import (
    chats, collisions, common, decontaminate, lines, mixture, secret_scan, simhash, suffixes, toxicity, warc,
)
from dosescreen.session import cut_lineage

EDGE = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "é ß 漢字"), (4, "é ß 漢字"), (5, "word " * 30000)]


def prose(seed, n):
    pick = random.Random(seed)
    return [f"w{pick.randrange(10**6)}" for _ in range(n)]


def partition(pairs, members):
    up = {m: m for m in members}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {m: root(m) for m in members}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 300), (7, 7), (None, 5)]
    found = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = partition([p for p in pairs if p[0] is not None], [*range(21), 100, 200, 300])
    assert {r["vertex"]: r["component"] for r in found} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_lines(docs):
    line = "One line that is long enough to be removed when seen again"
    rows = [*EDGE, (10, f"first of all\n{line}\nend"), (11, f"{line.upper()}\nonly here"), (12, f"x\n  {line}  \n{line}")]
    found = {(r["id"], r["first"], r["last"], r["kept_id"], r["kept_first"]) for r in lines.repeats(docs(rows)).collect()}
    n = len(line)
    assert found == {(11, 0, n, 10, 13), (12, 2, n + 6, 10, 13), (12, n + 7, 2 * n + 7, 10, 13)}
    left = {r["doc_id"]: r["text"] for r in lines.removed(docs(rows)).collect() if (r["doc_id"] or 0) >= 10}
    assert left == {10: rows[-3][1], 11: "only here", 12: "x\n"}
    assert lines.repeats(docs([])).count() == 0


def test_short_repeated_lines(docs):
    mark = "Released under the MIT license."
    rows = [*EDGE, (10, f"one\n{mark}\n \n"), (11, f"two\n \n{mark.lower()}"), (12, "One")]
    found = {(r["id"], r["first"], r["last"], r["kept_id"], r["kept_first"]) for r in lines.repeats(docs(rows)).collect()}
    n = len(mark)
    assert found == {(11, 6, 6 + n, 10, 4), (12, 0, 3, 10, 0)}
    left = {r["doc_id"]: r["text"] for r in lines.removed(docs(rows)).collect() if (r["doc_id"] or 0) >= 10}
    assert left == {10: rows[-3][1], 11: "two\n \n", 12: ""}
    assert lines.repeats(docs(rows), least=8).count() == 0


def test_rows_of_one_id_are_judged_by_their_text(docs):
    rows = [(1, "shared line one two three\nx"), (7, "shared line one two three\nalpha"),
            (7, "completely different text that nobody repeats\nbeta")]
    for ids in ((1, 7, 7), (None, None, None)):
        some = docs([(i, t) for i, (_, t) in zip(ids, rows)])
        left = sorted(r["text"] for r in lines.removed(some).collect())
        kept = [rows[2][1], "x", "alpha", "shared line one two three\nx", "shared line one two three\nalpha"]
        assert left in (sorted([kept[0], kept[2], kept[3]]), sorted([kept[0], kept[1], kept[4]]))
        assert ids[0] is None or "shared line one two three\nx" in left


def test_passages_in_sentences_by_hand(docs):
    pick = random.Random(8)
    pasted = ". ".join(" ".join(prose(500 + k, 5)) for k in range(12))
    rows = list(EDGE)
    for d in range(30):
        own = [" ".join(prose(600 + d * 50 + k, 4)) for k in range(12)] + ["Common words"] * (d % 3)
        pick.shuffle(own)
        text = ", ".join(own[:6]) + "; " + (pasted + "! " if d % 4 == 0 else pasted[:60] if d % 4 == 1 else "") + "\n".join(own[6:])
        rows.append((20 + d, text))
    rows += [(20, rows[-1][1]), (None, rows[-2][1]), (80, rows[-3][1]), (81, "Again. again. AGAIN.")]
    rows = [r for k, r in enumerate(rows) if r != (4, EDGE[5][1]) or k == 5]  # ids with one text each but for 20 and None
    cut = [[(m.start(), m.end(), " ".join(m[0].lower().split())) for m in re.finditer(r"[^\n.!?]+", t or "") if m[0].strip()]
           for _, t in rows]
    shared = Counter(u for found in cut for u in {u for *_, u in found})
    seen, want = {}, Counter()
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        for a, _, u in cut[k]:
            seen.setdefault(u, (k, a))
    for k, found in enumerate(cut):
        run = longest = repeated = later = words = 0
        spans, start = [], None
        for a, b, u in [*found, (None, None, None)]:
            again = shared[u] > 1 if u else False
            gone = again and seen[u] != (k, a)
            run = run + len(u.split()) if again else 0
            longest, repeated, later = max(longest, run), repeated + again, later + gone
            if gone:
                words, start, end = words + len(u.split()), a if start is None else start, b
            elif start is not None:
                spans += [(start, end)] if words >= lines.RUN else []
                words, start = 0, None
        want[rows[k][0], len(found), repeated, later, longest, tuple(spans)] += 1
    got = Counter((r["id"], r["units"], r["repeated_units"], r["later_units"], r["longest_run"], tuple(map(tuple, r["spans"])))
                  for r in lines.passages(docs(rows).coalesce(1)).collect())
    assert got == want
    assert sum(bool(k[5]) for k in want) >= 7 and (81, 3, 0, 0, 0, ()) in want
    assert lines.passages(docs([])).count() == 0


def test_embeddings_against_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((60, 16))
    rows = [(i, i % 2, [float(x) for x in base[i % 60] + 0.12 * draw.standard_normal(16)]) for i in range(300)]
    rows += [(500 + i, 0, rows[0][2]) for i in range(40)]
    odd = [(900, None, [1.0] * 16), (901, 0, None), (902, 0, [0.0] * 16), (903, 0, [float("nan")] * 16), (904, 0, []),
           (905, 0, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: r for r in collisions.near_duplicates(frame, block=64).collect()}
    v = np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[1] for r in rows])
    close = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    links = sum(found[i]["n_links"] for i in ids)
    assert 0.99 * close.sum() <= links <= close.sum() and close.sum() > 500
    if links == close.sum():
        want = partition([(ids[a], ids[b]) for a, b in np.argwhere(close)], ids)
        assert {i: found[i]["component_id"] for i in ids} == want
    assert all(found[o[0]]["n_links"] == 0 and found[o[0]]["kept"] for o in odd)
    assert collisions.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_without_id_or_of_any_magnitude(spark):
    rows = [(4, 1, [1.0, 2.0, 3.0]), (5, 1, [1.0, 2.0, 3.0]), (None, 1, [2.0, 4.0, 6.0]), (None, 2, [1.0, 0.0]), (None, 2, [1.0, 0.1]),
            (10, 3, [1e-200, 0.0, 0.0]), (11, 3, [0.0, 2e-200, 0.0]), (12, 3, [1e300, 1e299, 0.0]), (13, 3, [5e-324, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = sorted(map(tuple, collisions.near_duplicates(frame).collect()), key=repr)
    assert found == sorted([
        (4, 2, 4, True), (5, 2, 4, False), (None, 2, 4, False), (None, 1, None, True), (None, 1, None, True),
        (10, 2, 10, True), (11, 0, 11, True), (12, 2, 10, False), (13, 2, 10, False)], key=repr)


def test_embeddings_write_no_links_and_broadcast_no_table_that_grows(spark, monkeypatch):
    """320 near copies have 51,040 links, whose files are far smaller than their rows are in the driver's memory."""
    draw = np.random.default_rng(4)
    base, far = draw.standard_normal((2, 16))
    rows = [(i, 0, [float(x) for x in base + 0.01 * draw.standard_normal(16)]) for i in range(320)]
    rows += [(400 + i, 0, rows[7][2]) for i in range(3)] + [(500 + i, 1, [float(x) for x in far]) for i in range(2)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    written = []

    def kept(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        written.append((plan, cut_lineage(df)))
        return written[-1][1]

    monkeypatch.setattr(collisions, "cut_lineage", kept)
    monkeypatch.setattr(common, "cut_lineage", kept)
    result = collisions.near_duplicates(frame, block=64)
    found = sorted(map(tuple, result.collect()))
    assert found == sorted([(i, 322, 0, i == 0) for i, label, _ in rows if label == 0]
                           + [(500, 1, 500, True), (501, 1, 500, False)])
    # each point once for each of the five blocks, and both ways
    assert max(df.count() for _, df in written) <= 2 * 320 * 5
    plans = [plan for plan, _ in written] + [result._jdf.queryExecution().executedPlan().toString()]
    # only the sizes of labels with more points than a block
    assert ["members" in plan for plan in plans if "Broadcast" in plan] == [True]


def test_weights_and_roots_of_links():
    draw = np.random.default_rng(5)
    for n, count in ((1, 0), (2, 1), (40, 25), (40, 200)):
        pairs = sorted({(int(min(p)), int(max(p))) for p in draw.integers(0, n, (count, 2)) if p[0] != p[1]})
        weight = draw.integers(1, 9, n)
        links = [(q, np.array([b for a, b in pairs if a == q])) for q in sorted({a for a, _ in pairs})]
        others, root = collisions.gathered(links, weight)
        assert others.tolist() == [sum(int(weight[a + b - i]) for a, b in pairs if i in (a, b)) for i in range(n)]
        assert dict(enumerate(root.tolist())) == partition(pairs, range(n))


@pytest.mark.parametrize("block", [4096, 8])
def test_simhash_against_brute_force(docs, block):
    rows = list(EDGE)
    for g in range(12):
        text = prose(g, 120)
        for c in range(6):
            changed = list(text)
            for k in range(c // 2):
                changed[(7 * c + k) % 120] = f"z{c}"
            rows.append((20 + 10 * g + c, " ".join(changed)))
    marks = {(i, t): simhash.fingerprint(t.encode() if t is not None else None) for i, t in rows}
    ids = [i for i, _ in rows if i is not None]
    pairs = [(a[0], b[0]) for a in marks for b in marks if None not in (a[0], b[0])
             and (marks[a] ^ marks[b]).bit_count() <= 4]
    want = partition(pairs, ids)
    found = [r for r in simhash.near_duplicates(docs(rows)).collect() if r["id"] is not None]
    assert {r["id"]: r["component"] for r in found} == want
    if block < 4096:
        frame = docs(rows)
        marks_frame = simhash.fingerprints(frame).select("mark").distinct()
        groups = common.components(simhash.links(marks_frame, block=block)).count()
        assert groups == common.components(simhash.links(marks_frame)).count()
    kept = {r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()}
    assert kept - {None} == set(want.values())


def test_rows_without_id_are_judged_by_their_text(docs):
    text, other = " ".join(prose(1, 80)), " ".join(prose(2, 80))
    rows = [*EDGE, (20, text), (None, text), (None, other), (None, other)]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(rows)).collect()), key=repr)
    want = [(None, "a b"), (1, None), *[r for r in EDGE if (r[0] or 0) > 3], (20, text), (None, other)]
    assert kept == sorted(want, key=repr)
    assert simhash.keep_one(docs([])).count() == 0


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x<p>é"), (2, "http://b", "y\r\n\r\nWARC/1.1\r\n\r\n"), (3, "http://c d", "x<p>é"), (4, None, None),
             (5, "u", ""), (None, "n", "x<p>é"), (6, "u6", "z" * 300000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = warc.archived(frame, str(tmp_path / "w")).collect()
    assert len(found) == len(pages)
    for r in found:
        html = next(p[2] for p in pages if p[0] == r["page_id"]) or ""
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["payload_digest"], r["payload_bytes"]) == (digest, len(html.encode()))
    assert {r["page_id"]: r["refers_to"] for r in found if r["record_type"] == "revisit"} == {3: 1, 5: 4, None: 1}
    read = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).where("record_type = 'response'").collect()
    assert {r["page_id"]: r["payload"].decode() for r in read} == {p: h or "" for p, _, h in pages if p not in (3, 5, None)}
    assert warc.archived(frame.limit(0), str(tmp_path / "e")).count() == 0


def test_trigram_queries():
    by_kind = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert by_kind["hex"] == [] and by_kind["access"] == [{frozenset({"aki", "kia"})}]
    assert frozenset({"tok", "oke", "ken"}) in by_kind["assign"][0] and len(by_kind["assign"][0]) == 6


def test_secrets(docs):
    key = "AKIA" + "A1" * 8
    rows = [*EDGE, (20, f"漢 PassWord = 'abcdefgh1' and secret=tok: token:x {key}"), (21, "0" * 40), (22, "api_key:short"),
            (23, "secret=token:abcdefghijk")]
    found = [r for r in secret_scan.find(docs(rows)).collect()]
    assert len(found) == len(rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found if (r["doc_id"] or 0) >= 20}
    at = rows[-4][1].index(key)
    assert spans == {20: [(2, 0, 23), (at, 1, at + 20)], 21: [(0, 2, 40)], 22: [], 23: []}
    safe = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(rows)).collect() if (r["doc_id"] or 0) >= 20}
    assert safe[21] == "[SECRET]" and safe[20].startswith("漢 [SECRET]' and") and safe[22] == "api_key:short"


def test_toxicity_on_held_out_rows(docs):
    pick = random.Random(5)
    texts = [(i, " ".join(prose(i, 60)[:40] + pick.choices(["and", "the", "of"], k=20)
                          + pick.choices(["vile", "foul", "nasty"], k=1 + i % 6) * (i % 2))) for i in range(600)]
    model = toxicity.fit([(t, i % 2) for i, t in texts[:400]])
    marks = [(toxicity.severity(t, model) >= toxicity.REJECT) == bool(i % 2) for i, t in texts[400:]]
    assert sum(marks) / len(marks) > 0.97
    assert model.thresholds == tuple(sorted(model.thresholds)) and len(model.thresholds) == 3
    assert toxicity.severity("vile vile foul foul nasty nasty", model) > toxicity.severity("vile", model)
    assert set(toxicity.counts("Trash trashing trashing")) == {"trash", "tras*", "trashing", "trash*", "trashi*"}
    assert toxicity.counts("trash trashing trashing")["trash*"] == 2
    # compounds that the sample lacks are known by their onsets
    forms = [(" ".join(prose(i, 40) + [f"schund{i % 50}"] * (2 * (i % 2))), i % 2) for i in range(400)]
    unseen = toxicity.fit(forms)
    assert toxicity.severity(" ".join(prose(9999, 40) + ["schundwerk", "schundblatt"]), unseen) >= toxicity.REJECT
    assert toxicity.severity(" ".join(prose(9999, 40)), unseen) < toxicity.REJECT
    assert toxicity.fit([]).weights == {} and toxicity.severity("x", toxicity.fit([])) == 0
    assert toxicity.score(docs(EDGE), model).count() == len(EDGE)


def test_passages_against_brute_force(docs):
    shared = [prose(900 + k, 60 + 15 * k) for k in range(4)]
    rows = list(EDGE)
    for d in range(30):
        words = prose(d, 80 + 5 * d)
        if d % 2:
            cut = (7 * d) % 70
            words = words[:cut] + shared[d % 4] + words[cut:]
        rows.append((20 + d, "  ".join(words)))
    rows += [(70, rows[-1][1]), (71, " ".join(prose(3000, 49))), (72, " ".join(prose(3000, 49)))]
    seen, texts = {}, {}
    for n, (i, t) in enumerate(rows):
        words = (t or "").encode().split()
        texts.setdefault(i, words)
        for k in range(len(words) - 49):
            seen.setdefault(tuple(words[k:k + 50]), []).append((i, k))
    want = {}
    for places in seen.values():
        for i, k in places if len(places) > 1 else ():
            want.setdefault(i, set()).update(range(k, k + 50))
    found = {r["id"]: {w for s in r["spans"] for w in range(s["start"], s["end"])}
             for r in suffixes.passages(docs(rows)).collect()}
    assert found == want
    assert suffixes.passages(docs([])).count() == 0


def test_passages_of_rows_without_id(docs):
    """Texts that share an id, or have none, have their own spans."""
    shared, other = prose(950, 70), prose(951, 55)
    texts = [" ".join(prose(1, 30) + shared), " ".join(shared + prose(2, 9)), " ".join(prose(3, 7) + other), " ".join(other), " ".join(prose(4, 80))]
    want = [[(30, 100)], [(0, 70)], [(7, 62)], [(0, 55)]]
    for i in (None, 7):
        found = suffixes.passages(docs([(i, t) for t in texts] + [(i, None)])).collect()
        assert sorted([tuple(s) for s in r["spans"]] for r in found) == sorted(want) and {r["id"] for r in found} == {i}
    twice = suffixes.passages(docs([(None, texts[4])] * 3)).collect()
    assert [(r["id"], [tuple(s) for s in r["spans"]]) for r in twice] == [(None, [(0, 80)])]


def test_snapshots(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]
    rows = [(c, t, *turns[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "a"), (6, 1, "assistant", "other"), (None, 0, "user", "lost"), (7, None, "user", "<|im_end|>")]
    rows += [(8, t, "user", "again") for t in range(600)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["part"]): r for r in chats.formatted(frame).collect()}
    assert set(found) == {(2, 0), (6, 0), (7, 0), (8, 0), (8, 1), (8, 2)}
    assert (found[2, 0]["turns"], found[2, 0]["copies"]) == (4, 2)
    assert found[2, 0]["chat"].endswith("<|im_start|>unknown\n<|im_end|>\n")
    assert found[7, 0]["chat"].count("<|im_end|>") == 1
    assert chats.formatted(frame.limit(0)).count() == 0


def test_decontamination_against_brute_force(docs, spark):
    items = [(i, " ".join(prose(700 + i, 12 + 3 * (i % 9))) + ". " + " ".join(prose(800 + i, 6)) + ".") for i in range(40)]
    items += [(98, None), (99, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = list(EDGE), set()
    for d in range(60):
        words = prose(d, 200 + d)
        if d % 3 == 0:
            words[50 + d:50 + d] = [items[d % 40][1]]
            want.add((20 + d, d % 40))
        if d % 3 == 1:  # the question alone is no leak
            words[50:50] = items[d % 40][1].split(". ")[0].split()
        rows.append((20 + d, " ".join(words)))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    assert found == want
    clean = decontaminate.keep_clean(docs(rows), benchmark)
    assert clean.count() == len(rows) - len(want) and clean.columns == docs(rows).columns
    assert decontaminate.contaminated(docs(rows), benchmark.limit(0)).count() == 0


def test_targets(spark):
    rows = spark.createDataFrame([("=a", "a", 100), ("=b", "b", 1000), ("=c", "c", 400), ("-", None, 0)],
                                 "skey string, source string, size long")
    found = {r["source"]: r["target"] for r in mixture.targets(rows).collect()}
    assert found["a"] == 300 and found[None] == 0
    assert found["b"] == pytest.approx(800) and found["c"] == pytest.approx(400)


def test_mixture(docs, spark):
    rows = [*EDGE, *[(100 + i, " ".join(prose(i, 5 + i % 40))) for i in range(400)]]
    labels = spark.createDataFrame([(100, 1, 0), (100, 1, 0), (101, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = docs(rows).selectExpr("doc_id", "text", "case when doc_id % 4 = 0 then 'x' when doc_id % 4 > 0 then 'y' end as source")
    once = sorted(map(str, mixture.mix(mixture.weighted(frame, labels)).collect()))
    again = mixture.mix(mixture.weighted(frame.repartition(7), labels)).collect()
    assert once == sorted(map(str, again)) and len(once) == len(rows)
    by_source = {}
    for r in again:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by_source.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in by_source.values())
    assert mixture.mix(mixture.weighted(frame.limit(0), labels)).count() == 0


def test_columns_of_the_documents_stay_as_they_are(docs, spark):
    """Columns with names that operators use inside come through untouched."""
    names = ["spans", "severity", "_spans", "_severity", "_mark", "_group", "_first", "_n", "_secret_id", "_secret_rules",
             "vertex", "component", "mark", "id", "line", "key", "rules", "text_", "label", "count"]
    frame = docs([*EDGE, (20, "token = abcdefgh12 and more"), (21, " ".join(prose(3, 30)))])
    for name in names:
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    labels = spark.createDataFrame([(20, 1, 0), (21, 0, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "a question of some words. an answer.")], "item_id long, text string")
    results = {"simhash": simhash.keep_one(frame), "secrets": secret_scan.redact(frame),
               "toxicity": toxicity.keep_mild(frame, labels), "leaks": decontaminate.keep_clean(frame, benchmark),
               "lines": lines.removed(frame)}
    for operator, result in results.items():
        assert result.columns == frame.columns, operator
        rows = result.where("doc_id = 21").collect()
        assert all(r[name] == f"own {name}" for r in rows for name in names), operator
        assert rows or operator == "toxicity"


def test_toxicity_fit_is_a_minimum_of_its_likelihood():
    """Finite differences of the objective, written out here, vanish at the fitted weights; grades are held in order."""
    pick = random.Random(11)
    marks = ["vile", "foul", "nasty", "rotten", "filthy"]
    rows = []
    for i in range(500):
        toxic = i % 2
        words = [f"w{pick.randrange(120)}" for _ in range(40)] + pick.choices(marks, k=1 + i % 9) * toxic
        rows.append((" ".join(words), toxic))
    model = toxicity.fit(rows, rounds=1500)
    found = [toxicity.counts(t) for t, _ in rows]
    names = sorted({x for f in found for x in f})
    place = {x: k for k, x in enumerate(names)}
    column = np.concatenate([[place[x] for x in f] for f in found])
    count = np.concatenate([list(f.values()) for f in found])
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    toxic = np.array([t for _, t in rows])
    grade = toxicity.grades(column, row, count, toxic)
    assert set(grade[toxic == 0]) == {0} and set(grade[toxic == 1]) == {1, 2, 3}
    often = np.bincount(column, minlength=len(names)) >= toxicity.LEAST_DOCS
    share = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())

    def objective(w, cuts):
        score = np.bincount(row, np.log1p(count) * (w * often)[column], len(rows))
        edge = np.concatenate((np.zeros((len(rows), 1)), 1 / (1 + np.exp(score[:, None] - np.array(cuts))), np.ones((len(rows), 1))), 1)
        likely = edge[np.arange(len(rows)), grade + 1] - edge[np.arange(len(rows)), grade]
        return -(share * np.log(likely)).sum() + toxicity.RIDGE / 2 * (w * w).sum()

    w = np.array([model.weights.get(x, 0.0) for x in names])
    step = 1e-4
    for k in np.argsort(-abs(w))[:12]:
        move = step * (np.arange(len(w)) == k)
        slope = (objective(w + move, model.thresholds) - objective(w - move, model.thresholds)) / (2 * step)
        assert abs(slope) < 2e-3, (names[k], slope)
    for k in range(3):
        move = step * (np.arange(3) == k)
        slope = (objective(w, model.thresholds + move) - objective(w, model.thresholds - move)) / (2 * step)
        assert abs(slope) < 2e-3, (k, slope)
    base = objective(w, model.thresholds)
    draw = np.random.default_rng(1)
    assert all(objective(w + 0.05 * draw.standard_normal(len(w)), model.thresholds) > base for _ in range(20))
    # held-out graded texts: more telling words, more severity
    held = [(k, " ".join([f"w{pick.randrange(120)}" for _ in range(40)] + pick.choices(marks, k=k))) for k in (0, 2, 5, 9) for _ in range(25)]
    mean = {k: np.mean([toxicity.severity(t, model) for n, t in held if n == k]) for k in (0, 2, 5, 9)}
    assert mean[0] < toxicity.REJECT <= mean[2] < mean[5] < mean[9]
