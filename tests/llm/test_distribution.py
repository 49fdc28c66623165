"""Sharding, importance resampling and the divergence audit against plain Python on small tables."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from dosescreen.llm import divergence, resampling, sharding

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "é ß 漢字 Ab0 x1"), (4, "é ß 漢字 Ab0 x1"),
        (5, "Word " * 30000), (5, "an other text"), (6, "\x00\x7f`[{@/:")]


def prose(seed, n, many=10**6):
    pick = random.Random(seed)
    return " ".join(f"w{chr(97 + pick.randrange(many) % 26)}{pick.randrange(many)}" for _ in range(n))


def spark_hash(*values):
    seed = 42
    for v in values:
        if isinstance(v, bool):
            v = int(v).to_bytes(4, "little")
        elif isinstance(v, Int):
            v = v.to_bytes(4, "little")
        elif isinstance(v, int):
            v = v.to_bytes(8, "little", signed=True)
        elif isinstance(v, str):
            v = v.encode()
        seed = seed if v is None else xxhash.xxh64_intdigest(v, seed)
    return seed


class Int(int):
    """A 32-bit number, which Spark hashes by its four bytes."""


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shards_by_hand(rows, shards, nodes=sharding.NODES, slack=sharding.SLACK):
    """The shard of every row (id, text): one key after another walks the ring."""
    turn = sharding.TURN
    points = sorted((spark_hash("node", Int(s), k) % turn, s) for s in range(shards) for k in range(nodes))
    size = [len((t or "").encode()) + sharding.OVERHEAD for _, t in rows]
    total, most = sum(size), sum(size) / shards / sharding.PIECES
    same, copies, cells = Counter(t for _, t in rows), Counter(), defaultdict(list)
    for k, (i, t) in enumerate(rows):
        pieces = max(math.ceil(same[t] * size[k] / max(1, most)),
                     math.ceil(same[t] / max(1, len(rows) / shards / sharding.PIECES))) if same[t] > 1 else 1
        copies[i, t] += 1
        name = None if i is None else str(i)
        piece = 1 + signed(spark_hash(name, copies[i, t])) % pieces if pieces > 1 else 0
        h = spark_hash(signed(spark_hash("key", t, t is None)), piece) % turn
        node = next((n for n, (p, _) in enumerate(points) if h <= p), 0)
        cells[-int(math.log2(size[k])), spark_hash("slice", h) % sharding.SLICES, node].append(k)
    load, ready, found = [0] * shards, set(range(shards)), {}
    room = [int(-(-total // shards) * (1 + slack)) + 1] * shards
    waiting = {cell: cell[2] for cell in cells}
    while waiting:
        queues = defaultdict(list)
        for cell, at in waiting.items():
            while points[at % len(points)][1] not in ready:
                at += 1
            queues[points[at % len(points)][1]].append((cell, at % len(points)))
        waiting = {}
        for s, queue in queues.items():
            taken, empty, free = 0, not load[s], room[s] - load[s]
            for k, (cell, at) in enumerate(sorted(queue)):
                weight = sum(size[r] for r in cells[cell])
                taken += weight
                if taken <= free or (empty and not k):
                    load[s] += weight
                    found |= dict.fromkeys(cells[cell], s)
                else:
                    waiting[cell] = at
                    ready.discard(s)
        if waiting and not ready:
            extra = max(sum(size[r] for r in cells[c]) for c in waiting)
            room = [max(a, b) + extra for a, b in zip(room, load)]
            ready = set(range(shards))
    return found, load


@pytest.fixture(scope="module")
def texts():
    rows = [*EDGE, *[(100 + k, prose(k, 3 + k % 60)) for k in range(300)], *[(600 + k, "a common text") for k in range(150)]]
    return rows + [(7, "one row again and again")] * 130


def test_shards_against_a_walk_by_hand(docs, texts):
    found = sharding.placed(docs(texts), 6, columns=("doc_id", "text")).collect()
    where, load = shards_by_hand(texts, 6)
    want = Counter((*texts[k], s) for k, s in where.items())
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in found) == want
    for s in range(6):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(n for k, n in want.items() if k[2] == s)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == crc32((r["text"] or "").encode()) for r in found)
    # the one text that is larger than a shard has one for itself, and no other shard is above the mean
    assert sorted(load)[-1] == 30000 * 5 + 8 and sorted(load)[-2] <= 1.01 * sum(load) / 6


def test_shards_do_not_depend_on_the_layout(docs, texts):
    rows = [r for r in texts if r[0] != 5]
    once, again = (Counter(map(tuple, sharding.placed(f, 5, columns=("doc_id", "text")).drop("slot").collect()))
                   for f in (docs(rows), docs(rows[::-1]).repartition(7)))
    assert once == again
    load = Counter()
    for (_, _, size, _, shard), n in once.items():
        load[shard] += size * n
    assert max(load.values()) <= 1.02 * sum(load.values()) / 5 and min(load.values()) >= 0.98 * sum(load.values()) / 5
    assert sharding.placed(docs([]), 5).count() == 0 and sharding.placed(docs([(1, None)]), 5).count() == 1


def test_one_more_shard_moves_little(docs):
    frame = docs([(k, prose(k, 10 + k % 40)) for k in range(2000)]).cache()
    was, now = ({r["doc_id"]: r["shard"] for r in sharding.placed(frame, n).collect()} for n in (8, 9))
    moved = [k for k in was if was[k] != now[k]]
    assert len(moved) < 0.25 * len(was) and sum(now[k] == 8 for k in moved) > len(was) / 12


def test_shards_as_folders(docs, texts, tmp_path):
    frame = docs(texts).withColumn("shard", F.lit("own")).withColumn("_part", F.lit(1)).withColumn("key", F.lit(2))
    back = sharding.write_shards(frame, str(tmp_path / "shards"), 4)
    assert set(back.columns) == {*frame.columns, "shard_", "slot"} and back.where("shard = 'own'").count() == len(texts)
    assert back.select("shard_", "slot").distinct().count() == len(texts)


def features_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


@pytest.mark.parametrize("longest, finish", [(1, 8), (2, 4096)])
def test_resampling_against_plain_python(docs, spark, texts, longest, finish):
    def features(text):
        words = features_by_hand(text)
        return [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    rows = texts + [(700 + k % 60, prose(k % 70, 25, 50)) for k in range(200)]
    target = [(k, prose(k, 30, 50)) for k in range(20)] + [(None, None), (3, "")]
    raw, aim = (Counter(crc32(x.encode()) % 100 for _, t in part for x in features(t)) for part in (rows, target))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 100) / ((raw[b] + 1) * (t_all + 100)))) for b in range(100)}
    want = []
    for i, t in rows:
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(x.encode()) % 100] for x in features(t))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        want.append((i, len(features(t)), weight, score, len(features_by_hand(t))))
    eligible = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = len(eligible) * 10 // 100
    places = Counter((*r[:4], k + 1) for k, r in enumerate(eligible[:drawn]))
    places.update((*r[:4], None) for r in [*eligible[drawn:], *[r for r in want if r[4] < 20]])
    bench = spark.createDataFrame(target, "item_id long, text string")
    found = resampling.resampled(docs(rows).repartition(5), bench, buckets=100, longest=longest, finish=finish)
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect())
    assert got == places and drawn > 10
    assert resampling.resampled(docs([]), bench).count() == 0
    whole = resampling.resampled(docs(rows[:30]), bench.limit(0), columns=("doc_id", "text", "mark"))
    assert whole.count() == 30 and whole.columns[:3] == ["doc_id", "text", "mark"]


def test_cutoff_of_any_place(spark):
    pick = random.Random(1)
    keys = sorted((pick.randrange(20), pick.randrange(50), k) for k in range(3000))
    shuffled = keys[:]
    pick.shuffle(shuffled)
    frame = spark.createDataFrame(shuffled, "a long, b long, c long").repartition(9).cache()
    for place in (1, 2, 299, 1500, 3000):
        assert resampling.cutoff(frame, ["a", "b", "c"], place, finish=10) == keys[place - 1]


def audit_by_hand(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = Counter()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        counts[lang, None] = sum((counts[lang, s] for s in sources), Counter())
        p = {}
        for s in [*sources, None]:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(a, b, t):
            return (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])

        for s in sources:
            pairs = sorted((-sum(far(s, o, t) for t in kept), o.encode(), o) for o in sources if o != s)
            words = sorted((-far(s, None, t), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])[:top]
            for part, items in (("pair", pairs), ("term", words)):
                out.update((lang, s, part, name, -v, k + 1) for k, (v, _, name) in enumerate(items))
    return out


@pytest.mark.parametrize("block, slices", [(256, 32), (2, 3)])
def test_audit_against_plain_python(spark, block, slices):
    pick = random.Random(4)
    rows = [(None, None, None), (None, "a", ""), ("", "b", "x y"), ("en", None, None), ("de", "only", "ein Wort " * 20)]
    for k in range(400):
        source = pick.choice(["hot", "hot", "hot", "b", "é", "Z", None])
        rows.append((pick.choice(["en", "en", "fr"]), source, " ".join(
            f"{chr(65 + pick.randrange(26))}{chr(97 + min(pick.randrange(9), pick.randrange(9)))}é"[:2 + k % 2] for _ in range(k % 30))))
    rows += [("en", "hot", "the same text, again")] * 90 + [("en", "b", "the same text, again")] * 5 + [("fr", "lone", "0 1 2")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    frame = frame.withColumn("term", F.lit("own")).withColumn("n", F.lit(1))
    found = Counter(map(tuple, divergence.audit(frame, 10, 10, block=block, slices=slices)
                        .select("lang", "source", "part", "item", "value", "rank").collect()))
    assert found == audit_by_hand(rows, 10, 10)
    assert divergence.audit(frame.limit(0)).count() == 0
