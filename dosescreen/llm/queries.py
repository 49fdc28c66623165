"""One query for each operator of this package, over its whole table, with the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosescreen.llm import (
    chats, collisions, decontaminate, divergence, lines, mixture, resampling, secret_scan, sharding, simhash, suffixes,
    toxicity, warc,
)
from dosescreen.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


PASSAGES_SQL = f"""WITH cut AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '[\\n.!?]') AS p FROM documents)),
sited AS (SELECT doc_id, piece, i, coalesce(sum(len(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, trim(regexp_replace(lower(piece), '\\s+', ' ', 'g')) AS unit FROM cut),
units AS (SELECT doc_id, s, s + len(piece) AS e, unit, len(unit) - len(replace(unit, ' ', '')) + 1 AS words,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM sited WHERE unit <> ''),
kept AS (SELECT unit, min({{'d': doc_id, 's': s}}) AS k FROM units GROUP BY unit HAVING count(DISTINCT doc_id) > 1),
met AS (SELECT doc_id, s, e, words, place, k.d <> doc_id OR k.s <> s AS later FROM units JOIN kept USING (unit)),
placed AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run,
  place - row_number() OVER (PARTITION BY doc_id, later ORDER BY place) AS gone FROM met),
runs AS (SELECT doc_id, sum(n)::BIGINT AS repeated_units, sum(l)::BIGINT AS later_units, max(w)::BIGINT AS longest_run FROM (
  SELECT doc_id, run, count(*) AS n, count(*) FILTER (later) AS l, sum(words) AS w FROM placed GROUP BY ALL) GROUP BY ALL),
spans AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS removed FROM (SELECT doc_id, gone, min(s) AS s, max(e) AS e
  FROM placed WHERE later GROUP BY ALL HAVING sum(words) >= {lines.RUN}) GROUP BY ALL),
counted AS (SELECT doc_id, count(*) AS units FROM units GROUP BY ALL)
SELECT d.doc_id, coalesce(units, 0) AS units, coalesce(repeated_units, 0) AS repeated_units, coalesce(later_units, 0)
  AS later_units, coalesce(longest_run, 0) AS longest_run, coalesce(longest_run, 0) >= {lines.RUN} AS repeats_passage,
  coalesce(removed, '') AS removed
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN counted USING (doc_id)"""


@query("op1_repeated_lines", PASSAGES_SQL)
def op1_repeated_lines(spark, folder):
    """Sentences inside lines: passages that were pasted into longer lines repeat these and no whole line."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string")))
    return lines.passages(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "units", "repeated_units", "later_units", "longest_run",
        (F.col("longest_run") >= lines.RUN).alias("repeats_passage"), F.array_join(spans, ",").alias("removed"))


#: Every line with a word in it, however short.
ALL_LINES_SQL = """WITH cut AS (SELECT doc_id, l, i, l[i] AS line FROM (
  SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
units AS (SELECT doc_id, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: len(x) + 1)), 0) AS s, len(line) AS n,
  trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS unit FROM cut),
filled AS (SELECT * FROM units WHERE unit <> ''),
kept AS (SELECT unit, min({'d': doc_id, 's': s}) AS k FROM filled GROUP BY unit)
SELECT doc_id, s AS start_pos, s + n AS end_pos, k.d AS kept_doc_id, k.s AS kept_start FROM filled JOIN kept USING (unit)
WHERE k.d <> doc_id OR k.s <> s"""


@query("op1_all_repeated_lines", ALL_LINES_SQL)
def op1_all_repeated_lines(spark, folder):
    return lines.repeats(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.col("first").alias("start_pos"), F.col("last").alias("end_pos"),
        F.col("kept_id").alias("kept_doc_id"), F.col("kept_first").alias("kept_start"))


@query("op2_embedding_collisions")
def op2_embedding_collisions(spark, folder):
    return collisions.near_duplicates(table(spark, folder, "embeddings"))


@query("op3_simhash_variants")
def op3_simhash_variants(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("mark")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(t) AS n, array_to_string(flatten(list_transform(range(0, 4), lambda c: list_transform(
  range(0, 8), lambda k: substr('{warc.BASE32}', ((('0x' || substr(h, CAST(c * 10 + 1 AS INT), 10))::BIGINT
  >> CAST(35 - 5 * k AS INT)) & 31)::INT + 1, 1)))), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, n AS payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM f"""


@query("op4_warc_revisits", WARC_SQL)
def op4_warc_revisits(spark, folder):
    found = warc.archived(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: lengths of gaps and matches, summed up."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, len(list_aggregate(g[1:i], 'string_agg', '')) +
  coalesce(len(list_aggregate(m[1:i - 1], 'string_agg', '')), 0) AS s, len(m[i]) AS n
FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id,
  regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v,
  string_split_regex(t, '{quoted}') AS g FROM texts))
WHERE len(v[i]) >= {least}"""


_RULES = list(enumerate(secret_scan.RULES))
# the hexadecimal rule's runs are short words mostly; asking for 32 at once finds the same runs
_HEX = "[0-9a-f]{32,}"
SECRETS_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans_sql(r.kind, i, _HEX if r.kind == "hex" else r.pattern, r.group, r.least) for i, r in _RULES)}),
joined AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
  count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < {len(secret_scan.BASE)}) AS base,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)"""


def _of_kind(number: int):
    return lambda span: span["kind"] == number


@query("op5_secret_trigrams", SECRETS_SQL)
def op5_secret_trigrams(spark, folder):
    found = secret_scan.find(table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{r.kind}")
             for i, r in enumerate(secret_scan.BASE)]
    base = secret_scan.listed(F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE)))
    return found.select("doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"),
                        secret_scan.listed(F.col("spans")).alias("spans"))


@query("op6_toxicity_ordinal")
def op6_toxicity_ordinal(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fitted(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, columns=["doc_id"])
    return scored.withColumn("toxic", F.col("severity") >= toxicity.REJECT)


@query("op7_suffix_minimisers")
def op7_suffix_minimisers(spark, folder):
    found = suffixes.passages(table(spark, folder, "documents"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(F.col("id").alias("doc_id"), words.alias("repeated_words"), F.array_join(shown, ",").alias("spans"))


CHATS_SQL = """WITH t AS (SELECT conv_id, turn, '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '<' || chr(8203) || '|')
  || chr(10) || replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') || '<|im_end|>' || chr(10) AS piece
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(piece ORDER BY turn) AS l FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
kept AS (SELECT min(conv_id) AS conv_id, l, count(*) AS copies FROM c GROUP BY l)
SELECT conv_id, 0::BIGINT AS part, len(l) AS turns, copies, array_to_string(l, '') AS chat
FROM kept ANTI JOIN proper USING (l)"""


@query("op8_chat_snapshots", CHATS_SQL)
def op8_chat_snapshots(spark, folder):
    return chats.formatted(table(spark, folder, "conversations"))


@query("op9_bm25_decontamination")
def op9_bm25_decontamination(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_mixture_sampling")
def op10_mixture_sampling(spark, folder):
    rows = mixture.weighted(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return mixture.mix(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SHARDS = 24


@query("op11_hash_ring_shards")
def op11_hash_ring_shards(spark, folder):
    found = sharding.placed(table(spark, folder, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's table follows from its polynomial; only distinct words are hashed.
RESAMPLING_SQL = f"""WITH steps AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(
  list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1
  THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i))),
texts AS (SELECT row_number() OVER () AS r, 'd' AS side, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), 'b', NULL, text FROM benchmark),
words AS (SELECT r, side, doc_id, unnest(w) AS word FROM (SELECT r, side, doc_id, regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts)),
hexes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2),
  lambda k: ('0x' || substr(x, (2 * k + 1)::INT, 2))::BIGINT)), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])),
  4294967295) % {resampling.BUCKETS} AS bucket FROM hexes, steps),
placed AS (SELECT r, side, doc_id, bucket FROM words JOIN hashed USING (word)),
totals AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 'b') AS t_all FROM placed),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + {resampling.BUCKETS})::DOUBLE
  / ((s + 1) * (t_all + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM (SELECT bucket,
  (count(*) FILTER (side = 'd'))::DOUBLE AS s, (count(*) FILTER (side = 'b'))::DOUBLE AS t FROM placed GROUP BY bucket), totals),
sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
  / 4294967296::DOUBLE)))::BIGINT AS score FROM texts LEFT JOIN sums USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (n_features >= {resampling.LEAST_WORDS}) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resampling.LEAST_WORDS}
  AND place <= {resampling.PERCENT} * eligible // 100 THEN place END AS rank FROM ranked"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12_importance_resampling(spark, folder):
    found = resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


DIVERGENCE_SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
  coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
held AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL
  HAVING count(*) >= {divergence.LEAST_DOCS}),
cells AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d)
  JOIN held USING (lang, term) GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM held GROUP BY ALL) h ON g.lang = h.lang),
p AS (SELECT s.lang, s.source, h.term, coalesce(n, 0) AS n,
  1 + {divergence.SCALE}::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM sized s JOIN held h ON s.lang = h.lang LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = h.term),
q AS (SELECT lang, term, 1 + {divergence.SCALE}::HUGEINT * (of_term + 2) // (total + 2 * v) AS q FROM
  (SELECT lang, term, sum(n) AS of_term FROM cells GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total FROM cells GROUP BY ALL)
  USING (lang) JOIN (SELECT lang, count(*) AS v FROM held GROUP BY ALL) USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sized a JOIN sized b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
