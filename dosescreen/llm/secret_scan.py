"""Secrets found through a trigram inverted index; DataFrame functions only.

From every rule's pattern a Boolean query over trigrams is derived: the strings that each match must contain, as an AND
of clauses, each clause an OR of alternatives, each alternative an AND of trigrams. One pass over a text gives its
distinct trigrams that queries name, which are its postings (document, trigram) in the index. Postings are intersected per document, and only candidates of a rule are
verified with its pattern. A rule without a mandatory trigram has no query and scans every text.

Spans are counted in code points, the end excluded. Matches of a kind are the leftmost non-overlapping ones; different
kinds may overlap.

Defined results: a NULL text is empty and has no spans; rows that repeat an id are verified each by its own text; a NULL
id is joined like any other; an empty table gives an empty result; further columns are ignored or, by :func:`redact`,
kept as they are.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen.llm.common import fresh
from dosescreen.session import cut_lineage


class Rule(NamedTuple):
    """A kind of secret. ``least`` is the smallest length of ``group``; ``guard``, where given, is a cheaper pattern
    that any counting match contains."""

    kind: str
    pattern: str
    group: int
    least: int
    guard: str | None = None


# The kinds and patterns that results must agree with.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
# Formats of tokens and keys that their issuers document, each named by its prefix.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("xapp", r"xapp-[0-9]-[A-Za-z0-9-]+", 0, 20),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", 0, 60),
    Rule("glpat", r"glpat-[A-Za-z0-9_-]+", 0, 26),
    Rule("glsa", r"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}", 0, 46),
    Rule("AIza", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("ya29", r"ya29\.[A-Za-z0-9_-]+", 0, 30),
    Rule("GOCSPX", r"GOCSPX-[A-Za-z0-9_-]+", 0, 35),
    Rule("live_key", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("whsec", r"whsec_[A-Za-z0-9+/]+", 0, 38),
    Rule("SK", r"SK[0-9a-f]{32}", 0, 34, r"SK[0-9a-f]{32}"),
    Rule("SG", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 69),
    Rule("key", r"key-[0-9a-f]{32}", 0, 36),
    Rule("region_key", r"[0-9a-f]{32}-us[0-9]+", 0, 36),
    Rule("npm", r"npm_[A-Za-z0-9]+", 0, 40),
    Rule("pypi", r"pypi-AgEI[A-Za-z0-9_-]+", 0, 50),
    Rule("rubygems", r"rubygems_[0-9a-f]{48}", 0, 57),
    Rule("shop", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", 0, 38),
    Rule("sq0", r"sq0(?:atp|csp)-[A-Za-z0-9_-]+", 0, 29),
    Rule("v1", r"do[opr]_v1_[0-9a-f]{64}", 0, 71),
    Rule("dapi", r"dapi[0-9a-f]{32}", 0, 36),
    Rule("hf", r"hf_[A-Za-z]{34}", 0, 37),
    Rule("bot", r"[0-9]+:AA[A-Za-z0-9_-]{33}", 0, 44),
    Rule("hooks", r"/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", 0, 60),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}", 0, 74),
    Rule("hvs", r"hvs\.[A-Za-z0-9_-]+", 0, 28),
    Rule("atlas", r"\.atlasv1\.[A-Za-z0-9_-]+", 0, 60),
    Rule("NRAK", r"NRAK-[A-Z0-9]{27}", 0, 32),
    Rule("PMAK", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}", 0, 64),
    Rule("lin_api", r"lin_api_[A-Za-z0-9]+", 0, 48),
    Rule("dp", r"dp\.pt\.[A-Za-z0-9]+", 0, 46),
    Rule("account", r"AccountKey=[A-Za-z0-9+/=]+", 0, 99),
    Rule("userinfo", r"://[A-Za-z0-9._-]+:([A-Za-z0-9._%+!$*-]+)@", 1, 8),
)
RULES = BASE + EXTRA

#: Alternatives that a run of literals may unfold to; longer ones are cut into two runs.
UNFOLD = 64


def _strings(items) -> list[str] | None:
    """The lower-case strings that a piece of a pattern matches, if they are few."""
    found = [""]
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value).lower()]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            more = sorted({chr(v).lower() for _, v in value})
        elif name == "SUBPATTERN":
            more = _strings(value[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in value[1]]
            more = None if None in each else sorted({s for x in each for s in x})
        elif name == "MAX_REPEAT" and value[1] == 1:
            inner = _strings(value[2])
            more = None if inner is None else inner + [""] * (value[0] == 0)
        else:
            more = None
        if more is None or len(found) * len(more) > UNFOLD:
            return None
        found = [a + b for a, b in product(found, more)]
    return found


def _clauses(items) -> list[set[frozenset[str]]]:
    clauses: list[set[frozenset[str]]] = []
    run = [""]

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append({g for g in grams if not any(other < g for other in grams)})

    for item in items:
        more = _strings([item])
        if more is not None and len(run) * len(more) <= UNFOLD:
            run = [a + b for a, b in product(run, more)]
            continue
        close()
        run = more or [""]
        if more is None:
            name, value = str(item[0]), item[1]
            if name == "SUBPATTERN":
                clauses += _clauses(value[3])
            elif name == "MAX_REPEAT" and value[0] >= 1:
                clauses += _clauses(value[2])
    close()
    return clauses


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """AND of clauses; a clause is an OR of alternatives; an alternative is an AND of trigrams. Empty: scan fully."""
    return _clauses(re._parser.parse(pattern))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for grams in clause for g in grams})


def finder(grams: list[str]) -> str:
    """A pattern that has at each place where one of ``grams`` starts an empty match, the trigram as group 1.

    Alternatives branch by letter, so that a place costs about the same however many trigrams there are.
    """
    tree: dict[str, dict[str, str]] = {}
    for a, b, c in grams:
        tree.setdefault(a, {}).setdefault(b, "")
        tree[a][b] += re.escape(c)
    heads = [re.escape(a) + "(?:" + "|".join(f"{re.escape(b)}[{c}]" for b, c in of.items()) + ")" for a, of in tree.items()]
    return f"(?=({'|'.join(heads)}))"


def index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (id, gram) of ``grams`` in whole lower-cased texts, each read once."""
    low = F.lower(F.col(text_col))
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(finder(grams)), F.lit(1)))
    return docs.select(F.col(id_col).alias("id"), F.explode(held).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, rules): the numbers of the rules whose trigram query the postings of a document satisfy."""
    held = postings.groupBy("id").agg(F.collect_set("gram").alias("grams"))

    def satisfied(rule: Rule) -> Column:
        whole = F.lit(True)
        for clause in trigram_query(rule.pattern):
            some = F.lit(False)
            for grams in sorted(map(sorted, clause)):
                every = F.lit(True)
                for g in grams:
                    every = every & F.array_contains("grams", g)
                some = some | every
            whole = whole & some
        return whole

    met = F.array_compact(F.array(*[F.when(satisfied(r), F.lit(i)) for i, r in enumerate(rules) if trigram_query(r.pattern)]))
    return held.select("id", met.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end): lengths of the matches and of the gaps between them, summed up."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("n"), F.length(p).alias("least"))),
                       gaps, lambda m, g: F.struct(m["n"].alias("n"), m["least"].alias("least"), F.length(g).alias("gap")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.aggregate(
        F.filter(steps, lambda s: s["n"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"]).alias("at"),
            F.when(s["least"] >= rule.least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), F.lit(number).alias("kind"),
                (acc["at"] + s["gap"] + s["n"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
         output: str = "spans") -> DataFrame:
    """``docs`` with a column ``output``, which replaces one of that name: array of (start, kind as number of the rule,
    end), by start, then kind."""
    hits = cut_lineage(candidates(index(docs, vocabulary(rules), id_col, text_col), rules))
    held_id, held_rules = fresh(docs, "_secret_id", "_secret_rules")
    hits = hits.select(F.col("id").alias(held_id), F.col("rules").alias(held_rules))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for number, rule in enumerate(rules):
        due = F.array_contains(held_rules, number) if trigram_query(rule.pattern) else F.lit(True)
        if rule.guard:
            due = due & F.rlike(text, F.lit(rule.guard))
        found.append(F.when(due, _spans(text, rule, number)).otherwise(none))
    joined = docs.join(hits, docs[id_col].eqNullSafe(hits[held_id]), "left")
    return joined.withColumn(output, F.array_sort(F.concat(*found))).drop(held_id, held_rules)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one. Other texts stay as they are."""
    (spans,) = fresh(docs, "_spans")
    found = find(docs, rules, id_col, text_col, spans)
    text = F.col(text_col)
    pieces = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, pieces).otherwise(text)).select(docs.columns)
