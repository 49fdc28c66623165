"""Exposure categories from catalogue paths and product lists."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import text as txt
from dosescreen.functions.rules import append_match, first_match, flag_text
from dosescreen.operators.aggregates import collapse_distinct, count_by, distinct_by
from dosescreen.operators.joins import join_on, member_of
from dosescreen.operators.reshape import named, quoted, stack_rows
from dosescreen.session import cut_lineage


def catalogue_records(
    paths: DataFrame, ids: DataFrame, universe: DataFrame, record: str = "cpdat_substance_record_id",
    chem: str = "casrn", universe_key: str = "casn", banned: str = fixed.BANNED_PATH,
) -> DataFrame:
    """Distinct (source, cassette, record) with their chemical, without banned paths, for chemicals of the universe.

    Paths that :func:`labelled` has numbered keep their numbers.
    """
    path = ["source", "cassette", record, *_numbered(paths)]
    kept = paths.where(txt.not_matches("cassette", banned)).select(*[quoted(c) for c in path])
    # the id table is cut to the universe first, so the wide side is joined with what can still match
    known = member_of(ids, chem, universe, universe_key).select(quoted(record), quoted(chem)).distinct()
    # counted behind the join, where a record's rows are together: the wide side is exchanged once, by record
    counted = count_by(join_on(kept, known, [record], "inner"), [*path, chem], "repeats")
    return counted.select(*[quoted(c) for c in (*path, "repeats", chem)])


def broad_label(
    source_rules=None, term_rules=None, path_rules=None, path_appends=None,
) -> dict[str, Column]:
    """The category columns of a record, in the order in which they are to be added to the table."""
    source_rules = fixed.SOURCE_RULES if source_rules is None else source_rules
    term_rules = fixed.TERM_RULES if term_rules is None else term_rules
    path_rules = fixed.PATH_RULES if path_rules is None else path_rules
    path_appends = fixed.PATH_APPENDS if path_appends is None else path_appends
    cassette, third, fourth = F.col("cassette"), F.col("cassette3"), F.col("cassette4")
    joined = F.concat(third, F.lit(fixed.CONSUMER_SEPARATOR + fixed.CONSUMER_LABEL))
    appended = None
    for pattern, label, covered, ruled_out in path_appends:
        test = txt.matches(cassette, pattern) & ~txt.in_values(fourth, covered) & ~txt.in_values(third, ruled_out)
        value = F.concat(fourth, F.lit(", " + label))
        appended = F.when(test, value) if appended is None else appended.when(test, value)
    return {
        "fromsource": first_match(source_rules, cassette),
        "split": txt.term("fromsource"),
        "cassette3": first_match(term_rules, F.col("split")),
        "cassette3_": F.when(
            txt.in_values(third, fixed.CONSUMER_JOINED) & txt.matches(cassette, fixed.CONSUMER_TERM), joined
        ).when(txt.matches("fromsource", fixed.CONSUMER_TERM), F.lit(fixed.CONSUMER_LABEL)).otherwise(third),
        "cassette4": first_match(path_rules, third),
        "cassette4_": fourth if appended is None else appended.otherwise(fourth),
    }


def by_distinct(df: DataFrame, fields: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``add`` derives from ``fields``, derived once for each distinct value of these.

    Catalogues repeat few paths over many records, and a step tries dozens of patterns. The values are combined in the
    map tasks and joined back, NULL matching NULL; ``df`` is settled, as both sides read it.
    """
    df = cut_lineage(df)
    return join_on(df, add(distinct_by(df, fields)), fields, null_keys_match=True)


# what the rules of catalogues and of products read
PATH, PRODUCT = ["source", "cassette"], ["product_use_category"]


def _categorised(paths: DataFrame, **rules) -> DataFrame:
    out = paths
    for name, expression in broad_label(**rules).items():
        out = out.withColumn(name.rstrip("_"), expression)
    return out


def categorise(records: DataFrame, **rules) -> DataFrame:
    """Add ``fromsource``, ``split``, ``cassette3`` and the broad category ``cassette4`` to catalogue records."""
    return by_distinct(records, PATH, lambda paths: _categorised(paths, **rules))


# the numbers of the texts that a path or a product use gives a chemical: its broad category and its specific use
NUMBERS = {"__broad": "cassette4", "__use": "Other"}


def _numbered(table: DataFrame) -> list[str]:
    return [n for n in NUMBERS if n in table.columns]


def product_uses(
    ids: DataFrame, ingredients: DataFrame, products: DataFrame, universe: DataFrame,
    record: str = "cpdat_substance_record_id", product: str = "product_id", chem: str = "casrn",
    universe_key: str = "casn",
) -> DataFrame:
    """Distinct (chemical, product use, source) with the number of products behind it.

    Products that :func:`labelled` has numbered keep their numbers.
    """
    use = ["product_use_category", "source", *_numbered(products)]
    known = member_of(ids, chem, universe, universe_key).select(quoted(record), quoted(chem))
    used = products.where(F.col("product_use_category").isNotNull()).select(
        quoted(product), *[quoted(c) for c in use]
    )
    parts = join_on(ingredients.select(quoted(record), quoted(product)), known, [record], "inner")
    joined = join_on(parts, used, [product], "inner")
    return count_by(joined, [chem, *use], "repeats")


def categorise_products(uses: DataFrame, rules=None) -> DataFrame:
    """Everything in the product list is a consumer product, some also pesticides."""
    rules = fixed.PRODUCT_RULES if rules is None else rules
    return by_distinct(uses, PRODUCT, lambda p: p.withColumn("cassette4", first_match(rules, F.lit(fixed.PRODUCT_DEFAULT))))


def _titled(label: Column) -> Column:
    return txt.underscores_to_spaces(txt.title_case(label))


def _collapse_titles(tables: list[DataFrame], label: str, chem: str, out: str) -> DataFrame:
    """Distinct labels per chemical over all tables, title-cased, underscores as blanks, in one sorted cell."""
    stacked = None
    for table in tables:
        part = table.select(quoted(chem), quoted(label))
        stacked = part if stacked is None else stack_rows(stacked, part)
    return collapse_distinct(stacked, [chem], label, out, shown=_titled)


def _with_flags(broad: DataFrame) -> DataFrame:
    flagged = broad.withColumns({n: flag_text(txt.matches("broad", p)) for n, p in fixed.BROAD_FLAGS.items()})
    nothing = F.col("broad") != " "
    for n in fixed.BROAD_FLAGS:
        nothing = nothing & (quoted(n) == "0")
    return flagged.withColumn(fixed.UNCATEGORISED, flag_text(nothing))


def category_flags(tables: list[DataFrame], chem: str = "casrn", label: str = "cassette4") -> DataFrame:
    """One row per chemical: all broad categories in one cell and a 0/1 flag per main category."""
    return _with_flags(_collapse_titles(tables, label, chem, "broad"))


class Labels(NamedTuple):
    """The numbers of the texts of every distinct path and product use, and the text of every number."""

    paths: DataFrame
    products: DataFrame
    texts: DataFrame


def number_labels(paths: DataFrame, products: DataFrame) -> Labels:
    """Derive and title-case the labels of every distinct path and product use once, and number the distinct texts.

    All three tables are settled: a number stays what it is, and the planner knows how few labels there are beside rows.
    """
    broad = first_match(fixed.PRODUCT_RULES, F.lit(fixed.PRODUCT_DEFAULT))
    derived = {
        tuple(PATH): _categorised(_used(distinct_by(paths, PATH), fixed.USE_RULES, fixed.USE_APPENDS)),
        tuple(PRODUCT): _product_used(distinct_by(products, PRODUCT), fixed.PRODUCT_USE_RULES).withColumn("cassette4", broad),
    }
    settled = {
        fields: cut_lineage(df.select(*[quoted(f) for f in fields], *[_titled(quoted(c)).alias(n) for n, c in NUMBERS.items()]))
        for fields, df in derived.items()
    }
    shown = F.array(*[F.struct(F.lit(n).alias("__kind"), quoted(n).alias("__text")) for n in NUMBERS])
    texts = cut_lineage(
        stack_rows(*[df.select(F.inline(shown)) for df in settled.values()]).distinct()
        .withColumn("__number", F.monotonically_increasing_id())
    )
    numbered = []
    for fields, df in settled.items():
        for n in NUMBERS:
            kind = texts.where(F.col("__kind") == n).select(F.col("__text").alias(n), F.col("__number").alias(n + "_number"))
            df = join_on(df, kind, [n], "inner", null_keys_match=True)
        numbered.append(cut_lineage(df.select(*[quoted(f) for f in fields], *[F.col(n + "_number").alias(n) for n in NUMBERS])))
    return Labels(*numbered, texts)


def labelled(table: DataFrame, numbers: DataFrame) -> DataFrame:
    """``table`` with the numbers that :func:`number_labels` has given the texts of its paths or product uses."""
    return join_on(table, numbers, [c for c in numbers.columns if c not in NUMBERS], null_keys_match=True)


def _number_sets(table: DataFrame, chem: str) -> DataFrame:
    """The numbers of each chemical, 64 to a word: bits are combined in the map tasks, so a row is a few whole numbers.

    The planner drops a count below this that is not read: a repeated number sets the same bit.
    """
    words = [F.shiftright(n, 6).alias(n + "_word") for n in NUMBERS]
    bits = [F.bit_or(F.expr(f"shiftleft(1L, CAST({n} & 63 AS INT))")).alias(n + "_bits") for n in NUMBERS]
    return table.groupBy(quoted(chem), *words).agg(*bits)


def _joined_sets(tables: list[DataFrame], chem: str) -> DataFrame:
    """The sets of two tables as one, with the rows of a chemical in one place."""
    dealt = stack_rows(*tables).repartition(quoted(chem))
    return dealt.groupBy(quoted(chem), *[n + "_word" for n in NUMBERS]).agg(
        *[F.bit_or(n + "_bits").alias(n + "_bits") for n in NUMBERS]
    )


def source_summary(
    records: DataFrame, uses: DataFrame, chem: str = "casrn", labels: Labels | None = None,
) -> DataFrame:
    """Broad categories with their flags and specific uses of every chemical, from one pass over both inputs.

    Gives the same rows as joining :func:`category_flags` and :func:`specific_uses`. What is dealt out by chemical are
    the numbers of its texts, and the texts come to it there. With ``labels``, by which both inputs were numbered before,
    no path is exchanged or written; without, both are settled and numbered here.
    """
    if labels is None:
        records, uses = (
            cut_lineage(t) for t in (records.select(quoted(chem), *PATH), distinct_by(uses, [chem, *PRODUCT]))
        )
        labels = number_labels(records, uses)
        records, uses = labelled(records, labels.paths), labelled(uses, labels.products)
    sets = _joined_sets([_number_sets(t, chem) for t in (records, uses)], chem)
    kinds = F.array(*[
        F.struct(F.lit(n).alias("__kind"), F.col(n + "_word").alias("__word"), F.col(n + "_bits").alias("__bits"))
        for n in NUMBERS
    ])
    texts = labels.texts.select(
        "__kind", F.shiftright("__number", 6).alias("__word"), "__text", F.expr("CAST(__number & 63 AS INT)").alias("__bit")
    )
    shown = join_on(sets.select(quoted(chem), F.inline(kinds)), texts, ["__kind", "__word"], "inner").where(
        F.getbit("__bits", F.col("__bit")) == 1
    )

    def cell(number: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("__kind") == number, F.col("__text")))), ", ")

    cells = shown.groupBy(quoted(chem)).agg(
        cell("__broad").alias("broad"), F.regexp_replace(cell("__use"), "^ , ", " ").alias("Other")
    )
    return _with_flags(cells)


def _used(paths: DataFrame, rules, appends) -> DataFrame:
    first = paths.withColumn("term1", txt.term("cassette")).withColumn("Other", first_match(rules, F.lit(fixed.NO_USE)))
    return first.withColumn("Other", append_match(appends, F.col("cassette"), F.col("Other"))).drop("term1")


def catalogue_uses(records: DataFrame, rules=None, appends=None) -> DataFrame:
    """Specific use of catalogue records: the first rule that applies, then at most one appended use."""
    rules = fixed.USE_RULES if rules is None else rules
    appends = fixed.USE_APPENDS if appends is None else appends
    return by_distinct(records, ["cassette"], lambda paths: _used(paths, rules, appends))


def _product_used(products: DataFrame, rules) -> DataFrame:
    first = products.withColumn("Other", first_match(rules, F.lit(fixed.NO_USE)))
    personal = txt.matches("product_use_category", fixed.PERSONAL_PRODUCT)
    return first.withColumn(
        "Other",
        F.when(personal & (F.col("Other") != fixed.NO_USE), F.concat(F.lit(fixed.PERSONAL_LABEL + ", "), F.col("Other")))
        .when(personal, F.lit(fixed.PERSONAL_LABEL)).otherwise(F.col("Other")),
    )


def product_specific_uses(uses: DataFrame, rules=None) -> DataFrame:
    """Specific use of products; a personal-care product names that first."""
    rules = fixed.PRODUCT_USE_RULES if rules is None else rules
    return by_distinct(uses, PRODUCT, lambda products: _product_used(products, rules))


def specific_uses(tables: list[DataFrame], chem: str = "casrn") -> DataFrame:
    """One row per chemical with all specific uses in one cell."""
    collapsed = _collapse_titles(tables, "Other", chem, "Other")
    return collapsed.withColumn("Other", F.regexp_replace("Other", "^ , ", " "))


def with_predictions(
    summary: DataFrame, universe: DataFrame, predictions: DataFrame,
    chem: str = "casrn", universe_key: str = "casn", prediction_key: str = "CAS", pathway: str = "Pathway",
) -> DataFrame:
    """All chemicals of the universe with their flags; ``1*`` where a category is only predicted."""
    everyone = join_on(summary, universe.select(quoted(universe_key)), {chem: universe_key}, "right")
    predicted = predictions.select(quoted(prediction_key), quoted(pathway))
    joined = join_on(everyone, predicted, {chem: prediction_key})
    joined = joined.withColumn(pathway, txt.recode(quoted(pathway), fixed.ALL_PATHWAYS))
    flagged = joined.withColumns({
        n: F.when(txt.matches(quoted(pathway), p) & txt.null_or(quoted(n), "0"), F.lit(fixed.PREDICTED))
        .otherwise(quoted(n))
        for n, p in fixed.PREDICTED_FLAGS.items()
    })
    unknown = quoted(pathway) == fixed.UNKNOWN_PATHWAY
    for n in fixed.PREDICTED_FLAGS:
        unknown = unknown & quoted(n).isNull()
    return flagged.withColumn(
        fixed.NO_INFORMATION, F.when(F.coalesce(unknown, F.lit(False)), F.lit("1")).otherwise(F.lit(" "))
    )


def with_tokens(df: DataFrame, text: str, out: str, separator: str = ",") -> DataFrame:
    """Add an array of the row's distinct tokens as (place, value), ordered by place.

    Repeats go before blanks are trimmed, and a token keeps its first place. Works inside the row: sorting brings equal
    tokens together, and each is compared with its neighbour by zipping the sorted array with itself moved by one. The
    cost grows with n log n even for a very long text, and nothing is shuffled.
    """
    placed = F.sort_array(F.transform(
        F.split(quoted(text), separator), lambda t, i: F.struct(t.alias("raw"), (i + 1).alias("place"))
    ))
    moved = F.concat(F.expr("array(CAST(NULL AS struct<raw: string, place: int>))"), placed)
    pairs = F.arrays_zip(placed.alias("this"), moved.alias("before"))
    pattern, label = fixed.PERSONAL_TOKEN

    def first(pair: Column) -> Column:
        token, before = pair["this"]["raw"], pair["before"]["raw"]
        return token.isNotNull() & ~before.eqNullSafe(token) & ~txt.is_blank(token)

    def shown(pair: Column) -> Column:
        trimmed = txt.trim_left(pair["this"]["raw"])
        value = F.when(txt.matches(trimmed, pattern), F.lit(label)).otherwise(trimmed)
        return F.struct(pair["this"]["place"].alias("place"), value.alias("value"))

    return df.withColumn(out, F.sort_array(F.transform(F.filter(pairs, first), shown)))


def use_tokens(table: DataFrame, key: str = "casrn", text: str = "Other", separator: str = ",") -> DataFrame:
    """One row per key and distinct token with the token's first place."""
    cells = with_tokens(table.select(named(key), named(text)), text, "__tokens", separator)
    # the outer form, because for the inner one the planner would compute the tokens a second time to test for none
    return cells.select(named(key), F.inline_outer("__tokens")).where("place IS NOT NULL")


def tokens_to_rows(table: DataFrame, text: str = "Other") -> DataFrame:
    """All rows of ``table``, repeated per token; ``source`` names the token's place (``V1``, ``V2``, ...)."""
    rows = with_tokens(table, text, "__tokens").select(
        *[named(c) for c in table.columns], F.inline_outer("__tokens")
    )
    return rows.withColumn("source", F.concat(F.lit("V"), F.col("place").cast("string"))).drop("place")


def rows_to_tokens(tokens: DataFrame, key: str = "casrn", out: str = "Sources of Interest") -> DataFrame:
    """Token rows of a key back in one lower-case cell, in the order of their places."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))
    return tokens.groupBy(quoted(key)).agg(
        F.lower(F.array_join(F.transform(ordered, lambda t: t["value"]), ", ")).alias(out)
    )


def tidy_sources(table: DataFrame, text: str = "Other", out: str = "Sources of Interest") -> DataFrame:
    """``table`` with its tokens in one lower-case cell, empty where there are none."""
    values = F.transform("__tokens", lambda t: t["value"])
    return with_tokens(table, text, "__tokens").withColumn(
        out, F.coalesce(F.lower(F.array_join(values, ", ")), F.lit(""))
    ).drop(text, "__tokens")
