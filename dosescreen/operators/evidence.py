"""Toxicity evidence: studies, cancer calls, regulatory lists, and their merger into one row per chemical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import text as txt
from dosescreen.functions.rules import class_of, flag_number
from dosescreen.operators.aggregates import collapse_distinct, has_any
from dosescreen.operators.joins import join_on, member_of, with_membership
from dosescreen.operators.reshape import named, on_text_columns, quoted, rename, widen


def classify_studies(studies: DataFrame) -> DataFrame:
    """Add the study flag, kind of value, study type, effect type and the summary text of each study."""
    risk = F.lower("risk_assessment_class")
    relevant = (
        txt.matches(risk, fixed.STUDY_CLASS)
        & F.coalesce(risk != fixed.STUDY_CLASS_EXCLUDED, F.lit(False))
        & txt.matches("species_supercategory", fixed.STUDY_SPECIES)
    )
    study = F.col("is_study") == 1
    kind = F.when(study & txt.in_values("toxval_type", fixed.EFFECT_TYPES), F.lit("effect")).when(
        study & txt.in_values("toxval_type", fixed.NO_EFFECT_TYPES), F.lit("no effect")
    )
    names = fixed.STUDY_TYPES
    study_type = (
        F.when(study & (F.col("risk_assessment_class") == fixed.STUDY_CLASS_BOTH), F.lit(names["both"]))
        .when(txt.matches("risk_assessment_class", "repro"), F.lit(names["repro"]))
        .when(study & txt.matches("risk_assessment_class", "dev"), F.lit(names["dev"]))
        .otherwise(F.lit(""))
    )
    below = (
        txt.in_values("toxval_numeric_qualifier", fixed.AT_MOST)
        & (F.col("toxval_numeric") < fixed.STUDY_THRESHOLD) & (F.col("toxval_units") == fixed.STUDY_UNITS)
    )
    above = (
        txt.in_values("toxval_numeric_qualifier", fixed.AT_LEAST)
        & (F.col("toxval_numeric") >= fixed.STUDY_THRESHOLD) & (F.col("toxval_units") == fixed.STUDY_UNITS)
    )
    shows, none = F.col("value_kind") == "effect", F.col("value_kind") == "no effect"
    effect_type = (
        F.when(~study, F.lit(fixed.NOT_A_STUDY))
        .when(shows & below, F.lit(fixed.EFFECT_BELOW)).when(shows & above, F.lit(fixed.EFFECT_ABOVE))
        .when(none & below, F.lit(fixed.NO_EFFECT_BELOW)).when(none & above, F.lit(fixed.NO_EFFECT_ABOVE))
        .otherwise(F.lit(fixed.UNCATEGORISED_EFFECT))
    )
    return (
        studies.withColumn("risk_assessment_class", risk)
        .withColumn("is_study", flag_number(relevant))
        .withColumns({"value_kind": kind, "study_type": study_type})
        .withColumn("effect_type", effect_type)
        .withColumn(
            "summary",
            F.when(study, F.concat_ws(" - ", "study_type", "effect_type")).otherwise(F.col("effect_type")),
        )
    )


EVIDENCE_FLAGS = [
    "tested", "repro_unlikely", "dev_unlikely", "repro_below", "dev_below", "repro_imprecise", "dev_imprecise",
]


def evidence_flags(classified: DataFrame, key: str = "casrn") -> DataFrame:
    """One row per chemical in the study table with all study-based flags, in a single aggregation."""
    study = F.col("is_study") == 1
    repro = F.col("study_type").isin(fixed.STUDY_TYPES["repro"], fixed.STUDY_TYPES["both"])
    dev = F.col("study_type").isin(fixed.STUDY_TYPES["dev"], fixed.STUDY_TYPES["both"])
    unlikely = study & (F.col("effect_type") == fixed.NO_EFFECT_ABOVE)
    below = study & (F.col("effect_type") == fixed.EFFECT_BELOW)
    imprecise = study & ~F.col("effect_type").isin(fixed.NO_EFFECT_ABOVE, fixed.EFFECT_BELOW)
    tests = dict(zip(EVIDENCE_FLAGS, [
        study, unlikely & repro, unlikely & dev, below & repro, below & dev, imprecise & repro, imprecise & dev,
    ]))
    return classified.groupBy(quoted(key)).agg(*[has_any(t).alias(n) for n, t in tests.items()])


def call_classes(
    calls: DataFrame, key: str = "casrn", call: str = "cancer_call", classes: dict[str, list[str]] | None = None
) -> DataFrame:
    """Best class of each chemical's calls, classes in order of priority; ``FIX`` if no call is known."""
    classes = classes or fixed.CANCER_CALLS
    names = list(classes)
    found = class_of(quoted(call), classes)
    order = F.lit(len(names) + 1)
    for i in reversed(range(len(names))):
        order = F.when(found == names[i], F.lit(i + 1)).otherwise(order)
    best = calls.groupBy(quoted(key)).agg(F.min(order).alias("__order"))
    label = F.element_at(F.array(*[F.lit(n) for n in names + [fixed.UNKNOWN_CALL]]), F.col("__order"))
    return best.select(quoted(key), label.alias("call_class"))


def clean_list(
    listed: DataFrame, name: str = "Chemical", identifier: str = "CAS No.", max_ids: int | None = None,
    delisted: str = fixed.DELISTED, placeholder: str = fixed.NO_IDENTIFIER, separator: str = fixed.ID_SEPARATOR,
) -> DataFrame:
    """Regulatory list with one trimmed identifier per row, delisted entries and placeholders dropped.

    ``max_ids`` is the number of identifiers read from one cell; by default all are.
    """
    kept = listed.where(txt.not_matches(quoted(name), delisted))
    pieces = F.split(quoted(identifier), separator)
    if max_ids is not None:
        pieces = F.slice(pieces, 1, max_ids)
    rows = kept.withColumn(identifier, F.explode(pieces))
    real = rows.where(quoted(identifier).isNotNull() & (quoted(identifier) != placeholder))
    return on_text_columns(real, txt.trim_both)


def list_flags(
    cleaned: DataFrame, identifier: str = "CAS No.", kind: str = "Type of Toxicity", flags: dict[str, str] | None = None
) -> DataFrame:
    """One row per identifier with a boolean per kind of toxicity."""
    return cleaned.groupBy(quoted(identifier)).agg(*[
        has_any(txt.matches(quoted(kind), p)).alias(n) for n, p in (flags or fixed.LIST_FLAGS).items()
    ])


def _either(first: Column, second: Column, both: str, only_first: str, only_second: str) -> Column:
    return (
        F.when(first & second, F.lit(both)).when(first, F.lit(only_first)).when(second, F.lit(only_second))
        .otherwise(F.lit(""))
    )


def evidence_matrix(
    chemicals: DataFrame, flags: DataFrame, calls: DataFrame, listing: DataFrame,
    survey: DataFrame, developmental: DataFrame, carcinogens: DataFrame,
    chem: str = "casn", flags_key: str = "casrn", calls_key: str = "casrn", list_key: str = "CAS No.",
    survey_key: str = "CASRN", developmental_key: str = "CAS_No", carcinogens_key: str = "CAS_No",
) -> DataFrame:
    """One row per chemical of ``chemicals`` (name, id) with seven evidence columns.

    ``flags``, ``calls`` and ``listing`` have one row per chemical; the three plain lists are tested for membership.
    """
    marked = with_membership(chemicals, chem, {
        "__survey": (survey, survey_key),
        "__dev": (developmental, developmental_key),
        "__cancer": (carcinogens, carcinogens_key),
    })
    joined = join_on(marked, flags, {chem: flags_key})
    joined = join_on(joined, calls, {chem: calls_key})
    joined = join_on(joined, listing, {chem: list_key})

    def yes(name: str) -> Column:
        return F.coalesce(quoted(name), F.lit(False))

    below = "Invivo effect < 100 mg/kg-day"
    above = "No invivo effect >= 100 mg/kg-day"
    other = "Other (ToxValDb)"
    free_of = {
        "repro": txt.not_matches(quoted(below), "(R|r)epro"),
        "dev": txt.not_matches(quoted(below), "(D|d)ev"),
    }
    none_below = quoted(below) == ""
    out = joined.withColumns({
        "Nhanes": flag_number(F.col("__survey")),
        fixed.MAMMARY_COLUMN: _either(
            F.col("__dev"), F.col("__cancer"), fixed.MAMMARY_BOTH, fixed.MAMMARY_DEV, fixed.MAMMARY_CANCER
        ),
        "Carcinogencity": F.coalesce("call_class", F.lit(fixed.NO_ASSESSMENT)),
        below: _either(
            yes("repro_below"), yes("dev_below"), fixed.BOTH_EFFECTS, fixed.REPRO_EFFECT, fixed.DEV_EFFECT
        ),
        "Prop65": _either(
            yes("cancer"), yes("development"), fixed.LIST_BOTH, fixed.LIST_CANCER, fixed.LIST_DEV
        ),
    }).withColumn(
        above,
        F.when(yes("dev_unlikely") & yes("repro_unlikely") & none_below, F.lit(fixed.BOTH_EFFECTS))
        .when(yes("repro_unlikely") & txt.not_matches(quoted(below), "Repro"), F.lit(fixed.REPRO_EFFECT))
        .when(yes("dev_unlikely") & txt.not_matches(quoted(below), "mental"), F.lit(fixed.DEV_EFFECT))
        .otherwise(F.lit("")),
    ).withColumn(
        other,
        F.when(
            yes("repro_imprecise") & yes("dev_imprecise") & none_below & (quoted(above) == ""),
            F.lit("repro/dev" + fixed.IMPRECISE),
        )
        .when(
            yes("repro_imprecise") & free_of["repro"] & txt.not_matches(quoted(above), "(R|r)epro"),
            F.lit("repro" + fixed.IMPRECISE),
        )
        .when(
            yes("dev_imprecise") & free_of["dev"] & txt.not_matches(quoted(above), "(D|d)ev"),
            F.lit("dev" + fixed.IMPRECISE),
        )
        .when(~yes("tested"), F.lit(fixed.NO_TESTS))
        .otherwise(F.lit("")),
    )
    added = fixed.EVIDENCE_COLUMNS[2:]
    return out.select(*[named(c) for c in [*chemicals.columns, *added]])


def evidence_summary(matrix: DataFrame) -> DataFrame:
    """Likely / unlikely / inadequate, once for cancer and once for reproduction and development."""
    below = quoted("Invivo effect < 100 mg/kg-day")
    above = quoted("No invivo effect >= 100 mg/kg-day")
    cancer = (
        F.when(
            (F.col("Carcinogencity") == fixed.LIKELY) | txt.matches(fixed.MAMMARY_COLUMN, "carcinogen")
            | txt.matches("Prop65", "Cancer"), F.lit(fixed.LIKELY),
        )
        .when(F.col("Carcinogencity") == fixed.UNLIKELY, F.lit(fixed.UNLIKELY))
        .when(
            txt.in_values("Carcinogencity", [fixed.INADEQUATE, fixed.NO_ASSESSMENT]), F.lit(fixed.INADEQUATE)
        )
        .otherwise(F.lit("fix"))
    )
    development = "(D|d)evelopment"
    toxicity = (
        F.when(
            txt.matches(below, development + "|Reproductive") | txt.matches(fixed.MAMMARY_COLUMN, development)
            | txt.matches("Prop65", development + "al"), F.lit(fixed.LIKELY),
        )
        .when(above == fixed.BOTH_EFFECTS, F.lit(fixed.UNLIKELY))
        .when(
            (quoted("Other (ToxValDb)") != "") | above.isin(fixed.REPRO_EFFECT, fixed.DEV_EFFECT),
            F.lit(fixed.INADEQUATE),
        )
        .otherwise(F.lit(fixed.UNKNOWN_CALL))
    )
    summed = matrix.withColumns({fixed.CANCER_SUMMARY: cancer, fixed.TOXICITY_SUMMARY: toxicity})
    return rename(summed, fixed.EVIDENCE_RENAMES)


def calls_by_source(
    calls: DataFrame, sources: list[str], keys: tuple[str, ...] = ("casrn", "name"), source: str = "source",
    call: str = "cancer_call", route: str = "exposure_route", no_route: str = "-",
) -> DataFrame:
    """One row per chemical and one column per source with all its calls, the route in brackets where known."""
    shown = F.when(
        quoted(route) != no_route, F.concat(quoted(call), F.lit(" ("), quoted(route), F.lit(")"))
    ).otherwise(quoted(call))
    cells = collapse_distinct(calls.withColumn("__call", shown), [*keys, source], "__call", "__calls")
    return widen(cells, list(keys), source, sources, ["__calls"])


def restrict_to(df: DataFrame, key: str, chemicals: DataFrame, chem: str = "casn") -> DataFrame:
    """Rows of the chemicals under study."""
    return member_of(df, key, chemicals, chem)
