"""Text, date and membership expressions with the NULL behaviour a screening analysis expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dosescreen.functions.numeric import col

WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.:·][\p{L}\p{N}_]+)*"


def literal(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column | str, pattern: str) -> Column:
    """True where ``pattern`` is found anywhere in the text; NULL text counts as no match."""
    return F.coalesce(col(text).rlike(pattern), F.lit(False))


def not_matches(text: Column | str, pattern: str) -> Column:
    """True where ``pattern`` is not found, so NULL text is kept."""
    return ~matches(text, pattern)


def in_values(value: Column | str, values) -> Column:
    """Two-valued membership test: a NULL value is simply not in the list."""
    return F.coalesce(col(value).isin(list(values)), F.lit(False))


def null_or(value: Column | str, *values) -> Column:
    """True where the value is NULL or one of ``values``."""
    value = col(value)
    return value.isNull() | value.isin(list(values))


def is_blank(value: Column | str) -> Column:
    """True for NULL, the empty text and a single blank."""
    return null_or(value, "", " ")


def strip_guard(identifier: Column | str) -> Column:
    """Remove the apostrophes that protect identifiers in spreadsheets."""
    return F.regexp_replace(col(identifier), "'", "")


def add_guard(identifier: Column | str) -> Column:
    return F.concat(F.lit("'"), col(identifier))


def trim_left(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+", "")


def trim_both(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def title_case(text: Column | str) -> Column:
    """Upper-case the first letter of every word and lower the rest; an underscore does not end a word."""
    pieces = F.regexp_extract_all(F.lower(col(text)), F.lit(f"({WORD}|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+)"), F.lit(1))
    raised = F.transform(pieces, lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.array_join(raised, "")


def underscores_to_spaces(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "_", " ")


def term(path: Column | str, index: int = 0, separator: str = r"\|") -> Column:
    """One term of a separated path, NULL where the path is too short."""
    return F.get(F.split(col(path), separator), F.lit(index))


def recode(value: Column | str, synonyms: dict[str, str]) -> Column:
    """Replace exact values by their synonym and keep all others."""
    value = col(value)
    if not synonyms:
        return value
    table = F.expr("map(" + ", ".join(f"{literal(old)}, {literal(new)}" for old, new in synonyms.items()) + ")")
    return F.coalesce(F.try_element_at(table, value), value)


def abbreviate(text: Column | str, replacements) -> Column:
    """Apply regular-expression replacements one after the other."""
    text = col(text)
    for pattern, short in replacements:
        text = F.regexp_replace(text, pattern, short)
    return text


def day_month_year(text: Column | str, corrections: dict[str, str] | None = None) -> Column:
    """Parse ``02Jul2014``-like dates after literal corrections; unreadable text gives NULL."""
    return F.try_to_date(recode(text, corrections or {}), "ddMMMyyyy")
