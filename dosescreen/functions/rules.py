"""Ordered rule tables turned into one conditional expression each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from dosescreen.functions.text import in_values, matches, not_matches


@dataclass(frozen=True)
class Rule:
    """``field`` matching ``pattern`` means ``label``, unless ``unless_field`` matches ``unless_pattern``."""

    field: str
    pattern: str
    label: str
    unless_field: str | None = None
    unless_pattern: str | None = None


def _merge(rules: list[Rule]) -> list[Rule]:
    """Neighbouring rules that differ only in the pattern become one regular expression."""
    merged: list[Rule] = []
    for rule in rules:
        last = merged[-1] if merged else None
        same = last is not None and (last.field, last.label, last.unless_field, last.unless_pattern) == (
            rule.field, rule.label, rule.unless_field, rule.unless_pattern,
        )
        if same:
            merged[-1] = Rule(last.field, f"{last.pattern}|{rule.pattern}", *list(vars(rule).values())[2:])
        else:
            merged.append(rule)
    return merged


def first_match(rules: list[Rule], default: Column, fields: dict[str, Column] | None = None) -> Column:
    """Label of the first rule that applies, else ``default``."""
    fields = fields or {}
    chain = None
    for rule in _merge(rules):
        test = matches(fields.get(rule.field, F.col(rule.field)), rule.pattern)
        if rule.unless_field:
            test = test & not_matches(fields.get(rule.unless_field, F.col(rule.unless_field)), rule.unless_pattern)
        chain = F.when(test, F.lit(rule.label)) if chain is None else chain.when(test, F.lit(rule.label))
    return default if chain is None else chain.otherwise(default)


def append_match(rules: list[tuple[str, str]], text: Column, label: Column, sep: str = ", ") -> Column:
    """Append the first label whose pattern is in ``text`` and that is not already the whole ``label``."""
    chain = None
    for pattern, extra in rules:
        test = matches(text, pattern) & F.coalesce(label != extra, F.lit(False))
        value = F.concat(label, F.lit(sep + extra))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return label if chain is None else chain.otherwise(label)


def flag_text(test: Column) -> Column:
    """``"1"`` or ``"0"``."""
    return F.when(F.coalesce(test, F.lit(False)), F.lit("1")).otherwise(F.lit("0"))


def flag_number(test: Column) -> Column:
    """1 or 0."""
    return F.when(F.coalesce(test, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def class_of(value: Column, classes: dict[str, list[str]]) -> Column:
    """Name of the first class whose word list holds ``value``; NULL if none does."""
    chain = None
    for name, words in classes.items():
        test = in_values(value, words)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return F.lit(None).cast("string") if chain is None else chain
