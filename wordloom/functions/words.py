"""Column expressions over word entries: a word and a map of translation lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.schemas import GRAMMAR_TYPES


def _empty() -> Column:
    return F.array().cast("array<string>")


def all_translations(translations: Column) -> Column:
    """All translations of an entry as one list; a missing list is an empty one."""
    lists = F.transform(F.map_values(translations), lambda each: F.coalesce(each, _empty()))
    return F.coalesce(F.array_compact(F.flatten(lists)), _empty())


def typed_translations(translations: Column) -> Column:
    """All translations of an entry as ``(type, translation)`` structs, in the order of the entry."""
    typed = F.transform(
        F.map_entries(translations),
        lambda each: F.transform(
            F.array_compact(F.coalesce(each["value"], _empty())),
            lambda one: F.struct(each["key"].alias("type"), one.alias("translation")),
        ),
    )
    none = F.array().cast("array<struct<type: string, translation: string>>")
    return F.coalesce(F.flatten(typed), none)


def is_translated(word: Column, translations: Column) -> Column:
    """True when some translation differs from the word itself (case counts)."""
    return F.exists(all_translations(translations), lambda each: each != word)


def filled_categories(translations: Column) -> Column:
    """The categories that hold a translation, in the order of the entry."""
    filled = F.map_filter(translations, lambda _, each: F.coalesce(F.size(each), F.lit(0)) > 0)
    return F.coalesce(F.map_keys(filled), _empty())


def within_distance(left: Column, right: Column, distance: int) -> Column:
    """True when the edit distance is at most ``distance``; stops early beyond it."""
    return F.levenshtein(left, right, distance) != -1


def known_category(label: Column) -> Column:
    return label.isin(*GRAMMAR_TYPES)


def require_category(label: Column) -> Column:
    """The label itself; an unknown one fails the job."""
    return F.when(known_category(label), label).otherwise(
        F.raise_error(F.concat(F.lit("Unknown grammar type: "), F.coalesce(label, F.lit("null"))))
    )
