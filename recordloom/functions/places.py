"""What a department, a weapon and the capital look like in the record sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.fixed import (
    CAPITAL, CAPITAL_DEPARTMENT, DEPARTMENT_KEYS, DEPARTMENT_NAMES, DEPARTMENT_TO_GAZETTEER, WEAPON_WORDS,
)
from recordloom.functions.text import text_key_words


def looks_like_weapon(value: Column) -> Column:
    """Whether the text speaks of a weapon or means."""
    return text_key_words(value).rlike(WEAPON_WORDS)


def is_department(value: Column) -> Column:
    """Whether the text is a department, whatever its accents and case."""
    return text_key_words(value).isin(list(DEPARTMENT_KEYS))


def is_gazetteer_department(key: Column) -> Column:
    """Whether a key is a department as the gazetteer writes it; the capital counts in the one around it."""
    return key.isin([DEPARTMENT_TO_GAZETTEER.get(k, k) for k in DEPARTMENT_KEYS])


def official_department(value: Column) -> Column:
    """Official spelling of a department; unknown text stays as it is."""
    pairs = [F.lit(item) for pair in DEPARTMENT_NAMES.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[text_key_words(value)], value)


def capital_department(place: Column, department: Column) -> Column:
    """The capital counts as a place of the department around it."""
    return F.when(F.contains(place, F.lit("BOGOTA")), F.lit(CAPITAL_DEPARTMENT)).otherwise(department)


def capital_place(place: Column) -> Column:
    """One spelling for the capital."""
    return F.when(F.contains(place, F.lit("BOGOTA")), F.lit(CAPITAL)).otherwise(place)
