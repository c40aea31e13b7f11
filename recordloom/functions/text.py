"""Text keys, place names and column names as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every space beyond ASCII.
ODD_SPACES = "\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))


def _letter_table() -> tuple[str, str]:
    """Accented Latin letters and odd spaces with their plain form, derived from Unicode.

    Combining marks come last and have no plain form: ``translate`` deletes those.
    """
    table = dict.fromkeys(ODD_SPACES, " ")
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii():
            table[chr(code)] = base[0]
    return "".join(table) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(table.values())


MARKED, PLAIN = _letter_table()

# Letters without a decomposition and their transliteration.
STROKED = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d"}
# Signs that keyboards and office programs put in place of ASCII ones.
SIGNS = {
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-",
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u00b4": "'", "\u02bc": "'", "\u2032": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"', "\u00bb": '"', "\u2022": "*", "\u00b7": "*", "\u00a1": "!", "\u00bf": "?",
}
LIGATURES = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}


def strip_accents(text: Column) -> Column:
    """Base letters only, and plain spaces."""
    return F.translate(text, MARKED, PLAIN)


def to_ascii(text: Column) -> Column:
    """``strip_accents`` plus letters that have no decomposition, and typographic signs; ASCII text passes untouched."""
    single = {**STROKED, **SIGNS}
    out = F.translate(text, "".join(single) + MARKED, "".join(single.values()) + PLAIN)
    for letter, ascii_form in {**LIGATURES, "\u2026": "...", "\u00b0": "deg"}.items():
        out = F.replace(out, F.lit(letter), F.lit(ascii_form))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(out)


def squeeze(text: Column) -> Column:
    """One space between words, none at the ends; every kind of space counts."""
    return _squeeze_ascii(F.translate(text, ODD_SPACES, " " * len(ODD_SPACES)))


def _squeeze_ascii(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\t-\r\x1c-\x1f][\t-\r\x1c-\x1f ]*| [\t-\r\x1c-\x1f ]+", " "))


def text_key(text: Column) -> Column:
    """Comparison key: null to empty, upper case, ASCII, single spaces."""
    return _squeeze_ascii(to_ascii(F.upper(F.coalesce(text, F.lit("")))))


def text_key_words(text: Column) -> Column:
    """Comparison key in which punctuation counts as a space."""
    bare = strip_accents(F.upper(F.coalesce(text, F.lit(""))))
    return _squeeze_ascii(F.regexp_replace(bare, r"(?U)[^\w\s]", " "))


def place_clean(name: Column, letters_only: bool = False) -> Column:
    """Place name without the capital marker and accents; null and NAN stay null.

    ``letters_only`` also drops everything but letters, after removing accents.
    """
    out = to_ascii(F.regexp_replace(F.upper(F.trim(name)), r"\(CT\)", ""))
    if letters_only:
        out = F.regexp_replace(out, r"[^A-Z\s]", "")
    return F.nullif(_squeeze_ascii(out), F.lit("NAN"))


def column_key(name: Column) -> Column:
    """Column name as lower-case words joined by underscores."""
    words = F.regexp_replace(F.lower(strip_accents(name)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(words, r"^_+|_+$", "")


def header_key(name: Column) -> Column:
    """Column name in upper case with underscores, star marks dropped."""
    return F.translate(F.upper(F.trim(name)), " /*", "__")


def column_keys(names: Sequence[str]) -> list[str]:
    """Driver-side twin of :func:`column_key` for a frame's own column names."""
    out = []
    for name in names:
        letters = unicodedata.normalize("NFKD", str(name)).lower()
        plain = "".join(c for c in letters if not unicodedata.combining(c))
        out.append("_".join(re.findall(r"[a-z0-9]+", plain)))
    return out


def first_full_match(name: Column, patterns: Mapping[str, str]) -> Column:
    """Target of the first pattern that matches the whole name, else the name."""
    branches = [F.when(name.rlike(f"^(?:{p})$"), F.lit(target)) for p, target in patterns.items()]
    return F.coalesce(*branches, name)


def row_text(cells: Column) -> Column:
    """All cells of a row as one lower-case line."""
    filled = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
    return F.lower(F.array_join(filled, " "))


def short_label(text: Column, width: int) -> Column:
    """At most ``width`` characters, followed by dots when cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
