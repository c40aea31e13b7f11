"""Numbers, dates and categories as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import squeeze

# Shapes of written dates, signs between the numbers left open; checking the shape first
# spares the failed parse attempts, which cost an exception each.
EIGHT_DIGITS = r"^\d{8}$"
YEAR_FIRST = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"
YEAR_LAST = r"^\d{1,2}[-/.]\d{1,2}[-/.](\d{4}|\d{2})$"
NAMED_MONTH = r"(?i)^(\d{1,2})[-/ ](?:de )?([a-z]{3})[a-z]*\.?[-/ ](?:de )?(\d{4})$"
# A time of day after the date, with or without fractions and zone.
TIME_OF_DAY = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2}|(?i:[ap]\.?\s?m\.?))?$"
# Month names by their first three letters, and where another language differs.
MONTHS = "ene feb mar abr may jun jul ago sep oct nov dic".split()
OTHER_MONTHS = {"jan": "ene", "apr": "abr", "aug": "ago", "dec": "dic"}
#: Years of two digits below this are of this century.
CENTURY_TURN = 69


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_number(value: Column, kind: str = "double") -> Column:
    """Numeric value, null where the text is not a number.

    For whole kinds ``3.0`` is 3, as exports write whole columns with gaps; a
    number with a fraction is null.
    """
    text = F.trim(value.cast("string"))
    if kind.lower() in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        text = F.regexp_replace(text, r"^([+-]?\d+)\.0*$", "$1")
    return text.try_cast(kind)


def _year_month_day(text: Column) -> Column:
    """A written date as ``year-month-day``; null where the text has none of the known shapes."""

    def year_last(parts: Column) -> Column:
        first, second, year = (F.get(parts, F.lit(k)) for k in range(3))
        century = F.when(year.try_cast("int") < CENTURY_TURN, "20").otherwise("19")
        year = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
        # The day comes first, unless the second number can't be a month.
        american = second.try_cast("int") > 12
        return F.concat_ws("-", year, F.when(american, first).otherwise(second), F.when(american, second).otherwise(first))

    def named(short: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), replace_values(short, OTHER_MONTHS))
        return F.concat_ws("-", F.regexp_extract(text, NAMED_MONTH, 3), month, F.regexp_extract(text, NAMED_MONTH, 1))

    digits = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return (
        F.when(text.rlike(EIGHT_DIGITS), digits)
        .when(text.rlike(YEAR_FIRST), F.translate(text, "/.", "--"))
        .when(text.rlike(YEAR_LAST), let(F.split(text, "[-/.]"), year_last))
        .when(text.rlike(NAMED_MONTH), named(F.lower(F.regexp_extract(text, NAMED_MONTH, 2))))
    )


def parse_date(value: Column) -> Column:
    """Date from eight digits, three numbers or a written month; anything else is null.

    The day comes before the month wherever the year is last, unless only the other
    reading is a date.  Years of two digits lie between 1969 and 2068.  A time of
    day is cut off.
    """
    text = F.trim(value.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^(\d{8})\.0+$", "$1"), TIME_OF_DAY, "")
    return F.when(text.isNotNull(), let(bare, lambda b: F.try_to_timestamp(_year_month_day(b), F.lit("yyyy-M-d")))).cast("date")


def year_of_source(name: Column, event_date: Column | None = None) -> Column:
    """Last ``20dd`` in the source's file name, else in its path, else the year of the event, else null.

    Names that come as addresses (``%20`` for a space) are decoded first.
    """
    decoded = F.coalesce(F.try_url_decode(name), name)

    def last(text: Column) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), 1), F.lit(-1)).try_cast("int")

    year = F.coalesce(last(F.substring_index(decoded, "/", -1)), last(decoded))
    return year if event_date is None else F.coalesce(year, F.year(event_date))


def clean_year(year: Column) -> Column:
    """Integer year, null for sentinels such as ``NO REPORTADO``."""
    return to_number(year, "int")


def replace_values(value: Column, mapping: Mapping[str, str]) -> Column:
    """One exact-match pass over ``mapping``; values not listed are kept."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], value)


def replace_all_with(value: Column, unwanted: Iterable[str], by: str) -> Column:
    """Every listed value becomes ``by``."""
    return F.when(value.isin(list(unwanted)), F.lit(by)).otherwise(value)


def clean_category(value: Column, mapping: Mapping[str, str], blank: str | None = None) -> Column:
    """Upper-case category with sentinels mapped; blanks become ``blank``."""
    tidy = F.nullif(squeeze(F.upper(value)), F.lit(""))
    return replace_values(F.coalesce(tidy, F.lit(blank)), mapping)


def compose_code(department: Column, place: Column) -> Column:
    """Five-digit place code; a place code longer than three digits is already complete."""
    place_text, department_text = place.cast("string"), department.cast("string")
    full = F.lpad(place_text, F.greatest(F.lit(5), F.length(place_text)), F.lit("0"))
    joined = F.concat(F.lpad(department_text, 2, "0"), F.lpad(place_text, 3, "0"))
    return F.when(F.length(place_text) > 3, full).otherwise(joined)


def rate_per_100k(count: Column, population: Column) -> Column:
    """Cases per hundred thousand inhabitants; null without a population."""
    return F.try_divide(count, population) * F.lit(100000)


def percent(part: Column, whole: Column) -> Column:
    """Share of a whole in percent; null for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def count_label(count: Column, share: Column) -> Column:
    """Display text such as ``1,234 (5.6%)``."""
    return F.format_string("%s (%.1f%%)", F.format_number(count, 0), share)
