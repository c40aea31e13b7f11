"""Star schema: one fact table and dimensions keyed by a hash of their natural key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.joins import require_unique
from recordloom.session import settle


def natural_key(columns: Sequence[str]) -> Column:
    """Surrogate key computed from the natural key alone, so facts need no join to get it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def build_star(
    df: DataFrame, dimensions: Mapping[str, Sequence[str]], measures: Sequence[str]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Fact with one key per dimension and the measures, and the distinct rows of each dimension.

    All dimensions come out of one pass over the rows as grouping sets.  They are
    settled, so that joins back to the fact are planned by their true size.  Two
    natural keys with one hash are found out and refused.
    """
    keys = {name: natural_key(columns).alias(f"{name}_key") for name, columns in dimensions.items()}
    fact = df.select(*keys.values(), *measures)
    every = list(dict.fromkeys(c for columns in dimensions.values() for c in columns))
    sets = settle(
        df.groupingSets([list(columns) for columns in dimensions.values()], *every).agg(
            F.grouping_id(*every).alias("_set")
        )
    )
    tables = {}
    for name, columns in dimensions.items():
        mark = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in columns)
        tables[name] = require_unique(sets.filter(F.col("_set") == mark).select(keys[name], *columns), [f"{name}_key"])
    return fact, tables


def calendar(day: Column) -> list[Column]:
    """Columns of a time dimension for a date."""
    month = F.month(day)
    return [
        F.to_date(day).alias("date"),
        F.year(day).alias("year"),
        month.alias("month"),
        F.dayofmonth(day).alias("day"),
        F.weekday(day).alias("weekday"),
        F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")).alias("period"),
    ]
