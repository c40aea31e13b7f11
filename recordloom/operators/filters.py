"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ranking import quantiles, thresholds
from recordloom.session import settle


def without_pattern(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Drop rows in which any of the columns matches; null does not match."""
    hits = [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns if c in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, hits)) if hits else df


def without_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Drop rows with a listed value; null stays."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def without_known(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop rows whose key is in ``known``."""
    return df.join(known.select(*on), list(on), "left_anti")


def only_known(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep rows whose key is in ``known``."""
    return df.join(known.select(*on), list(on), "left_semi")


def selection(choices: Mapping[str, Sequence | None], strict: Sequence[str] = ()) -> Column:
    """One predicate from list selections, joined by AND.

    An empty selection filters nothing, except for ``strict`` columns where it keeps no row.
    """
    tests = [F.lit(True)]
    for column, wanted in choices.items():
        if wanted:
            tests.append(F.col(column).isin(list(wanted)))
        elif column in strict:
            tests.append(F.lit(False))
    return reduce(lambda a, b: a & b, tests)


def null_rows(df: DataFrame, column: str, show: Sequence[str]) -> DataFrame:
    """The rows without a value in ``column``."""
    return df.filter(F.col(column).isNull()).select(*show)


def trim_above(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows at or below a quantile in each column; thresholds use the incoming rows, nulls are dropped."""
    tests = [F.col(c) <= F.lit(edge) for c, edge in thresholds(df, limits).items()]
    return df.filter(reduce(lambda a, b: a & b, tests))


def trim_above_by(df: DataFrame, by: Sequence[str], column: str, prob: float) -> DataFrame:
    """Rows at or below their own group's quantile."""
    limits = settle(quantiles(df, [column], [prob], by).select(*by, F.col("q0").alias("_limit")))
    return df.join(limits, list(by)).filter(F.col(column) <= F.col("_limit")).drop("_limit")


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values of a column."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    return values.limit(limit) if limit else values
