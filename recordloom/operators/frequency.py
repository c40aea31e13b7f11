"""Frequency tables, top lists and one-row indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.values import percent
from recordloom.operators.ranking import running_total, top_n, top_per_group
from recordloom.session import settle


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every listed column."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def counts(df: DataFrame, *columns: str, n: str = "n") -> DataFrame:
    """Row counts per combination, null groups left out."""
    return counts_with_nulls(present(df, *columns), *columns, n=n)


def counts_with_nulls(df: DataFrame, *columns: str, n: str = "n") -> DataFrame:
    """Row counts per combination, null being a group of its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))


def tally(df: DataFrame, *columns: str) -> DataFrame:
    """Counts per combination, nulls included, computed once and settled.

    Reports look at the same counts several times; only this step reads the rows.
    """
    return settle(counts_with_nulls(df, *columns))


def regroup(cells: DataFrame, *columns: str) -> DataFrame:
    """Counts of fewer columns out of finer counts, null groups left out."""
    return present(cells, *columns).groupBy(*columns).agg(F.sum("n").alias("n"))


def total_of(cells: DataFrame) -> Column:
    """All rows behind the counts, as a scalar subquery."""
    return cells.agg(F.sum("n").alias("total")).scalar()


def biggest_first(*columns: str) -> list[Column]:
    """Order by count, largest first, ties by value."""
    return [F.desc("n"), *[F.asc(c) for c in columns]]


def top_values(cells: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with counts; at most ``n`` rows, so safe to broadcast."""
    return top_n(regroup(cells, column), n, biggest_first(column))


def only_top(df: DataFrame, cells: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent; the key list holds ``n`` rows at most."""
    return df.join(F.broadcast(top_values(cells, column, n).select(column)), column, "left_semi")


def frequency_table(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Counts, percent of all rows (null rows included) and cumulative percent, largest first."""
    cells = tally(df, column)
    whole = total_of(cells)
    ordered = running_total(present(cells, column), "n", biggest_first(column))
    return ordered.select(
        column,
        "n",
        F.round(percent(F.col("n"), whole), digits).alias("pct"),
        F.round(percent(F.col("cum"), whole), digits).alias("cum_pct"),
    )


def with_share(cells: DataFrame, column: str) -> DataFrame:
    """Every value of a tally with its percent of all non-null rows."""
    known = present(cells, column)
    whole = total_of(known)
    return regroup(known, column).select(column, "n", percent(F.col("n"), whole).alias("pct"))


def top_with_share(cells: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values of a tally with their percent of all non-null rows."""
    whole = total_of(present(cells, column))
    return top_values(cells, column, n).select(column, "n", percent(F.col("n"), whole).alias("pct"))


def top_and_rest(cells: DataFrame, column: str, n: int, rest: str = "OTROS") -> DataFrame:
    """The ``n`` most frequent values of a tally plus one row that adds up the others."""
    marked = present(cells, column).join(
        F.broadcast(top_values(cells, column, n).select(column, F.lit(True).alias("_top"))), column, "left"
    )
    label = F.when(F.col("_top"), F.col(column)).otherwise(F.lit(rest))
    return marked.groupBy(label.alias(column)).agg(F.sum("n").alias("n"))


def top_share(cells: DataFrame, column: str, k: int) -> DataFrame:
    """Share of all rows of a tally that falls in the ``k`` most frequent values."""
    top = top_values(cells, column, k).agg(F.sum("n").alias("top_n"))
    return top.select("top_n", total_of(cells).alias("total")).withColumn(
        "pct", percent(F.col("top_n"), F.col("total"))
    )


def extremes(cells: DataFrame, column: str) -> DataFrame:
    """Values with the largest and the smallest count; of tied values the lowest."""
    n, value = F.col("n"), F.col(column)
    return cells.agg(
        F.min_by(column, F.struct(-n, value)).alias("max_value"),
        F.max("n").alias("max_n"),
        F.min_by(column, F.struct(n, value)).alias("min_value"),
        F.min("n").alias("min_n"),
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, most frequent value, its count and share of all rows.

    One pass counts the values of every column together.
    """
    cells = counts_with_nulls(
        df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value"),
        "column",
        "value",
    )
    n, value = F.col("n"), F.col("value")
    seen = F.when(value.isNotNull(), F.struct((-n).alias("minus_n"), value))
    summary = cells.groupBy("column").agg(
        F.count("value").alias("distinct_values"),
        F.min(seen).alias("_top"),
        F.sum("n").alias("rows"),
    )
    top_count = -F.col("_top").getField("minus_n")
    return summary.select(
        "column",
        "distinct_values",
        F.col("_top").getField("value").alias("mode"),
        top_count.alias("mode_n"),
        percent(top_count, F.col("rows")).alias("mode_pct"),
    )


def top_k_per_group(cells: DataFrame, group: str, item: str, k: int, groups: int | None = None) -> DataFrame:
    """The ``k`` most frequent items of every group of a tally with their share of the group's rows.

    ``groups`` keeps only the most frequent groups.  Rows with a null item count
    towards the group but are never listed.
    """
    cells = present(cells, group)
    if groups:
        cells = only_top(cells, cells, group, groups)
    sizes = regroup(cells, group).withColumnRenamed("n", "group_n")
    listed = top_per_group(present(cells, item), [group], k, biggest_first(item))
    return listed.join(sizes, group).select(
        group, item, "n", "position", percent(F.col("n"), F.col("group_n")).alias("pct")
    )


def top_by_period(cells: DataFrame, column: str, period: str, n: int) -> DataFrame:
    """Counts per period of the ``n`` values of a tally that are most frequent overall."""
    return present(only_top(cells, cells, column, n), period)


def key_figures(df: DataFrame, figures: Mapping[str, Column]) -> DataFrame:
    """One row of named aggregates computed in one pass."""
    return df.agg(*[column.alias(name) for name, column in figures.items()])
