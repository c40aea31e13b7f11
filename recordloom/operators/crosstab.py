"""Contingency tables.  Fact rows are counted into cells once; the rest works on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.values import percent
from recordloom.operators.frequency import counts, only_top, present, regroup
from recordloom.session import settle


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Wide table of counts with a column for every value that occurs, zero where a pair does not.

    The rows are counted once; the column names come from the settled cells.
    """
    cells = settle(counts(df, row, column))
    names = [r[0] for r in cells.select(column).distinct().orderBy(column).collect()]
    return cells.groupBy(row).pivot(column, names).agg(F.sum("n")).na.fill(0) if names else cells.select(row)


def crosstab_margins(df: DataFrame, row: str, column: str, label: str = "All") -> DataFrame:
    """Long table of counts with row, column and grand totals under ``label``."""
    cubed = counts(df, row, column).cube(row, column).agg(
        F.sum("n").alias("n"), F.grouping(row).alias("_row"), F.grouping(column).alias("_column")
    )
    return cubed.select(
        F.when(F.col("_row") == 1, F.lit(label)).otherwise(F.col(row).cast("string")).alias(row),
        F.when(F.col("_column") == 1, F.lit(label)).otherwise(F.col(column).cast("string")).alias(column),
        "n",
    )


def row_percent(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each cell of a tally in its row, in percent; null keys are left out."""
    cells = present(cells, row, column)
    sizes = regroup(cells, row).withColumnRenamed("n", "row_n")
    return cells.join(sizes, row).select(row, column, "n", percent(F.col("n"), F.col("row_n")).alias("pct"))


def top_crosstab(cells: DataFrame, row: str, column: str, rows: int, columns: int) -> DataFrame:
    """Counts of the most frequent rows of a tally against its most frequent columns."""
    return present(only_top(only_top(cells, cells, row, rows), cells, column, columns), row, column)
