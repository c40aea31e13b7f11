"""Column profiles, descriptive statistics and the numbers behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.values import percent
from recordloom.operators.frequency import only_top, present, tally
from recordloom.operators.ranking import quantiles, thresholds
from recordloom.session import settle

QUARTILES = (0.25, 0.5, 0.75)


def _named_stats(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """One pass of several aggregates over several columns, then one row per column."""
    row = df.agg(
        *[F.struct(*[make(c).alias(name) for name, make in stats.items()]).alias(c) for c in columns]
    )
    return row.unpivot([], list(columns), "column", "_s").select("column", "_s.*")


def null_profile(df: DataFrame, nonzero: bool = True) -> DataFrame:
    """Null count and percent per column, by default only columns that have nulls."""
    found = _named_stats(
        df, df.columns, {"nulls": lambda c: F.count_if(F.col(c).isNull()), "rows": lambda c: F.count(F.lit(1))}
    )
    shown = found.select("column", "nulls", percent(F.col("nulls"), F.col("rows")).alias("pct"))
    return shown.filter(F.col("nulls") > 0) if nonzero else shown


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Position, type, distinct values, nulls and percent of nulls for every column."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    found = _named_stats(
        df,
        df.columns,
        {
            "position": lambda c: F.lit(df.columns.index(c) + 1),
            "type": lambda c: F.lit(dict(df.dtypes)[c]),
            "distinct_values": lambda c: distinct(F.col(c)),
            "nulls": lambda c: F.count_if(F.col(c).isNull()),
            "rows": lambda c: F.count(F.lit(1)),
        },
    )
    return found.withColumn("null_pct", percent(F.col("nulls"), F.col("rows"))).drop("rows")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range, quartiles, IQR, variation coefficient and nulls per column."""
    basics = _named_stats(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]),
        columns,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
            "nulls": lambda c: F.count_if(F.col(c).isNull()),
        },
    )
    spread = quantiles(df, columns, QUARTILES).select(
        "column", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")
    )
    return (
        basics.join(spread, "column", "left")
        .withColumn("iqr", F.col("q75") - F.col("q25"))
        .withColumn("cv_pct", F.try_divide(F.col("std"), F.col("mean")) * 100)
    )


def measure_summary(df: DataFrame, column: str) -> DataFrame:
    """Sum, mean, median and maximum of one measure."""
    basics = df.agg(
        F.count(column).alias("n"), F.sum(column).alias("sum"), F.avg(column).alias("mean"), F.max(column).alias("max")
    )
    return basics.withColumn("median", F.lit(thresholds(df, {column: 0.5})[column]).cast("double"))


def group_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Count, mean, median, deviation, range and sum of a measure per group; null groups are left out."""
    rows = present(df, *by)
    basics = rows.groupBy(*by).agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.sum(column).alias("sum"),
    )
    middle = quantiles(rows, [column], [0.5], by).select(*by, F.col("q0").alias("median"))
    return basics.join(middle, list(by), "left")


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed.

    With ``by``, every group has its own bins and ``density`` is the share of the
    group's rows per unit of width.  Empty bins are absent.
    """
    x = F.col(column).cast("double")
    rows = present(df, column, *by).select(*by, x.alias("_x"))
    edges = F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("rows"))
    if by:
        ends = rows.groupBy(*by).agg(edges.alias("_e"))
        rows = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n")).join(ends, list(by))
    else:
        rows = rows.withColumn("_n", F.lit(1)).withColumn("_e", rows.agg(edges.alias("_e")).scalar())
    flat = F.col("_e.lo") == F.col("_e.hi")
    low = F.when(flat, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_e.hi") - F.col("_e.lo")) / F.lit(bins)
    placed = rows.select(
        *by, "_n", low.alias("_low"), width.alias("_width"), F.col("_e.rows").alias("_rows"),
        F.least(F.floor((F.col("_x") - low) / width), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    binned = placed.groupBy(*by, "bin").agg(
        F.sum("_n").cast("long").alias("n"), *[F.first(c).alias(c) for c in ("_low", "_width", "_rows")]
    )
    return binned.select(
        *by,
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
        "n",
        (F.col("n") / F.col("_rows") / F.col("_width")).alias("density"),
    )


def box_stats(df: DataFrame, by: str, column: str, trim: float | None = 0.95, top: int | None = None) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and mean per group.

    ``top`` keeps the most frequent groups, then values above the ``trim`` quantile
    of what is left are dropped, as the charts do.
    """
    cells = tally(df, by, column)
    if top:
        cells = only_top(cells, cells, by, top)
    cells = present(cells, by, column)
    if trim:
        edge = thresholds(cells, {column: trim}, weight="n")[column]
        cells = cells.filter(F.col(column) <= F.lit(edge))
    boxes = settle(
        quantiles(cells, [column], QUARTILES, [by], weight="n").select(
            by, F.col("q0").alias("q1"), F.col("q1").alias("q2"), F.col("q2").alias("q3")
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(column)
    return (
        cells.join(boxes, by)
        .groupBy(by, "q1", "q2", "q3")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(x * F.col("n")) / F.sum("n")).alias("mean"),
            F.min(F.when(x >= F.col("q1") - reach, x)).alias("_low"),
            F.max(F.when(x <= F.col("q3") + reach, x)).alias("_high"),
        )
        .select(
            by, "n", "q1", "q2", "q3", "mean",
            F.least("_low", "q1").alias("whisker_low"),
            F.greatest("_high", "q3").alias("whisker_high"),
        )
    )


def log10_positive(df: DataFrame, column: str) -> DataFrame:
    """Base-10 logarithm of the positive values."""
    return df.filter(F.col(column) > 0).select(F.log10(column).alias(f"log10_{column}"))
