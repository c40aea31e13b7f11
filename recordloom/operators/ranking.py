"""Ordered totals, ranks and exact quantiles without a global sort in one task.

Everything here works on *cells*: distinct values with their row counts.  Cells
are spread by range, each range is summed on its own, and only one small row per
range decides where the next range starts.  A value shared by a third of all rows
is a single cell, and no group ever has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import settle


def running_total(
    df: DataFrame, amount: str, order_by: Sequence[Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``cum`` (inclusive running sum of ``amount``) and ``total`` per ``by``.

    ``by`` must hold no nulls and ``order_by`` must be a total order within ``by``.
    The spread rows are settled once so that slice numbers never change.
    """
    keys = list(by)
    spread = settle(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_by).withColumn("_slice", F.spark_partition_id())
    )
    parts = spread.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_part").over(Window.partitionBy(*keys)).alias("total"),
    )
    # Without keys there is one row per range, which the partition count bounds.
    starts = starts if keys else F.broadcast(starts)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("cum", F.sum(amount).over(inside))
        .join(starts, [*keys, "_slice"])
        .withColumn("cum", F.col("cum") + F.col("_start"))
        .drop("_slice", "_start")
    )


def value_cells(df: DataFrame, column: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct non-null values of ``column`` per ``by`` with their row count, or summed weight, ``n``."""
    present = df.filter(F.col(column).isNotNull())
    for key in by:
        present = present.filter(F.col(key).isNotNull())
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return present.groupBy(*by, column).agg(size.alias("n"))


def average_ranks(cells: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value; ``cells`` come from :func:`value_cells`."""
    ranked = running_total(cells, "n", [F.col(column)], by)
    return ranked.withColumn("avg_rank", F.col("cum") - (F.col("n") - 1) / 2)


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per ``by`` and column.

    ``weight`` names a column saying how many equal rows a row stands for.

    Output: ``by``, ``column``, ``n`` and ``q0, q1, ...`` in the order of ``probs``.
    """
    keys = [*by, "_column"]
    numbered = {str(i): F.col(c).cast("double") for i, c in enumerate(columns)}
    kept = [*by, weight] if weight else list(by)
    values = df.select(*kept, *[v.alias(i) for i, v in numbered.items()])
    long = values.unpivot(kept, list(numbered), "_column", "value").withColumn("_column", F.col("_column").cast("int"))
    ranked = running_total(value_cells(long, "value", keys, weight), "n", [F.col("value")], keys)
    first, last = F.col("cum") - F.col("n"), F.col("cum")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < last), F.col("value")))

    picks = []
    for i, p in enumerate(probs):
        position = (F.col("total") - 1) * F.lit(float(p))
        picks += [at(F.floor(position)).alias(f"_lo{i}"), at(F.ceil(position)).alias(f"_hi{i}")]
    picked = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *picks)
    out = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        step = (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position - F.floor(position))
        out.append((F.col(f"_lo{i}") + step).alias(f"q{i}"))
    name = F.array(*[F.lit(c) for c in columns])[F.col("_column")]
    return picked.select(*by, name.alias("column"), "n", *out)


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Single-pass sketch variant of :func:`quantiles`; returns elements, no interpolation."""
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot(list(by), list(columns), "column", "value").filter(F.col("value").isNotNull())
    sketch = F.percentile_approx("value", [float(p) for p in probs], accuracy)
    found = long.groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n"), sketch.alias("_q"))
    return found.select(*by, "column", "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def thresholds(df: DataFrame, limits: Mapping[str, float], weight: str | None = None) -> dict[str, float | None]:
    """One exact quantile per column, brought to the driver as plain numbers.

    Filters on a number are pushed into the scan and skip whole row groups.
    """
    probs = sorted(set(limits.values()))
    found = {row["column"]: row for row in quantiles(df, list(limits), probs, weight=weight).collect()}
    return {c: found[c][f"q{probs.index(p)}"] if c in found else None for c, p in limits.items()}


def top_n(df: DataFrame, n: int, order_by: Sequence[Column]) -> DataFrame:
    """First ``n`` rows of an order; each task keeps only ``n`` candidates."""
    return df.orderBy(*order_by).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], n: int, order_by: Sequence[Column]) -> DataFrame:
    """First ``n`` rows of every group with their ``position``; tasks prune before the shuffle."""
    order = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_group(df, keys, 1, order_by).drop("position")
