"""Yearly series.  Windows here run over one row per year, never over facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.values import percent


def change_on_previous(series: DataFrame, period: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent change on the previous period present in the series."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))
    return series.withColumn("previous", before).withColumn(
        "change_pct", percent(F.col(value) - F.col("previous"), F.col("previous"))
    )


def first_to_last(series: DataFrame, period: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent change from the first to the last period; zero for one period or a zero start."""
    ends = series.groupBy(*by).agg(
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        F.min_by(value, period).alias("first_value"),
        F.max_by(value, period).alias("last_value"),
    )
    change = percent(F.col("last_value") - F.col("first_value"), F.col("first_value"))
    return ends.withColumn("change_pct", F.coalesce(change, F.lit(0.0)))
