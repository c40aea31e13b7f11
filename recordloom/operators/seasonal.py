"""Monthly series: gap-free grids, seasonal indices and forecasts.

A series has one value per calendar month, so it stays short however many records
stand behind it; records are counted before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.values import let

#: Months of a season.
YEAR = 12
#: Smoothing weights tried for level, trend and season.
WEIGHTS = (0.1, 0.3, 0.5)


def month_series(df: DataFrame, day: str, by: Sequence[str]) -> DataFrame:
    """``by``, ``month`` (its first day) and ``n``: the records of every month between a series' first and last.

    Months without a record have zero; rows without a day or a key are left out.
    """
    month = F.trunc(F.col(day), "month")
    present = df.select(*by, month.alias("month")).dropna()
    cells = present.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("n"))
    spans = cells.groupBy(*by).agg(F.min("month").alias("_first"), F.max("month").alias("_last"))
    months = F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH")))
    grid = spans.select(*by, months.alias("month"))
    return grid.join(cells, [*by, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_trend(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``trend``, the centred moving average over a year (ends at half weight); null within half a year of either end."""
    place = Window.partitionBy(*by).orderBy("month")
    half = YEAR // 2
    wide, narrow = place.rowsBetween(-half, half), place.rowsBetween(1 - half, half - 1)
    average = (F.sum("n").over(wide) + F.sum("n").over(narrow)) / (2 * YEAR)
    return series.withColumn("trend", F.when(F.count(F.lit(1)).over(wide) == YEAR + 1, average))


def seasonal_index(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``month_of_year``, ``ratios`` and ``seasonal_index``: the mean ratio to the trend, one on average over the months.

    Series too short for a trend, and months with a trend of zero, give no ratio.
    """
    ratio = F.try_divide(F.col("n"), F.col("trend"))
    rated = with_trend(series, by).select(*by, F.month("month").alias("month_of_year"), ratio.alias("_ratio")).dropna()
    means = rated.groupBy(*by, "month_of_year").agg(F.count(F.lit(1)).alias("ratios"), F.avg("_ratio").alias("_mean"))
    of_series = F.avg("_mean").over(Window.partitionBy(*by))
    return means.select(*by, "month_of_year", "ratios", F.try_divide(F.col("_mean"), of_series).alias("seasonal_index"))


def _smoothed(values: Column, weights: Column) -> Column:
    """State after additive smoothing of level, trend and season over a series of two years or more.

    The first year gives level and season, the difference to the second the trend.
    ``season`` stands in the order in which the months come next.
    """
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / YEAR
    level = mean(F.slice(values, 1, YEAR))
    trend = (mean(F.slice(values, YEAR + 1, YEAR)) - level) / YEAR
    start = F.struct(
        level.alias("level"), trend.alias("trend"), F.transform(F.slice(values, 1, YEAR), lambda x: x - level).alias("season"), F.lit(0.0).alias("error")
    )

    def step(state: Column, value: Column) -> Column:
        due = F.element_at(state["season"], 1)
        before = state["level"] + state["trend"]
        miss = value - before - due

        def moved(new: Column) -> Column:
            slope = weights["trend"] * (new - state["level"]) + (1 - weights["trend"]) * state["trend"]
            season = weights["season"] * (value - new) + (1 - weights["season"]) * due
            return F.struct(
                new.alias("level"), slope.alias("trend"),
                F.concat(F.slice(state["season"], 2, YEAR - 1), F.array(season)).alias("season"), (state["error"] + miss * miss).alias("error"),
            )

        return let(weights["level"] * (value - due) + (1 - weights["level"]) * before, moved)

    return F.aggregate(F.slice(values, YEAR + 1, F.size(values)), start, step)


def forecast(series: DataFrame, by: Sequence[str], ahead: int = YEAR, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``by``, ``month``, ``forecast`` and ``rmse`` (of one month ahead, within the series) for the next ``ahead`` months.

    Additive smoothing of level, trend and season.  All combinations of the weights
    are folded over the series in one pass; the one of the least squared error is
    used, the first of ties.  A series of under two years has null forecasts.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("month", F.col("n").cast("double").alias("n")))), lambda p: p["n"])
    whole = series.groupBy(*by).agg(ordered.alias("_values"), F.max("month").alias("_last"))
    tried = F.array(
        *[F.struct(F.lit(a).alias("level"), F.lit(b).alias("trend"), F.lit(c).alias("season")) for a, b, c in product(weights, repeat=3)]
    )
    enough = F.size("_values") >= 2 * YEAR
    states = F.transform(tried, lambda w, i: F.struct(_smoothed(F.col("_values"), w).alias("state"), i.alias("place")))
    ranked = F.transform(states, lambda s: F.struct(s["state"]["error"].alias("error"), s["place"].alias("place"), s["state"].alias("state")))
    done = whole.withColumn("_best", F.when(enough, F.array_min(ranked)))
    steps = F.explode(F.sequence(F.lit(1), F.lit(ahead)))
    state = F.col("_best.state")
    value = state["level"] + F.col("_step") * state["trend"] + F.get(state["season"], (F.col("_step") - 1) % YEAR)
    rmse = F.sqrt(F.col("_best.error") / (F.size("_values") - YEAR))
    return done.select("*", steps.alias("_step")).select(
        *by, F.add_months("_last", F.col("_step")).alias("month"), value.alias("forecast"), rmse.alias("rmse")
    )
