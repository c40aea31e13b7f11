"""Monthly series, seasonal indices and forecasts against plain versions."""

import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from recordloom.operators import seasonal


def months(first: datetime.date, n: int) -> list[datetime.date]:
    return [datetime.date(first.year + (first.month - 1 + k) // 12, (first.month - 1 + k) % 12 + 1, 1) for k in range(n)]


def frame(spark, series: dict[str, list[int]]):
    rows = [(k, m, n) for k, values in series.items() for m, n in zip(months(datetime.date(2019, 11, 1), len(values)), values)]
    return spark.createDataFrame(rows, "k string, month date, n long")


def plain_forecast(x: list[float], ahead: int):
    best = None
    for a, b, c in product(seasonal.WEIGHTS, repeat=3):
        level = sum(x[:12]) / 12
        trend = (sum(x[12:24]) / 12 - level) / 12
        season = [v - level for v in x[:12]]
        error = 0.0
        for value in x[12:]:
            due = season.pop(0)
            miss = value - level - trend - due
            new = a * (value - due) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season.append(c * (value - new) + (1 - c) * due)
            level, error = new, error + miss * miss
        if best is None or error < best[0] - 1e-9:
            best = (error, [level + (h + 1) * trend + season[h % 12] for h in range(ahead)])
    return best[1], (best[0] / (len(x) - 12)) ** 0.5


def test_series_have_no_gaps(spark):
    day = datetime.date
    rows = [("a", day(2020, 1, 31)), ("a", day(2020, 1, 2)), ("a", day(2020, 4, 1)), ("b", day(2021, 12, 5)), (None, day(2020, 1, 1)), ("a", None)]
    got = seasonal.month_series(spark.createDataFrame(rows, "k string, d date"), "d", ["k"]).collect()
    assert sorted((r.k, r.month, r.n) for r in got) == [
        ("a", day(2020, 1, 1), 2), ("a", day(2020, 2, 1), 0), ("a", day(2020, 3, 1), 0), ("a", day(2020, 4, 1), 1), ("b", day(2021, 12, 1), 1),
    ]


def test_index_of_a_known_season(spark):
    shape = [5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 65]
    flat = {"s": [2 * v for v in shape] * 3, "short": [1] * 12, "none": [0] * 30}
    got = seasonal.seasonal_index(frame(spark, flat), ["k"]).collect()
    assert {r.k for r in got} == {"s"}
    by_month = {r.month_of_year: r.seasonal_index for r in got}
    assert by_month[10] == pytest.approx(6.5) and by_month[3] == pytest.approx(0.5)
    assert sum(by_month.values()) == pytest.approx(12) and all(r.ratios == 2 for r in got)


def test_forecast_against_a_plain_version(spark):
    series = {
        "season": [10 + k + (k * 7) % 12 * 3 for k in range(41)], "noise": [(k * 7919) % 31 for k in range(30)], "flat": [4] * 24,
        "short": [3] * 23, "one": [1],
    }
    got = seasonal.forecast(frame(spark, series), ["k"], 14).orderBy("k", "month").collect()
    assert len(got) == 14 * len(series)
    for name, values in series.items():
        rows = [r for r in got if r.k == name]
        assert [r.month for r in rows] == months(datetime.date(2019, 11, 1), len(values) + 14)[len(values) :]
        if len(values) < 24:
            assert all(r.forecast is None and r.rmse is None for r in rows)
        else:
            want, rmse = plain_forecast([float(v) for v in values], 14)
            assert [r.forecast for r in rows] == pytest.approx(want) and rows[0].rmse == pytest.approx(rmse, abs=1e-9)
    assert seasonal.forecast(frame(spark, {"a": [1]}).filter(F.lit(False)), ["k"]).collect() == []
