"""Queries for yearly series, top lists and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import frequency, ranking, seasonal, trends
from recordloom.operators.crosstab import crosstab
from recordloom.operators.frequency import counts, tally
from recordloom.plans import model
from recordloom.plans.profiling import rounded
from recordloom.plans.registry import query

WITH_RECORDS = "WITH " + model.RECORDS_SQL
WITH_FACT = "WITH " + model.FACT_SQL


@query(
    "yoy_change",
    WITH_RECORDS
    + """, c AS (SELECT year, count(*) AS n FROM records GROUP BY 1)
      SELECT year, n, lag(n) OVER (ORDER BY year) AS previous,
        round((n - lag(n) OVER (ORDER BY year)) * 100.0 / nullif(lag(n) OVER (ORDER BY year), 0), 4) AS change_pct FROM c""",
)
def yoy_change(spark, folder):
    return rounded(trends.change_on_previous(counts(model.records(spark, folder), "year"), "year", "n"), "change_pct")


@query(
    "yoy_change_offence",
    WITH_RECORDS
    + """, c AS (SELECT offence, year, count(*) AS n FROM records GROUP BY 1, 2)
      SELECT offence, year, n, lag(n) OVER w AS previous, round((n - lag(n) OVER w) * 100.0 / nullif(lag(n) OVER w, 0), 4) AS change_pct
      FROM c WINDOW w AS (PARTITION BY offence ORDER BY year)""",
)
def yoy_change_offence(spark, folder):
    series = counts(model.records(spark, folder), "offence", "year")
    return rounded(trends.change_on_previous(series, "year", "n", ["offence"]), "change_pct")


@query(
    "first_last_change",
    WITH_FACT
    + """, c AS (SELECT department, year, count(*) AS n FROM fact GROUP BY 1, 2)
      SELECT department, min(year) AS first_period, max(year) AS last_period, arg_min(n, year) AS first_value, arg_max(n, year) AS last_value,
        round((arg_max(n, year) - arg_min(n, year)) * 100.0 / arg_min(n, year), 4) AS change_pct FROM c GROUP BY 1""",
)
def first_last_change(spark, folder):
    series = counts(model.fact(spark, folder), "department", "year")
    return rounded(trends.first_to_last(series, "year", "n", ["department"]), "change_pct")


@query(
    "topk_per_group",
    WITH_FACT
    + """, c AS (SELECT department, municipality, count(*) AS n FROM fact GROUP BY 1, 2)
      SELECT department, municipality, n, CAST(row_number() OVER (PARTITION BY department ORDER BY n DESC, municipality) AS INTEGER) AS position,
        round(n * 100.0 / sum(n) OVER (PARTITION BY department), 4) AS pct FROM c QUALIFY position <= 3""",
)
def topk_per_group(spark, folder):
    return rounded(frequency.top_k_per_group(tally(model.fact(spark, folder), "department", "municipality"), "department", "municipality", 3), "pct")


@query(
    "top1_per_group",
    WITH_FACT
    + """, c AS (SELECT municipality, weapon, count(*) AS n FROM fact GROUP BY 1, 2),
      g AS (SELECT municipality FROM c GROUP BY 1 ORDER BY sum(n) DESC, municipality LIMIT 10)
      SELECT municipality, weapon, n, CAST(row_number() OVER (PARTITION BY municipality ORDER BY n DESC, weapon) AS INTEGER) AS position,
        round(n * 100.0 / sum(n) OVER (PARTITION BY municipality), 4) AS pct FROM c WHERE municipality IN (SELECT municipality FROM g) QUALIFY position = 1""",
)
def top1_per_group(spark, folder):
    cells = tally(model.fact(spark, folder), "municipality", "weapon")
    return rounded(frequency.top_k_per_group(cells, "municipality", "weapon", 1, groups=10), "pct")


@query(
    "sort_nulls_last",
    """SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS offence FROM orders)
       ORDER BY offence NULLS LAST, o_orderkey""",
)
def sort_nulls_last(spark, folder):
    rows = model.records(spark, folder).select(
        F.col("record_id").alias("o_orderkey"), F.expr("CASE WHEN record_id % 4 = 0 THEN NULL ELSE offence END").alias("offence")
    )
    return rows.orderBy(F.asc_nulls_last("offence"), "o_orderkey")


@query(
    "top_n",
    WITH_FACT + " SELECT municipality, count(*) AS n FROM fact GROUP BY 1 ORDER BY n DESC, municipality LIMIT 12",
)
def top_n(spark, folder):
    cells = counts(model.fact(spark, folder), "municipality")
    return ranking.top_n(cells, 12, frequency.biggest_first("municipality"))


@query(
    "head_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def head_rows(spark, folder):
    rows = model.records(spark, folder).select(F.col("record_id").alias("o_orderkey"), F.col("amount").alias("o_totalprice"))
    return ranking.top_n(rows, 20, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "topn_others",
    WITH_FACT
    + """, c AS (SELECT municipality, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, municipality) AS r FROM fact GROUP BY 1)
      SELECT CASE WHEN r <= 6 THEN municipality ELSE 'OTROS' END AS municipality, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
)
def topn_others(spark, folder):
    return frequency.top_and_rest(tally(model.fact(spark, folder), "municipality"), "municipality", 6)


@query(
    "topn_evolution",
    WITH_FACT
    + """ SELECT municipality, year, count(*) AS n FROM fact WHERE municipality IN
        (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 5) GROUP BY 1, 2""",
)
def topn_evolution(spark, folder):
    cells = tally(model.fact(spark, folder), "municipality", "year")
    return frequency.top_by_period(cells, "municipality", "year", 5).select("municipality", "year", "n")


@query(
    "pivot_evolution",
    WITH_FACT + " SELECT year, " + ", ".join(f"count(*) FILTER (municipality = 'NATION_{k}') AS \"NATION_{k}\"" for k in range(25)) + " FROM fact GROUP BY year",
)
def pivot_evolution(spark, folder):
    return crosstab(model.fact(spark, folder), "year", "municipality")


@query(
    "drilldown",
    WITH_FACT
    + """, sub AS (SELECT * FROM fact WHERE offence = '2-HIGH')
      SELECT * FROM (SELECT 'department' AS kind, department AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM sub), 4) AS pct
        FROM sub GROUP BY 2 ORDER BY n DESC, value LIMIT 3)
      UNION ALL SELECT * FROM (SELECT 'weapon', weapon, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM sub), 4)
        FROM sub GROUP BY 2 ORDER BY n DESC, 2 LIMIT 3)""",
)
def drilldown(spark, folder):
    chosen = model.fact(spark, folder).filter(F.col("offence") == "2-HIGH")
    cells = tally(chosen, "department", "weapon")
    parts = []
    for column in ("department", "weapon"):
        top = frequency.top_values(cells, column, 3)
        parts.append(
            top.select(
                F.lit(column).alias("kind"), F.col(column).alias("value"), "n",
                F.round(F.col("n") * 100.0 / frequency.total_of(cells), 4).alias("pct"),
            )
        )
    return parts[0].unionByName(parts[1])


SERIES_SQL = WITH_FACT + """, cells AS (SELECT municipality, CAST(date_trunc('month', event_time) AS DATE) AS month, count(*) AS n FROM fact
        WHERE gender = 'P' GROUP BY ALL),
    spans AS (SELECT municipality, min(month) AS lo, max(month) AS hi FROM cells GROUP BY 1),
    grid AS (SELECT municipality, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM spans),
    series AS (SELECT municipality, month, coalesce(n, 0) AS n FROM grid LEFT JOIN cells USING (municipality, month))"""


def _rare_series(spark, folder):
    """Monthly records of one rare kind per place: many months have none."""
    rare = model.fact(spark, folder).filter(F.col("gender") == "P")
    return seasonal.month_series(rare, "event_time", ["municipality"])


@query("month_series", SERIES_SQL + " SELECT municipality, month, CAST(n AS BIGINT) AS n FROM series")
def month_series(spark, folder):
    return _rare_series(spark, folder)


@query(
    "seasonal_index",
    SERIES_SQL
    + """, wide AS (SELECT *, count(*) OVER w13 AS c, (sum(n) OVER w13 + sum(n) OVER w11) / 24.0::DOUBLE AS trend FROM series
        WINDOW w13 AS (PARTITION BY municipality ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
          w11 AS (PARTITION BY municipality ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
      means AS (SELECT municipality, CAST(month(month) AS INTEGER) AS month_of_year, count(*) AS ratios, avg(n / trend) AS m FROM wide
        WHERE c = 13 AND trend > 0 GROUP BY ALL)
      SELECT municipality, month_of_year, ratios, round(m / nullif(avg(m) OVER (PARTITION BY municipality), 0), 8) AS seasonal_index FROM means""",
)
def seasonal_index(spark, folder):
    """Ratio-to-moving-average indices on a grid without gaps."""
    return rounded(seasonal.seasonal_index(_rare_series(spark, folder), ["municipality"]), "seasonal_index", digits=8)


@query("monthly_forecast")
def monthly_forecast(spark, folder):
    """A year ahead per offence and over all places with records of the rare kind."""
    series = seasonal.month_series(model.records(spark, folder), "event_time", ["offence"])
    rare = _rare_series(spark, folder).withColumnRenamed("municipality", "offence")
    return seasonal.forecast(series.unionByName(rare), ["offence"])
