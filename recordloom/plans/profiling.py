"""Queries for frequencies, profiles, descriptive statistics and chart numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import crosstab as tabs
from recordloom.operators import filters, frequency, summary
from recordloom.operators.frequency import counts, counts_with_nulls
from recordloom.operators.ranking import approx_quantiles, quantiles
from recordloom.plans import model
from recordloom.plans.registry import query
from recordloom.sources.files import table

WITH_RECORDS = "WITH " + model.RECORDS_SQL
WITH_FACT = "WITH " + model.FACT_SQL
WITH_LINES = "WITH " + model.LINES_SQL

GAPPY_SQL = WITH_RECORDS + """, gappy AS (SELECT record_id, CASE WHEN record_id % 4 = 0 THEN NULL ELSE offence END AS offence,
    CASE WHEN record_id % 10 = 3 THEN NULL ELSE gender END AS gender, year FROM records)"""


def gappy(spark, folder):
    """Records in which some offences and genders are missing."""
    return model.records(spark, folder).select(
        "record_id",
        F.expr("CASE WHEN record_id % 4 = 0 THEN NULL ELSE offence END").alias("offence"),
        F.expr("CASE WHEN record_id % 10 = 3 THEN NULL ELSE gender END").alias("gender"),
        "year",
    )


def rounded(df, *columns, digits=4):
    """Round the listed double columns for display."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("value_counts", GAPPY_SQL + " SELECT offence, count(*) AS n FROM gappy WHERE offence IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, folder):
    return counts(gappy(spark, folder), "offence").orderBy(*frequency.biggest_first("offence"))


@query("value_counts_nulls", GAPPY_SQL + " SELECT offence, count(*) AS n FROM gappy GROUP BY 1")
def value_counts_nulls(spark, folder):
    return counts_with_nulls(gappy(spark, folder), "offence")


@query(
    "freq_cum_pct",
    GAPPY_SQL
    + """, c AS (SELECT offence, count(*) AS n FROM gappy GROUP BY 1), t AS (SELECT count(*) AS total FROM gappy)
      SELECT offence, n, round(n * 100.0 / total, 4) AS pct,
        round(CAST(sum(n) OVER (ORDER BY n DESC, offence ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0 / total, 4) AS cum_pct
      FROM c, t WHERE offence IS NOT NULL""",
)
def freq_cum_pct(spark, folder):
    return frequency.frequency_table(gappy(spark, folder), "offence", digits=4)


@query(
    "freq_cum_pct_wide",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS total FROM lineitem)
      SELECT l_partkey, n, round(n * 100.0 / total, 6) AS pct,
        round(CAST(sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0 / total, 6) AS cum_pct
      FROM c, t""",
)
def freq_cum_pct_wide(spark, folder):
    return frequency.frequency_table(table(spark, folder, "lineitem"), "l_partkey", digits=6)


@query("group_size", GAPPY_SQL + " SELECT year, offence, count(*) AS n FROM gappy WHERE offence IS NOT NULL GROUP BY 1, 2")
def group_size(spark, folder):
    return counts(gappy(spark, folder), "year", "offence")


@query(
    "group_stats",
    WITH_LINES
    + """ SELECT age_group, count(price) AS count, round(avg(price), 6) AS mean, round(median(price), 6) AS median,
        round(stddev_samp(price), 6) AS std, min(price) AS min, max(price) AS max, round(sum(price), 2) AS sum
        FROM lines GROUP BY 1 ORDER BY mean DESC LIMIT 15""",
)
def group_stats(spark, folder):
    stats = summary.group_stats(model.lines(spark, folder), ["age_group"], "price")
    top = stats.orderBy(F.desc("mean"), "age_group").limit(15)
    return rounded(rounded(top, "mean", "median", "std", digits=6), "sum", digits=2)


@query(
    "group_stats_place",
    WITH_FACT
    + """ SELECT municipality, count(amount) AS count, round(avg(amount), 6) AS mean, round(median(amount), 6) AS median,
        round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max, round(sum(amount), 2) AS sum
        FROM fact GROUP BY 1 ORDER BY sum(amount) DESC LIMIT 15""",
)
def group_stats_place(spark, folder):
    stats = summary.group_stats(model.fact(spark, folder), ["municipality"], "amount")
    top = stats.orderBy(F.desc("sum"), "municipality").limit(15)
    return rounded(rounded(top, "mean", "median", "std", digits=6), "sum", digits=2)


@query(
    "mean_sum_by_year",
    WITH_RECORDS
    + """ SELECT offence, year, round(avg(amount), 6) AS mean, round(sum(amount), 2) AS sum FROM records WHERE offence IN
        (SELECT offence FROM records GROUP BY 1 ORDER BY count(*) DESC, offence LIMIT 3) GROUP BY ALL""",
)
def mean_sum_by_year(spark, folder):
    rows = model.records(spark, folder).select("offence", "year", "amount")
    kept = frequency.only_top(rows, counts(rows, "offence"), "offence", 3)
    yearly = kept.groupBy("offence", "year").agg(F.avg("amount").alias("mean"), F.sum("amount").alias("sum"))
    return rounded(rounded(yearly, "mean", digits=6), "sum", digits=2)


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 4) AS mean,
        round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
        round(quantile_cont({column}, 0.25), 4) AS q25, round(quantile_cont({column}, 0.5), 4) AS q50,
        round(quantile_cont({column}, 0.75), 4) AS q75,
        round(quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25), 4) AS iqr,
        round(stddev_samp({column}) / avg({column}) * 100, 4) AS cv_pct, count(*) - count({column}) AS nulls FROM measured"""


@query(
    "describe_ext",
    WITH_LINES
    + """, measured AS (SELECT CASE WHEN record_id % 9 = 2 THEN NULL ELSE quantity END AS quantity, price, CAST(year AS DOUBLE) AS year FROM lines) """
    + " UNION ALL ".join(_describe_sql(c) for c in ("quantity", "price", "year")),
)
def describe_ext(spark, folder):
    rows = model.lines(spark, folder).withColumn("quantity", F.expr("CASE WHEN record_id % 9 = 2 THEN NULL ELSE quantity END"))
    return rounded(summary.describe(rows, ["quantity", "price", "year"]), "mean", "std", "q25", "q50", "q75", "iqr", "cv_pct")


@query(
    "null_profile",
    GAPPY_SQL
    + """ SELECT * FROM (SELECT 'offence' AS "column", count(*) - count(offence) AS nulls, round((count(*) - count(offence)) * 100.0 / count(*), 4) AS pct FROM gappy
      UNION ALL SELECT 'gender', count(*) - count(gender), round((count(*) - count(gender)) * 100.0 / count(*), 4) FROM gappy) WHERE nulls > 0""",
)
def null_profile(spark, folder):
    return rounded(summary.null_profile(gappy(spark, folder)), "pct").orderBy(F.desc("nulls"), "column")


@query(
    "column_profile",
    GAPPY_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", CAST({i} AS INTEGER) AS position, '{t}' AS type, count(DISTINCT {c}) AS distinct_values,
        count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct FROM gappy"""
        for i, (c, t) in enumerate([("record_id", "bigint"), ("offence", "string"), ("gender", "string"), ("year", "int")], 1)
    ),
)
def column_profile(spark, folder):
    return rounded(summary.column_profile(gappy(spark, folder)), "null_pct")


@query("nunique", WITH_FACT + " SELECT count(DISTINCT department) AS departments, count(DISTINCT municipality) AS municipalities, count(DISTINCT offence) AS offences FROM fact")
def nunique(spark, folder):
    return model.fact(spark, folder).agg(
        F.count_distinct("department").alias("departments"),
        F.count_distinct("municipality").alias("municipalities"),
        F.count_distinct("offence").alias("offences"),
    )


@query(
    "distinct_per_column",
    GAPPY_SQL + """ SELECT DISTINCT 'offence' AS "column", offence AS value FROM gappy WHERE offence IS NOT NULL
      UNION ALL SELECT DISTINCT 'gender', gender FROM gappy WHERE gender IS NOT NULL
      UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM gappy""",
)
def distinct_per_column(spark, folder):
    rows = gappy(spark, folder).select("offence", "gender", F.col("year").cast("string").alias("year"))
    return rows.unpivot([], ["offence", "gender", "year"], "column", "value").filter(F.col("value").isNotNull()).distinct()


@query(
    "argmax_argmin",
    WITH_RECORDS
    + """, c AS (SELECT year, count(*) AS n FROM records GROUP BY 1)
      SELECT (SELECT year FROM c ORDER BY n DESC, year LIMIT 1) AS max_value, max(n) AS max_n,
        (SELECT year FROM c ORDER BY n, year LIMIT 1) AS min_value, min(n) AS min_n FROM c""",
)
def argmax_argmin(spark, folder):
    return frequency.extremes(counts(model.records(spark, folder), "year"), "year")


@query(
    "mode_share",
    GAPPY_SQL
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM gappy) AS distinct_values, CAST({c} AS VARCHAR) AS mode, n AS mode_n,
        round(n * 100.0 / (SELECT count(*) FROM gappy), 4) AS mode_pct FROM (SELECT {c}, count(*) AS n FROM gappy
        WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"""
        for c in ("offence", "gender", "year")
    ),
)
def mode_share(spark, folder):
    return rounded(frequency.modes(gappy(spark, folder), ["offence", "gender", "year"]), "mode_pct")


@query(
    "kpi_bundle",
    WITH_FACT
    + """ SELECT count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years,
        count(DISTINCT offence) AS offences, count(DISTINCT municipality) AS municipalities,
        round(count(*) FILTER (WHERE offence = '1-URGENT') * 100.0 / count(*), 4) AS urgent_pct FROM fact""",
)
def kpi_bundle(spark, folder):
    urgent = F.count_if(F.col("offence") == "1-URGENT")
    return frequency.key_figures(
        model.fact(spark, folder),
        {
            "n_rows": F.count(F.lit(1)),
            "first_year": F.min("year"),
            "last_year": F.max("year"),
            "years": F.count_distinct("year"),
            "offences": F.count_distinct("offence"),
            "municipalities": F.count_distinct("municipality"),
            "urgent_pct": F.round(urgent * 100.0 / F.count(F.lit(1)), 4),
        },
    )


@query(
    "topk_share",
    WITH_FACT
    + """, c AS (SELECT municipality, count(*) AS n FROM fact GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS top_n, (SELECT count(*) FROM fact) AS total,
        round(sum(n) * 100.0 / (SELECT count(*) FROM fact), 4) AS pct FROM (SELECT n FROM c ORDER BY n DESC, municipality LIMIT 5)""",
)
def topk_share(spark, folder):
    return rounded(frequency.top_share(frequency.tally(model.fact(spark, folder), "municipality"), "municipality", 5), "pct")


@query(
    "crosstab",
    GAPPY_SQL
    + """ SELECT offence, count(*) FILTER (gender = 'F') AS "F", count(*) FILTER (gender = 'O') AS "O", count(*) FILTER (gender = 'P') AS "P"
        FROM gappy WHERE offence IS NOT NULL AND gender IS NOT NULL GROUP BY offence""",
)
def crosstab(spark, folder):
    return tabs.crosstab(gappy(spark, folder), "offence", "gender")


@query(
    "crosstab_margins",
    GAPPY_SQL
    + """ SELECT coalesce(offence, 'All') AS offence, coalesce(gender, 'All') AS gender, count(*) AS n FROM gappy
        WHERE offence IS NOT NULL AND gender IS NOT NULL GROUP BY CUBE (offence, gender)""",
)
def crosstab_margins(spark, folder):
    return tabs.crosstab_margins(gappy(spark, folder), "offence", "gender")


@query(
    "crosstab_rowpct",
    GAPPY_SQL
    + """ SELECT offence, gender, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY offence), 4) AS pct
        FROM gappy WHERE offence IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2""",
)
def crosstab_rowpct(spark, folder):
    return rounded(tabs.row_percent(frequency.tally(gappy(spark, folder), "offence", "gender"), "offence", "gender"), "pct")


@query(
    "topn_crosstab",
    WITH_FACT
    + """ SELECT municipality, weapon, count(*) AS n FROM fact
        WHERE municipality IN (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 10)
        AND weapon IN (SELECT weapon FROM fact GROUP BY 1 ORDER BY count(*) DESC, weapon LIMIT 3) GROUP BY 1, 2""",
)
def topn_crosstab(spark, folder):
    return tabs.top_crosstab(frequency.tally(model.fact(spark, folder), "municipality", "weapon"), "municipality", "weapon", 10, 3)


@query(
    "measure_summary",
    WITH_LINES
    + " SELECT count(price) AS n, round(sum(price), 2) AS sum, round(avg(price), 4) AS mean, max(price) AS max, round(median(price), 4) AS median FROM lines",
)
def measure_summary(spark, folder):
    found = summary.measure_summary(model.lines(spark, folder), "price")
    return rounded(rounded(found, "mean", "median"), "sum", digits=2)


@query(
    "quantiles",
    WITH_LINES
    + " UNION ALL ".join(
        f""" SELECT '{c}' AS "column", count({c}) AS n, round(quantile_cont({c}, 0.25), 4) AS q0, round(quantile_cont({c}, 0.5), 4) AS q1,
        round(quantile_cont({c}, 0.75), 4) AS q2, round(quantile_cont({c}, 0.95), 4) AS q3, round(quantile_cont({c}, 0.99), 4) AS q4 FROM lines"""
        for c in ("price", "quantity")
    ),
)
def quantile_query(spark, folder):
    found = quantiles(model.lines(spark, folder), ["price", "quantity"], [0.25, 0.5, 0.75, 0.95, 0.99])
    return rounded(found, "q0", "q1", "q2", "q3", "q4")


@query(
    "quantiles_approx",
    WITH_LINES
    + ", steps AS (SELECT age_group, floor(price / 5000) * 5000 AS price, quantity FROM lines) "
    + " UNION ALL ".join(
        f"""SELECT age_group, '{c}' AS "column", count({c}) AS n, quantile_disc({c}, 0.25) AS q0, quantile_disc({c}, 0.5) AS q1,
        quantile_disc({c}, 0.75) AS q2 FROM steps GROUP BY age_group"""
        for c in ("price", "quantity")
    ),
)
def quantiles_approx(spark, folder):
    """Both columns have few values, so the sketch and the exact quantile name the same one."""
    steps = model.lines(spark, folder).withColumn("price", F.floor(F.col("price") / 5000) * 5000.0)
    return approx_quantiles(steps, ["price", "quantity"], [0.25, 0.5, 0.75], ["age_group"])


@query("quantile_trim", WITH_LINES + " SELECT record_id, price FROM lines WHERE price <= (SELECT quantile_cont(price, 0.95) FROM lines)")
def quantile_trim(spark, folder):
    return filters.trim_above(model.lines(spark, folder).select("record_id", "price"), {"price": 0.95})


@query(
    "trim_per_group",
    WITH_LINES
    + """ SELECT record_id, lines.year, price FROM lines JOIN (SELECT year, quantile_cont(price, 0.99) AS q FROM lines GROUP BY 1) t
        ON t.year = lines.year WHERE price <= q""",
)
def trim_per_group(spark, folder):
    return filters.trim_above_by(model.lines(spark, folder).select("record_id", "year", "price"), ["year"], "price", 0.99)


@query(
    "histogram",
    WITH_LINES
    + """, kept AS (SELECT price FROM lines WHERE price <= (SELECT quantile_cont(price, 0.99) FROM lines)),
      e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 60 AS w, count(*) AS m FROM kept)
      SELECT CAST(least(floor((price - lo) / w), 59) AS INTEGER) AS bin, round(lo + CAST(least(floor((price - lo) / w), 59) AS INTEGER) * w, 4) AS bin_start,
        round(lo + (CAST(least(floor((price - lo) / w), 59) AS INTEGER) + 1) * w, 4) AS bin_end, count(*) AS n,
        round(count(*) / any_value(m) / any_value(w), 10) AS density FROM kept, e GROUP BY 1, 2, 3""",
)
def histogram(spark, folder):
    kept = filters.trim_above(model.lines(spark, folder).select("price"), {"price": 0.99})
    found = summary.histogram(kept, "price", 60)
    return rounded(rounded(found, "bin_start", "bin_end"), "density", digits=10)


BOX_SQL = """, q AS (SELECT {g} AS g, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3,
      count(*) AS n, avg({x}) AS mean FROM kept GROUP BY 1)
    SELECT g AS {g}, any_value(q.n) AS n, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS q2, round(any_value(q3), 4) AS q3,
      round(any_value(mean), 4) AS mean,
      round(least(min({x}) FILTER (WHERE {x} >= q1 - (q3 - q1) * 1.5), any_value(q1)), 4) AS whisker_low,
      round(greatest(max({x}) FILTER (WHERE {x} <= q3 + (q3 - q1) * 1.5), any_value(q3)), 4) AS whisker_high
    FROM kept JOIN q ON q.g = kept.{g} GROUP BY 1"""


@query(
    "boxplot_stats",
    WITH_FACT
    + """, sub AS (SELECT municipality, amount FROM fact WHERE municipality IN
        (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 12)),
      kept AS (SELECT * FROM sub WHERE amount <= (SELECT quantile_cont(amount, 0.95) FROM sub))"""
    + BOX_SQL.format(g="municipality", x="amount"),
)
def boxplot_stats(spark, folder):
    boxes = summary.box_stats(model.fact(spark, folder), "municipality", "amount", trim=0.95, top=12)
    return rounded(boxes, "q1", "q2", "q3", "mean", "whisker_low", "whisker_high")


@query(
    "boxplot_gender",
    WITH_RECORDS
    + """, kept AS (SELECT gender, amount FROM records WHERE amount <= (SELECT quantile_cont(amount, 0.95) FROM records))"""
    + BOX_SQL.format(g="gender", x="amount"),
)
def boxplot_gender(spark, folder):
    boxes = summary.box_stats(model.records(spark, folder), "gender", "amount")
    return rounded(boxes, "q1", "q2", "q3", "mean", "whisker_low", "whisker_high")


@query(
    "density_by_group",
    WITH_LINES
    + """, e AS (SELECT age_group AS g, min(quantity) AS lo, (max(quantity) - min(quantity)) / 20 AS w, count(*) AS m FROM lines GROUP BY 1)
      SELECT age_group, CAST(least(floor((quantity - lo) / w), 19) AS INTEGER) AS bin,
        round(lo + CAST(least(floor((quantity - lo) / w), 19) AS INTEGER) * w, 4) AS bin_start,
        round(lo + (CAST(least(floor((quantity - lo) / w), 19) AS INTEGER) + 1) * w, 4) AS bin_end,
        count(*) AS n, round(count(*) / any_value(m) / any_value(w), 8) AS density FROM lines JOIN e ON g = age_group GROUP BY 1, 2, 3, 4""",
)
def density_by_group(spark, folder):
    found = summary.histogram(model.lines(spark, folder), "quantity", 20, ["age_group"])
    return rounded(rounded(found, "bin_start", "bin_end"), "density", digits=8)


@query(
    "log10_summary",
    WITH_FACT
    + """ SELECT round(quantile_cont(x, 0.25), 6) AS q0, round(quantile_cont(x, 0.5), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q2,
        count(*) AS n, 'log10_c_acctbal' AS "column" FROM (SELECT log10(c_acctbal) AS x FROM customer WHERE c_acctbal > 0)""",
)
def log10_summary(spark, folder):
    logs = summary.log10_positive(table(spark, folder, "customer"), "c_acctbal")
    return rounded(quantiles(logs, ["log10_c_acctbal"], summary.QUARTILES), "q0", "q1", "q2", digits=6)


@query(
    "percent_share",
    WITH_FACT + " SELECT municipality, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM fact GROUP BY 1",
)
def percent_share(spark, folder):
    return rounded(frequency.with_share(frequency.tally(model.fact(spark, folder), "municipality"), "municipality"), "pct")
