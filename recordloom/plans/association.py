"""Queries for correlations, trends and association tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.pvalues import verdict
from recordloom.operators import filters, stats
from recordloom.operators.frequency import counts, only_top, tally
from recordloom.plans import model
from recordloom.plans.profiling import rounded
from recordloom.plans.registry import query

WITH_RECORDS = "WITH " + model.RECORDS_SQL
WITH_FACT = "WITH " + model.FACT_SQL
WITH_LINES = "WITH " + model.LINES_SQL

MEASURES = ("quantity", "price", "discount", "tax")
PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]

HOLES_SQL = WITH_LINES + """, holes AS (SELECT CASE WHEN record_id % 9 = 2 THEN NULL ELSE quantity END AS quantity,
    CASE WHEN record_id % 7 = 1 THEN NULL ELSE price END AS price, discount, tax, year FROM lines)"""


def holes(spark, folder):
    """Line measures with some values missing in two of the columns."""
    return model.lines(spark, folder).select(
        F.expr("CASE WHEN record_id % 9 = 2 THEN NULL ELSE quantity END").alias("quantity"),
        F.expr("CASE WHEN record_id % 7 = 1 THEN NULL ELSE price END").alias("price"),
        "discount",
        "tax",
        "year",
    )


def _corr_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 8) AS corr FROM holes"


@query(
    "corr_pearson",
    HOLES_SQL + " " + " UNION ALL ".join(_corr_sql(a, b) for a in MEASURES for b in MEASURES),
)
def corr_pearson(spark, folder):
    return rounded(stats.pearson_matrix(holes(spark, folder), MEASURES), "corr", digits=8)


def _rank_sql(a: str, b: str, by: str = "") -> str:
    part, head = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {head}'{a}' AS left_column, '{b}' AS right_column, round(corr(ra, rb), 8) AS corr FROM (SELECT {head}
      rank() OVER ({part} ORDER BY a) + (count(*) OVER (PARTITION BY {head}a) - 1) / 2.0::DOUBLE AS ra,
      rank() OVER ({part} ORDER BY b) + (count(*) OVER (PARTITION BY {head}b) - 1) / 2.0::DOUBLE AS rb
      FROM (SELECT {head}{a} AS a, {b} AS b FROM holes WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) {group}"""


@query("corr_spearman", HOLES_SQL + " " + " UNION ALL ".join(_rank_sql(a, b) for a, b in PAIRS))
def corr_spearman(spark, folder):
    return rounded(stats.spearman(holes(spark, folder), MEASURES), "corr", digits=8)


@query(
    "corr_spearman_year",
    HOLES_SQL + " " + " UNION ALL ".join(_rank_sql(a, b, "year") for a, b in (("quantity", "discount"), ("quantity", "tax"), ("discount", "tax"))),
)
def corr_spearman_year(spark, folder):
    return rounded(stats.spearman(holes(spark, folder), ["quantity", "discount", "tax"], ["year"]), "corr", digits=8)


def _tau_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS left_column, '{b}' AS right_column, round((SELECT CAST(sum(CASE WHEN (x.a - y.a) * (x.b - y.b) > 0 THEN x.n * y.n
        WHEN (x.a - y.a) * (x.b - y.b) < 0 THEN -x.n * y.n ELSE 0 END) AS DOUBLE) / 2 FROM c_{a}_{b} x, c_{a}_{b} y)
      / sqrt((n0 - na) * (n0 - nb)), 8) AS corr FROM (SELECT
        (SELECT CAST(sum(n) AS DOUBLE) * (sum(n) - 1) / 2 FROM c_{a}_{b}) AS n0,
        (SELECT CAST(sum(m * (m - 1) / 2) AS DOUBLE) FROM (SELECT sum(n) AS m FROM c_{a}_{b} GROUP BY a)) AS na,
        (SELECT CAST(sum(m * (m - 1) / 2) AS DOUBLE) FROM (SELECT sum(n) AS m FROM c_{a}_{b} GROUP BY b)) AS nb)"""


TAU_PAIRS = (("quantity", "discount"), ("quantity", "tax"), ("discount", "tax"))


@query(
    "corr_kendall",
    HOLES_SQL
    + ", "
    + ", ".join(
        f"c_{a}_{b} AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM holes WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
        for a, b in TAU_PAIRS
    )
    + " "
    + " UNION ALL ".join(_tau_sql(a, b) for a, b in TAU_PAIRS),
)
def corr_kendall(spark, folder):
    return rounded(stats.kendall(holes(spark, folder), ["quantity", "discount", "tax"]), "corr", digits=8)


@query(
    "corr_kendall_wide",
    WITH_LINES
    + """, c AS (SELECT quantity AS a, price AS b, count(*) AS n FROM lines GROUP BY 1, 2),
      below AS (SELECT a, b, sum(n) OVER (PARTITION BY a ORDER BY b) AS upto FROM c),
      met AS (SELECT c.a, c.n, s.a AS other, coalesce(below.upto, 0) AS lower
        FROM c CROSS JOIN (SELECT DISTINCT a FROM c) s ASOF LEFT JOIN below ON below.a = s.a AND c.b > below.b),
      t AS (SELECT CAST(sum(CASE WHEN other < a THEN n * lower END) AS DOUBLE) AS concordant, CAST(sum(CASE WHEN other > a THEN n * lower END) AS DOUBLE) AS discordant FROM met),
      n AS (SELECT (SELECT CAST(sum(n) AS DOUBLE) * (sum(n) - 1) / 2 FROM c) AS n0,
        (SELECT CAST(sum(m * (m - 1) / 2) AS DOUBLE) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS na,
        (SELECT CAST(sum(m * (m - 1) / 2) AS DOUBLE) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS nb)
      SELECT 'quantity' AS left_column, 'price' AS right_column, round((concordant - discordant) / (sqrt(n0 - na) * sqrt(n0 - nb)), 8) AS corr FROM t, n""",
)
def corr_kendall_wide(spark, folder):
    """Price has nearly as many values as rows; the pair count never meets a pair of rows."""
    return rounded(stats.kendall(model.lines(spark, folder), ["quantity", "price"]), "corr", digits=8)


@query(
    "corr_pearson_year",
    HOLES_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT year, '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 8) AS corr FROM holes GROUP BY year" for a, b in PAIRS
    ),
)
def corr_pearson_year(spark, folder):
    return rounded(stats.pearson(holes(spark, folder), MEASURES, ["year"]), "corr", digits=8)


@query(
    "corr_top_pairs",
    HOLES_SQL + " SELECT * FROM (" + " UNION ALL ".join(_corr_sql(a, b) for a, b in PAIRS) + ") ORDER BY abs(corr) DESC, 1, 2 LIMIT 5",
)
def corr_top_pairs(spark, folder):
    return rounded(stats.strongest_pairs(holes(spark, folder), MEASURES, 5), "corr", digits=8)


TRIMMED_SQL = WITH_LINES + """, kept AS (SELECT quantity, price FROM lines
    WHERE price <= (SELECT quantile_cont(price, 0.99) FROM lines) AND quantity <= (SELECT quantile_cont(quantity, 0.99) FROM lines))"""


@query(
    "linear_trend",
    TRIMMED_SQL
    + """ SELECT CAST(regr_count(price, quantity) AS BIGINT) AS n, round(regr_slope(price, quantity), 6) AS slope,
        round(regr_intercept(price, quantity), 6) AS intercept, round(regr_r2(price, quantity), 8) AS r2 FROM kept""",
)
def linear_trend(spark, folder):
    kept = filters.trim_above(model.lines(spark, folder).select("quantity", "price"), {"price": 0.99, "quantity": 0.99})
    return rounded(rounded(stats.linear_trend(kept, "quantity", "price"), "slope", "intercept", digits=6), "r2", digits=8)


@query(
    "trend_line",
    WITH_LINES
    + """ SELECT quantity, round((SELECT regr_slope(price, quantity) FROM lines) * quantity
        + (SELECT regr_intercept(price, quantity) FROM lines), 4) AS fitted FROM (SELECT DISTINCT quantity FROM lines)""",
)
def trend_line(spark, folder):
    return rounded(stats.fitted_line(model.lines(spark, folder), "quantity", "price"), "fitted")


@query(
    "anova_oneway",
    WITH_RECORDS
    + """, g AS (SELECT offence, count(*) AS n, avg(amount) AS m, var_samp(amount) AS v FROM records GROUP BY 1 ORDER BY n DESC, offence LIMIT 12),
      s AS (SELECT sum(n * (m - (SELECT avg(amount) FROM records)) ** 2) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS d1,
        CAST(sum(n) AS BIGINT) - count(*) AS d2 FROM g),
      f AS (SELECT (b / d1) / (w / d2) AS f, d1, d2 FROM s)
      SELECT round(f, 6) AS f_statistic, d1 AS df_between, d2 AS df_within,
        round((d2 / (d2 + d1 * f)) ** (d2 / 2) * (1 + d2 / 2 * (1 - d2 / (d2 + d1 * f))), 6) AS p_value,
        (d2 / (d2 + d1 * f)) ** (d2 / 2) * (1 + d2 / 2 * (1 - d2 / (d2 + d1 * f))) < 0.05 AS significant FROM f""",
)
def anova_oneway(spark, folder):
    """Five groups give four degrees of freedom, for which the tail has a closed form the check can use."""
    found = stats.anova(model.records(spark, folder), "offence", "amount", top=12)
    return rounded(found.withColumn("significant", verdict(F.col("p_value"))), "f_statistic", "p_value", digits=6)


@query(
    "anova_top12",
    WITH_FACT
    + """, g AS (SELECT municipality, count(*) AS n, avg(amount) AS m, var_samp(amount) AS v FROM fact GROUP BY 1 ORDER BY n DESC, municipality LIMIT 12),
      s AS (SELECT sum(n * (m - (SELECT sum(n * m) / sum(n) FROM g)) ** 2) AS b, sum((n - 1) * v) AS w, count(*) - 1 AS d1, CAST(sum(n) AS BIGINT) - count(*) AS d2 FROM g)
      SELECT round((b / d1) / (w / d2), 6) AS f_statistic, d1 AS df_between, d2 AS df_within FROM s""",
)
def anova_top12(spark, folder):
    """The twelve most frequent of twenty-five groups."""
    found = stats.anova(model.fact(spark, folder), "municipality", "amount", top=12)
    return rounded(found.drop("p_value"), "f_statistic", digits=6)


@query(
    "kruskal_wallis",
    WITH_LINES
    + """, r AS (SELECT age_group, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS r FROM lines),
      n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lines),
      t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM lines GROUP BY quantity)),
      g AS (SELECT age_group, count(*) AS k, avg(r) AS m FROM r GROUP BY 1),
      h AS (SELECT 12 / (n * (n + 1)) * sum(k * (m - (n + 1) / 2) ** 2) / (1 - t / (n ** 3 - n)) AS h, count(*) - 1 AS dof FROM g, n, t GROUP BY n, t)
      SELECT round(h, 6) AS h_statistic, dof, round(exp(-h / 2), 6) AS p_value FROM h""",
)
def kruskal_wallis(spark, folder):
    """Three groups give two degrees of freedom, whose tail is an exponential."""
    return rounded(stats.kruskal(model.lines(spark, folder), "age_group", "quantity"), "h_statistic", "p_value", digits=6)


CHI2_SQL = """, c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2),
      e AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n, CAST(x.m AS DOUBLE) * y.m / (SELECT sum(n) FROM c) AS e
        FROM (SELECT a, sum(n) AS m FROM c GROUP BY 1) x CROSS JOIN (SELECT b, sum(n) AS m FROM c GROUP BY 1) y
        LEFT JOIN c ON c.a = x.a AND c.b = y.b)"""


@query(
    "chi2_independence",
    WITH_RECORDS
    + CHI2_SQL.format(a="offence", b="gender", t="records")
    + """, s AS (SELECT sum((n - e) ** 2 / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e)
      SELECT round(x, 6) AS chi2, dof, round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6), 6) AS p_value FROM s""",
)
def chi2_independence(spark, folder):
    """Eight degrees of freedom: the tail is a short sum the check can state."""
    cells = counts(model.records(spark, folder), "offence", "gender")
    return rounded(stats.chi2_independence(cells, "offence", "gender"), "chi2", "p_value", digits=6)


@query(
    "chi2_top",
    WITH_FACT
    + """, sub AS (SELECT municipality, weapon FROM fact
        WHERE municipality IN (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 10))"""
    + CHI2_SQL.format(a="municipality", b="weapon", t="sub")
    + """ SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e""",
)
def chi2_top(spark, folder):
    cells = tally(model.fact(spark, folder), "municipality", "weapon")
    kept = only_top(cells, cells, "municipality", 10)
    return rounded(stats.chi2_independence(kept, "municipality", "weapon").select("chi2", "dof"), "chi2", digits=6)


@query(
    "chi2_top_both",
    WITH_FACT
    + """, sub AS (SELECT municipality, weapon FROM fact
        WHERE municipality IN (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 10)
        AND weapon IN (SELECT weapon FROM fact GROUP BY 1 ORDER BY count(*) DESC, weapon LIMIT 3))"""
    + CHI2_SQL.format(a="municipality", b="weapon", t="sub")
    + """, x AS (SELECT sum((n - e) ** 2 / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e)
      SELECT round(chi2, 6) AS chi2, dof, round(exp(-chi2 / 2) * list_sum(list_transform(range(9), lambda k: (chi2 / 2) ** k / factorial(CAST(k AS INTEGER)))), 6) AS p_value FROM x""",
)
def chi2_top_both(spark, folder):
    """Ten values against three give eighteen degrees of freedom, whose tail is a finite sum."""
    cells = tally(model.fact(spark, folder), "municipality", "weapon")
    kept = only_top(only_top(cells, cells, "municipality", 10), cells, "weapon", 3)
    found = stats.chi2_independence(kept, "municipality", "weapon")
    return rounded(found.select("chi2", "dof", "p_value"), "chi2", "p_value", digits=6)


@query(
    "chi2_yates",
    WITH_LINES
    + ", two AS (SELECT status, quantity > 25 AS many FROM lines)"
    + CHI2_SQL.format(a="status", b="many", t="two")
    + " SELECT round(sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e), 8) AS chi2, CAST(1 AS BIGINT) AS dof FROM e",
)
def chi2_yates(spark, folder):
    cells = counts(model.lines(spark, folder).select("status", (F.col("quantity") > 25).alias("many")), "status", "many")
    return rounded(stats.chi2_independence(cells, "status", "many").select("chi2", "dof"), "chi2", digits=8)
