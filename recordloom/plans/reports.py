"""Composite reports: the flagship enrichment, summaries, findings and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.values import percent, rate_per_100k
from recordloom.operators import clusters, conform, cube, filters, frequency, joins, ranking, star, summary, trends
from recordloom.operators.frequency import counts
from recordloom.plans import jobs, model
from recordloom.plans.profiling import rounded
from recordloom.plans.registry import query
from recordloom.sources.files import table

WITH_FACT = "WITH " + model.FACT_SQL
WITH_ALL = WITH_FACT + ", " + model.PLACES_SQL + ", " + model.POPULATION_SQL

PLACE_YEAR = ["department", "municipality", "year"]


@query(
    "enrich_rate",
    WITH_ALL
    + """, c AS (SELECT department, municipality, year, count(*) AS n FROM fact GROUP BY ALL)
      SELECT c.department, c.municipality, c.year, n, population, round(n * 100000.0::DOUBLE / population, 4) AS rate,
        CAST(row_number() OVER (PARTITION BY c.year ORDER BY n * 100000.0::DOUBLE / population DESC, c.municipality) AS INTEGER) AS position
      FROM c LEFT JOIN population p ON p.department = c.department AND p.municipality = c.municipality AND p.year = c.year
      QUALIFY position <= 5""",
)
def enrich_rate(spark, folder):
    """Records are counted before they meet the population, so the join sees one row per place and year."""
    cells = counts(model.fact(spark, folder), *PLACE_YEAR)
    rated = joins.attach_same(cells, model.population(spark, folder), PLACE_YEAR, ["population"]).withColumn(
        "rate", rate_per_100k(F.col("n"), F.col("population"))
    )
    top = ranking.top_per_group(rated, ["year"], 5, [F.desc("rate"), F.asc("municipality")])
    return rounded(top.select("department", "municipality", "year", "n", "population", "rate", "position"), "rate")


@query(
    "enrich_rows",
    WITH_ALL
    + """ SELECT record_id, fact.department, fact.municipality, fact.year, latitude, population,
        round(amount / population * 100000, 4) AS rate FROM fact
      LEFT JOIN places ON dpto = fact.department AND nom_mpio = fact.municipality
      LEFT JOIN population p ON p.department = fact.department AND p.municipality = fact.municipality AND p.year = fact.year""",
)
def enrich_rows(spark, folder):
    reference = model.places(spark, folder).select(
        F.col("dpto").alias("department"), F.col("nom_mpio").alias("municipality"), "latitude"
    )
    rows = model.fact(spark, folder).select("record_id", *PLACE_YEAR, "amount")
    placed = joins.attach_same(rows, reference, ["department", "municipality"], ["latitude"])
    peopled = joins.attach_same(placed, model.population(spark, folder), PLACE_YEAR, ["population"])
    rated = peopled.withColumn("rate", rate_per_100k(F.col("amount"), F.col("population")))
    return rounded(rated.select("record_id", *PLACE_YEAR, "latitude", "population", "rate"), "rate")


@query(
    "rate_by_department",
    WITH_ALL
    + """, c AS (SELECT department, municipality, year, count(*) AS n FROM fact GROUP BY ALL)
      SELECT c.department, c.year, CAST(sum(n) AS BIGINT) AS n, CAST(sum(population) AS BIGINT) AS population,
        round(sum(n) * 100000.0::DOUBLE / sum(population), 4) AS rate FROM c
      JOIN population p ON p.municipality = c.municipality AND p.year = c.year GROUP BY ALL""",
)
def rate_by_department(spark, folder):
    cells = counts(model.fact(spark, folder), *PLACE_YEAR)
    joined = joins.attach_same(cells, model.population(spark, folder), PLACE_YEAR, ["population"])
    yearly = joined.groupBy("department", "year").agg(F.sum("n").alias("n"), F.sum("population").alias("population"))
    return rounded(yearly.withColumn("rate", rate_per_100k(F.col("n"), F.col("population"))), "rate")


SUMMARY_COLUMNS = ("offence", "department", "municipality", "gender", "weapon")


@query(
    "executive_summary",
    WITH_FACT
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, (SELECT count(DISTINCT {c}) FROM fact) AS distinct_values, {c} AS label, CAST(n AS DOUBLE) AS value,
        round(n * 100.0 / (SELECT count(*) FROM fact), 4) AS pct FROM (SELECT {c}, count(*) AS n FROM fact GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"""
        for c in SUMMARY_COLUMNS
    )
    + """ UNION ALL SELECT 'rows', NULL, NULL, CAST(count(*) AS DOUBLE), NULL FROM fact
      UNION ALL SELECT 'period', count(DISTINCT year), min(year) || ' - ' || max(year), CAST(max(year) - min(year) + 1 AS DOUBLE), NULL FROM fact
      UNION ALL SELECT 'amount_sum', NULL, NULL, round(sum(amount), 2), NULL FROM fact
      UNION ALL SELECT 'amount_mean', NULL, NULL, round(avg(amount), 2), NULL FROM fact
      UNION ALL SELECT 'amount_median', NULL, NULL, round(median(amount), 2), NULL FROM fact
      UNION ALL SELECT 'amount_max', NULL, NULL, round(max(amount), 2), NULL FROM fact""",
)
def executive_summary(spark, folder):
    """Every categorical column is counted in one pass; amounts and period need no join and scan orders alone."""
    leading = frequency.modes(model.fact(spark, folder), SUMMARY_COLUMNS).select(
        F.col("column").alias("metric"), "distinct_values", F.col("mode").alias("label"),
        F.col("mode_n").cast("double").alias("value"), F.round("mode_pct", 4).alias("pct"),
    )
    rows = model.records(spark, folder)
    middle = F.lit(ranking.thresholds(rows, {"amount": 0.5})["amount"])
    years = F.concat(F.min("year").cast("string"), F.lit(" - "), F.max("year").cast("string"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("long")

    def figure(metric, value, label=none, distinct=number):
        return F.struct(
            F.lit(metric).alias("metric"), distinct.alias("distinct_values"), label.alias("label"),
            value.cast("double").alias("value"), F.lit(None).cast("double").alias("pct"),
        )

    figures = rows.agg(
        F.array(
            figure("rows", F.count(F.lit(1))),
            figure("period", F.max("year") - F.min("year") + 1, years, F.count_distinct("year")),
            figure("amount_sum", F.round(F.sum("amount"), 2)),
            figure("amount_mean", F.round(F.avg("amount"), 2)),
            figure("amount_max", F.round(F.max("amount"), 2)),
        ).alias("f")
    ).withColumn("f", F.concat("f", F.array(figure("amount_median", F.round(middle, 2)))))
    return leading.unionByName(figures.select(F.inline("f")))


@query(
    "findings",
    WITH_FACT
    + """, y AS (SELECT year, count(*) AS n FROM fact GROUP BY 1), o AS (SELECT offence, count(*) AS n FROM fact GROUP BY 1),
      m AS (SELECT municipality, count(*) AS n FROM fact GROUP BY 1)
      SELECT (SELECT round((arg_max(n, year) - arg_min(n, year)) * 100.0 / arg_min(n, year), 4) FROM y) AS change_pct,
        (SELECT year FROM y ORDER BY n DESC, year LIMIT 1) AS peak_year,
        (SELECT offence FROM o ORDER BY n DESC, offence LIMIT 1) AS offence,
        (SELECT round(sum(n) * 100.0 / (SELECT count(*) FROM fact), 4) FROM (SELECT n FROM m ORDER BY n DESC, municipality LIMIT 5)) AS top5_pct,
        (SELECT department FROM fact GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS department,
        (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS municipality,
        (SELECT weapon FROM fact GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS weapon,
        (SELECT gender FROM fact GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS gender""",
)
def findings(spark, folder):
    cells = frequency.tally(model.fact(spark, folder), "year", "municipality")
    yearly = frequency.regroup(cells, "year")
    ends = trends.first_to_last(yearly, "year", "n").withColumn("change_pct", F.round("change_pct", 4))
    peak = frequency.extremes(yearly, "year").select("max_value").scalar()
    share = frequency.top_share(cells, "municipality", 5).select(F.round("pct", 4)).scalar()
    leading = frequency.modes(
        model.fact(spark, folder), ["offence", "department", "municipality", "weapon", "gender"]
    ).agg(F.map_from_entries(F.collect_list(F.struct("column", "mode"))).alias("m")).scalar()
    named = ends.select("change_pct", peak.alias("peak_year"), share.alias("top5_pct"), leading.alias("m"))
    return named.select(
        "change_pct", "peak_year", "top5_pct",
        *[F.col("m")[c].alias(c) for c in ("offence", "department", "municipality", "weapon", "gender")],
    )


VICTIMS_SQL = "WITH v AS (SELECT o_orderstatus AS gender, l_returnflag AS age_group FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(
    "victim_profile",
    VICTIMS_SQL
    + """ SELECT 'gender' AS kind, gender, NULL AS age_group, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 4) AS pct FROM v GROUP BY 2
      UNION ALL SELECT 'age', NULL, age_group, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM v), 4) FROM v GROUP BY 3
      UNION ALL SELECT 'gender by age', gender, age_group, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM v), 4) FROM v GROUP BY 2, 3""",
)
def victim_profile(spark, folder):
    """One count over both keys; grouping sets add the margins to that small result."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("gender"))
    victims = model.lines(spark, folder).select("record_id", "age_group").join(orders, "record_id")
    cells = frequency.present(frequency.tally(victims, "gender", "age_group"), "gender", "age_group")
    sets = cells.groupingSets([["gender"], ["age_group"], ["gender", "age_group"]], "gender", "age_group").agg(
        F.sum("n").alias("n"), F.grouping_id("gender", "age_group").alias("_set")
    )
    kind = F.when(F.col("_set") == 1, "gender").when(F.col("_set") == 2, "age").otherwise("gender by age")
    share = F.round(percent(F.col("n"), frequency.total_of(cells)), 4)
    return sets.select(kind.alias("kind"), "gender", "age_group", "n", share.alias("pct"))


@query(
    "box_year_summary",
    WITH_FACT
    + """ SELECT year, count(amount) AS count, round(avg(amount), 6) AS mean, round(median(amount), 6) AS median,
        round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max, round(sum(amount), 2) AS sum FROM fact GROUP BY 1""",
)
def box_year_summary(spark, folder):
    stats = summary.group_stats(model.records(spark, folder), ["year"], "amount")
    return rounded(rounded(stats, "mean", "median", "std", digits=6), "sum", digits=2)


@query(
    "star_schema",
    WITH_FACT
    + """ SELECT CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month, department, offence, gender,
        count(*) AS n, round(sum(amount), 2) AS amount FROM fact GROUP BY ALL""",
)
def star_schema(spark, folder):
    """Facts joined back to their dimensions give the original groups."""
    rows = model.fact(spark, folder).drop("year").select("*", *star.calendar(F.col("event_time")))
    facts, dims = star.build_star(
        rows,
        {
            "time": ["date", "year", "month", "day", "weekday", "period"],
            "place": ["department", "municipality"],
            "victim": ["gender"],
            "weapon": ["weapon"],
            "offence": ["offence"],
        },
        ["record_id", "amount"],
    )
    for name in ("time", "place", "victim", "offence"):
        facts = facts.join(dims[name], f"{name}_key")
    grouped = facts.groupBy("year", "month", "department", "offence", "gender").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
    return rounded(grouped, "amount", digits=2)


YEAR_SQL = """WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'VALLE' WHEN 1 THEN 'Bolívar' WHEN 2 THEN 'La Guajira'
      WHEN 3 THEN 'TOTAL' ELSE 'CESAR' END AS dep, CASE WHEN o_orderkey % 11 = 0 THEN 'NAN' WHEN o_orderkey % 5 = 0 THEN 'Cali (CT)'
      WHEN o_orderkey % 5 = 1 THEN 'CARTAGENA' WHEN o_orderkey % 7 = 0 THEN '-' ELSE 'MANAURE' END AS mun, o_orderdate AS d, o_custkey AS n FROM orders),
    clean AS (SELECT id, CASE dep WHEN 'VALLE' THEN 'VALLE DEL CAUCA' WHEN 'Bolívar' THEN 'BOLIVAR' WHEN 'La Guajira' THEN 'LA GUAJIRA' ELSE dep END AS dep,
      CASE WHEN mun = 'Cali (CT)' THEN 'SANTIAGO DE CALI' WHEN mun = 'CARTAGENA' THEN 'CARTAGENA DE INDIAS'
      WHEN dep = 'CESAR' THEN 'MANAURE BALCON DEL CESAR' ELSE mun END AS mun, d, n, CAST(year(d) AS INTEGER) AS y
      FROM raw WHERE dep <> 'TOTAL' AND mun NOT IN ('NAN', '-'))"""


def _yearly(spark, folder):
    """A yearly sheet with the usual faults, one row per order."""
    dep = "CASE o_orderkey % 5 WHEN 0 THEN 'VALLE' WHEN 1 THEN 'Bolívar' WHEN 2 THEN 'La Guajira' WHEN 3 THEN 'TOTAL' ELSE 'CESAR' END"
    mun = (
        "CASE WHEN o_orderkey % 11 = 0 THEN 'NAN' WHEN o_orderkey % 5 = 0 THEN 'Cali (CT)' WHEN o_orderkey % 5 = 1 THEN 'CARTAGENA' "
        "WHEN o_orderkey % 7 = 0 THEN '-' ELSE 'MANAURE' END"
    )
    raw = table(spark, folder, "orders").select(
        F.expr(dep).alias("DEPARTAMENTO"),
        F.expr(mun).alias("MUNICICPIO"),
        F.col("o_orderpriority").alias("ARMA_MEDIO"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("FECHA"),
        F.concat(F.lower("o_orderstatus"), F.lit(" ")).alias("GENERO"),
        F.col("o_custkey").cast("string").alias("CANTIDAD"),
        F.lit("x").alias("sobra"),
    )
    return jobs.clean_year(raw, F.lit("HURTO"), F.year(F.to_date("FECHA_HECHO")))


@query(
    "cleaned_year",
    YEAR_SQL
    + """ SELECT dep AS "DEPARTAMENTO", mun AS "MUNICIPIO", y AS "ANIO", 'HURTO' AS "TIPO_DELITO", count(*) AS n,
        CAST(sum(n) AS BIGINT) AS "CANTIDAD", CAST(max(d) AS DATE) AS last_day FROM clean GROUP BY ALL""",
)
def cleaned_year(spark, folder):
    grouped = _yearly(spark, folder).groupBy("DEPARTAMENTO", "MUNICIPIO", "ANIO", "TIPO_DELITO")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), F.sum("CANTIDAD").alias("CANTIDAD"), F.max("FECHA_HECHO").alias("last_day")
    )


@query(
    "enriched_year",
    YEAR_SQL
    + """, places AS (SELECT 'VALLE DEL CAUCA' AS dep, 'SANTIAGO DE CALI' AS mun, 1 AS code, 3 AS k UNION ALL
        SELECT 'BOLIVAR', 'CARTAGENA DE INDIAS', 2, 4 UNION ALL SELECT 'LA GUAJIRA', 'MANAURE', 3, 5),
      people AS (SELECT k, count(*) * 10 AS p FROM (SELECT CAST(c_nationkey % 3 AS INTEGER) + 1 AS k FROM customer) GROUP BY 1)
      SELECT clean.dep AS "DEPARTAMENTO", clean.mun AS "MUNICIPIO", y AS "ANIO", n AS "CANTIDAD", code, p AS "POBLACION_TOTAL",
        round(n / p * 100000.0::DOUBLE, 4) AS "TASA_DELITO_100K" FROM clean
      LEFT JOIN places ON places.dep = clean.dep AND places.mun = clean.mun LEFT JOIN people ON people.k = code AND y <= 2000""",
)
def enriched_year(spark, folder):
    """Gazetteer and population arrive with their own spellings, areas and duplicates."""
    names = F.array(
        *[
            F.struct(F.lit(d).alias("dpto"), F.lit(m).alias("nom_mpio"), F.lit(c).alias("code"))
            for d, m, c in (("Valle", "Cali", 1), ("BOLÍVAR", "Cartagena de Indias", 2), ("La Guajira", "Manaure", 3), ("La Guajira", "MANAURE", 9))
        ]
    )
    raw_places = spark.range(1).select(F.inline(names))
    people = table(spark, folder, "customer").groupBy((F.col("c_nationkey") % 3 + 1).alias("k")).agg((F.count(F.lit(1)) * 10).alias("TOTAL"))
    years = F.explode(F.transform(F.sequence(F.lit(1990), F.lit(2001)), lambda y: y.cast("string")))
    yearly = people.join(raw_places, F.col("k") == F.col("code")).select(
        F.col("dpto").alias("DPNOM"), F.col("nom_mpio").alias("DPMP"), F.col("TOTAL").cast("string").alias("TOTAL"),
        years.alias("ANIO"),
    )
    raw_people = yearly.withColumn("AREA_GEOGRAFICA", F.explode(F.array(F.lit(" total "), F.lit("Cabecera"))))
    gazetteer = jobs.prepare_gazetteer(raw_places, F.col("code"))
    population = jobs.prepare_population(raw_people, 1995, 2000)
    done = jobs.enrich(_yearly(spark, folder), gazetteer, population, ["code"])
    shown = done.select("DEPARTAMENTO", "MUNICIPIO", "ANIO", "CANTIDAD", "code", "POBLACION_TOTAL", "TASA_DELITO_100K")
    return rounded(shown, "TASA_DELITO_100K")


BUNDLES = {
    "all": {}, "one year": {"year": [1996]}, "two places": {"department": ["ASIA", "EUROPE"]},
    "all four": {"year": [1996, 1997], "department": ["ASIA", "AFRICA"], "offence": ["1-URGENT", "2-HIGH"], "gender": ["F", "O"]}, "none": {"gender": ["?"]},
}


def _bundle_sql(name: str, wanted: dict) -> str:
    tests = " AND ".join(f"{c} IN ({', '.join(repr(v) for v in values)})" for c, values in wanted.items()) or "true"
    return f"""SELECT '{name}' AS bundle, count(*) AS n, count(DISTINCT municipality) AS places, true AS near
        FROM fact WHERE {tests}"""


@query("filter_cube", WITH_FACT + " " + " UNION ALL ".join(_bundle_sql(k, v) for k, v in BUNDLES.items()))
def filter_cube(spark, folder):
    """Every filter bundle answered from one cube; distinct persons are within five percent of the exact count."""
    rows = model.fact(spark, folder)
    made = cube.filter_cube(rows, ["year", "department", "offence", "gender"], ["municipality", "person_id"])
    parts = []
    for name, wanted in BUNDLES.items():
        chosen = filters.selection(wanted)
        exact = rows.filter(chosen).agg(F.count_distinct("person_id").alias("persons"))
        near = F.abs(F.col("distinct_person_id") - F.col("persons")) <= 0.05 * F.col("persons")
        found = cube.answer(made, chosen, ["municipality", "person_id"]).join(exact)
        parts.append(found.select(F.lit(name).alias("bundle"), "n", F.col("distinct_municipality").alias("places"), near.alias("near")))
    return conform.stack_by_name(parts)


@query("place_clusters")
def place_clusters(spark, folder):
    """Places grouped by the shares of the offences in their records."""
    cells = frequency.tally(model.fact(spark, folder), "municipality", "offence")
    offences = [r[0] for r in cells.select("offence").distinct().orderBy("offence").collect()]
    points = clusters.profiles(cells, "municipality", "offence", offences)
    return clusters.clusters(points, "municipality", 4)
