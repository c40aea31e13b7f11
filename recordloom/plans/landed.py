"""Queries for landed files: settings per file, cells over several lines, catalogue, quarantine and publication.

The given tables hold no files, so sheets are written from the records first: one
per year and offence, with titles, a header, data and a footer.  By year they come
in three kinds: commas, semicolons in ISO-8859-1, and tabs behind a byte-order mark.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from recordloom.functions import fixed, values
from recordloom.operators import conform
from recordloom.operators.frequency import counts
from recordloom.plans import jobs, model
from recordloom.plans.profiling import rounded
from recordloom.plans.registry import query
from recordloom.session import scratch_path, settle
from recordloom.sources import files, grid, landing, quarantine
from recordloom.sources.files import table

WITH_FACT = "WITH " + model.FACT_SQL
HEADER = ("Departamento", "Municipio", "Arma Medio", "Fecha Hecho", "Genero", "Cantidad")
KINDS = {0: (",", "UTF-8", ""), 1: (";", "ISO-8859-1", ""), 2: ("\t", "UTF-8", "\ufeff")}
TITLES = 2
#: Splits so small that quoted cells lie across their borders: at least so many bytes, and at most about so many splits.
SPLIT_BYTES, SPLITS = 8192, 128

# The same expressions make the cells in Spark and in the check SQL.
CELLS = {
    "department": "CASE WHEN record_id % 50 = 10 THEN NULL ELSE department END",
    "municipality": "CASE WHEN record_id % 50 = 10 THEN NULL ELSE concat(municipality, ' ñ') END",
    "weapon": """CASE record_id % 20 WHEN 3 THEN concat(weapon, chr(10), '"dos", tres; ', chr(9), 'línea')
        WHEN 4 THEN concat('"', weapon, '"', chr(10), chr(10), ',') WHEN 5 THEN concat(weapon, ', 5" y') ELSE weapon END""",
    "day": "CASE WHEN record_id % 50 = 8 THEN '99999999' ELSE day END",
    "gender": "gender",
    "quantity": "CASE WHEN record_id % 50 = 7 THEN 'x1' ELSE '2' END",
    "surplus": "CASE WHEN record_id % 50 = 9 THEN 'sobra' END",
}
CELLS_SQL = WITH_FACT + """, dated AS (SELECT *, strftime(event_time, '%Y%m%d') AS day FROM fact),
    cells AS (SELECT record_id, year, offence, 'sheet_' || year || '_' || offence || '.csv' AS name, """ + ", ".join(
    f"{e} AS {c}" for c, e in CELLS.items()
) + """, CASE WHEN record_id % 50 = 9 THEN 'cells beyond the header' WHEN record_id % 50 = 10 THEN 'no place'
        WHEN record_id % 50 = 7 THEN 'no quantity' WHEN record_id % 50 = 8 THEN 'no date' ELSE 'good' END AS outcome FROM dated)"""


def land(spark, folder: str) -> str:
    """The sheets as files; lines of a file are written in order by one task."""
    name = F.concat(F.lit("sheet_"), F.col("year").cast("string"), F.lit("_"), F.col("offence"), F.lit(".csv"))
    dated = model.fact(spark, folder).withColumn("day", F.date_format("event_time", "yyyyMMdd"))
    data = settle(
        dated.select(name.alias("name"), (F.col("year") % 3).alias("kind"), F.col("record_id").alias("pos"), *[F.expr(e).alias(c) for c, e in CELLS.items()])
    )
    every = data.groupBy("name", "kind").agg(F.max("pos").alias("_last"))
    path = scratch_path(spark, "landed")
    for kind, (separator, encoding, mark) in KINDS.items():
        top = [[f"{mark}Policía Nacional"], ["Hechos por municipio, todos; \"con\" comas"], list(HEADER)]
        bottom = [["", "TOTAL", "99"], ["Fuente: SIEDCO"]]
        line = lambda at, texts: F.struct(at.alias("pos"), *[F.lit(t).alias(c) for t, c in zip([*texts, *[None] * 7], CELLS)])
        frame = [line(F.lit(k - 9).cast("long"), t) for k, t in enumerate(top)]
        frame += [line(F.col("_last") + 1 + k, t) for k, t in enumerate(bottom)]
        around = every.filter(F.col("kind") == kind).select("name", F.inline(F.array(*frame)))
        lines = data.filter(F.col("kind") == kind).drop("kind").unionByName(around)
        ordered = lines.repartition("name").sortWithinPartitions("name", "pos").drop("pos")
        ordered.write.partitionBy("name").csv(
            f"{path}/{kind}", sep=separator, encoding=encoding, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    return path


def split_bytes(spark, path: str) -> int:
    """Size of small splits for the files below ``path``.

    It grows with the files: each split is a task, and each task reports to the driver.
    """
    landed = files.landed_files(spark, path).agg(F.sum("length").alias("bytes")).first()
    return max(SPLIT_BYTES, (landed["bytes"] or 0) // SPLITS)


@contextlib.contextmanager
def small_splits(spark, path: str):
    """Files are read in splits small beside the files below ``path`` inside."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    size = split_bytes(spark, path)
    for n in names:
        spark.conf.set(n, str(size))
    try:
        yield
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


@query(
    "sheet_settings",
    CELLS_SQL
    + """ SELECT DISTINCT name, CASE year % 3 WHEN 1 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding,
        CASE year % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS separator FROM cells""",
)
def sheet_settings(spark, folder):
    """Encoding and separator of every file of one folder."""
    found = landing.file_settings(landing.raw_lines(spark, land(spark, folder)))
    return found.select(landing.landed_name(F.col("file")).alias("name"), "encoding", "separator")


@query(
    "multiline_cells",
    CELLS_SQL + " SELECT name, weapon, gender, count(*) AS n FROM cells WHERE record_id % 50 <> 10 GROUP BY ALL",
)
def multiline_cells(spark, folder):
    """Cells with line breaks, separators and quotes come back as they were, whatever splits they cross."""
    path = land(spark, folder)
    with small_splits(spark, path):
        lines = grid.read_grid(spark, path)
    loaded = grid.records(lines, grid.header_by_words(lines), ("departamento", "arma_medio", "genero"), fixed.COLUMN_SYNONYMS)
    kept = loaded.filter(F.col("departamento").isNotNull())
    return counts(kept.select(landing.landed_name(F.col("file")).alias("name"), F.col("arma_medio").alias("weapon"), F.col("genero").alias("gender")), "name", "weapon", "gender")


FIRST_YEAR = "(SELECT min(year) FROM fact)"
PLAN_SQL = CELLS_SQL + f""", listed AS (SELECT DISTINCT name, offence AS category, year, year || '_v1' AS edition FROM cells WHERE NOT (offence = '5-LOW' AND year = {FIRST_YEAR})
      UNION ALL SELECT DISTINCT name || 'x', offence, year, year || '_v2' FROM cells WHERE offence = '1-URGENT'
      UNION ALL SELECT DISTINCT name, offence, year, year || '_v0' FROM cells WHERE offence = '1-URGENT'
      UNION ALL SELECT DISTINCT name, 'other', year, '' || year FROM cells WHERE offence = '1-URGENT'),
    plan AS (SELECT lower(coalesce(l.name, c.name)) AS name, category, edition, l.year,
        CASE WHEN category IS NULL THEN 'extra' WHEN c.name IS NULL THEN 'missing' WHEN edition LIKE '%v0' OR category = 'other' THEN 'doubled' ELSE 'planned' END AS status
      FROM listed l FULL JOIN (SELECT DISTINCT name FROM cells) c ON l.name = c.name)"""


def catalogue(spark, folder: str):
    """A catalogue that lacks one landed sheet, and lists for one category files that have not landed, editions twice and under another category."""
    rows = model.records(spark, folder).select("offence", "year").distinct()
    first = settle(rows.agg(F.min("year").alias("first")))
    year = F.col("year").cast("string")
    offence = F.replace(F.col("offence"), F.lit(" "), F.lit("%20"))
    address = F.concat(F.lit("https://host/a%20b/SHEET_"), year, F.lit("_"), offence, F.lit(".csv"))
    entry = lambda edition, url: F.struct(edition.alias("edition"), url.alias("url"))
    urgent = F.col("offence") == "1-URGENT"
    own = F.when(~((F.col("offence") == "5-LOW") & (F.col("year") == F.col("first"))), entry(F.concat(year, F.lit("_v1")), address))
    again = F.when(urgent, entry(F.concat(year, F.lit("_v0")), address))
    absent = F.when(urgent, entry(F.concat(year, F.lit("_v2")), F.concat(address, F.lit("x"))))
    editions = rows.join(first).select(F.col("offence").alias("category"), F.explode(F.array_compact(F.array(own, again, absent))).alias("e"))
    other = rows.filter(urgent).select(F.lit("other").alias("category"), entry(year, address).alias("e"))
    return editions.unionByName(other).groupBy("category").agg(F.map_from_entries(F.collect_list("e")).alias("urls"))


@query("catalogue_plan", PLAN_SQL + " SELECT name, category, edition, year, status FROM plan")
def catalogue_plan(spark, folder):
    """Planned, missing, extra and doubled files of a catalogue and a landing folder."""
    plan = files.plan_loads(files.source_list(catalogue(spark, folder)), files.landed_files(spark, land(spark, folder)))
    return plan.select("name", "category", "edition", "year", "status")


@query(
    "unify_files",
    PLAN_SQL
    + """ SELECT department AS departamento, municipality AS municipio, weapon AS arma_medio, gender AS genero, c.year AS "ANIO", upper(c.offence) AS "DELITO",
        CAST(count(*) AS DOUBLE) * 2 AS cantidad, max(CAST(strptime(day, '%Y%m%d') AS DATE)) AS last_day
        FROM cells c WHERE outcome = 'good' AND lower(name) IN (SELECT name FROM plan WHERE status = 'planned') GROUP BY ALL""",
)
def unify_files(spark, folder):
    """The standard table out of all planned files."""
    path = land(spark, folder)
    with small_splits(spark, path):
        intake, _, _ = jobs.unify_files(spark, path, catalogue(spark, folder))
    keys = ["departamento", "municipio", "arma_medio", "genero", "ANIO", "DELITO"]
    return intake.good.groupBy(*keys).agg(F.sum("cantidad").alias("cantidad"), F.max(values.parse_date(F.col("fecha_hecho"))).alias("last_day"))


@query(
    "load_report",
    PLAN_SQL
    + """, seen AS (SELECT name, outcome, count(*) AS lines FROM cells GROUP BY ALL UNION ALL SELECT DISTINCT name, 'title', 2 FROM cells
        UNION ALL SELECT DISTINCT name, 'header', 1 FROM cells UNION ALL SELECT DISTINCT name, 'footer', 2 FROM cells)
      SELECT name, outcome, CAST(lines AS BIGINT) AS lines FROM seen WHERE lower(name) IN (SELECT name FROM plan WHERE status = 'planned')""",
)
def load_report(spark, folder):
    """Every line of every planned file by what became of it."""
    _, report, _ = jobs.unify_files(spark, land(spark, folder), catalogue(spark, folder))
    return report.filter("lines > 0").select(landing.landed_name(F.col("file")).alias("name"), "outcome", "lines")


QUARANTINE_RULES = {
    "negative balance": "c_acctbal < 0", "no segment": "trim(c_mktsegment) = ''", "odd name": "c_name IS NULL OR c_name NOT LIKE '%#%'",
}


@query(
    "quarantine_counts",
    """WITH j AS (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_name IS NULL OR c_name NOT LIKE '%#%' THEN 'odd name' ELSE 'good' END AS reason FROM customer)
       SELECT c_nationkey, count(*) AS rows_in, count(*) FILTER (reason = 'good') AS rows_out, count(*) FILTER (reason <> 'good') AS audited, CAST(0 AS BIGINT) AS missing
       FROM j GROUP BY 1""",
)
def quarantine_counts(spark, folder):
    """Customers that break a rule are set aside; all are accounted for."""
    customers = table(spark, folder, "customer")
    intake = quarantine.divide(customers, {name: F.expr(rule) for name, rule in QUARANTINE_RULES.items()})
    return quarantine.reconcile(customers, intake, ["c_nationkey"])


YEAR_PLACES = (("VALLE", "Cali (CT)", 1), ("Bolívar", "CARTAGENA", 2), ("La Guajira", "MANAURE", 3))
CONSOLIDATED_SQL = """WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN ' valle ' WHEN 1 THEN 'Bolívar' WHEN 2 THEN 'La Guajira' WHEN 3 THEN 'Total general' WHEN 4 THEN 'Atlantis' ELSE 'CESAR' END AS dep,
      CASE WHEN o_orderkey % 13 = 0 THEN 'NAN' WHEN o_orderkey % 17 = 0 THEN 'Vehiculo ' WHEN o_orderkey % 6 = 0 THEN 'Cali (CT)'
      WHEN o_orderkey % 6 = 1 THEN 'cartagena' WHEN o_orderkey % 7 = 0 THEN ' - ' ELSE 'MANAURE' END AS mun, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey AS n FROM orders),
    clean AS (SELECT CASE dep WHEN ' valle ' THEN 'VALLE DEL CAUCA' WHEN 'Bolívar' THEN 'BOLIVAR' WHEN 'La Guajira' THEN 'LA GUAJIRA' ELSE dep END AS dep,
      CASE WHEN mun = 'Vehiculo ' THEN 'DESCONOCIDO' WHEN mun = 'Cali (CT)' THEN 'SANTIAGO DE CALI' WHEN mun = 'cartagena' THEN 'CARTAGENA DE INDIAS'
      WHEN dep = 'CESAR' THEN 'MANAURE BALCON DEL CESAR' ELSE mun END AS mun, y, n + CASE WHEN y = 1997 THEN 1 ELSE 0 END AS n
      FROM raw WHERE dep NOT IN ('Total general', 'Atlantis') AND mun NOT IN ('NAN', ' - ')),
    people AS (SELECT CAST(c_nationkey % 3 AS INTEGER) + 1 AS k, count(*) * 10 AS p FROM customer GROUP BY 1),
    places AS (SELECT 'VALLE DEL CAUCA' AS dep, 'SANTIAGO DE CALI' AS mun, 1 AS k UNION ALL SELECT 'BOLIVAR', 'CARTAGENA DE INDIAS', 2 UNION ALL SELECT 'LA GUAJIRA', 'MANAURE', 3)"""


@query(
    "consolidated_rates",
    CONSOLIDATED_SQL
    + """ SELECT clean.dep AS "DEPARTAMENTO", clean.mun AS "MUNICIPIO", y AS "ANIO", 'HURTO' AS "TIPO_DELITO", count(*) AS n, CAST(sum(n) AS BIGINT) AS "CANTIDAD",
        max(k) AS code, max(p) AS "POBLACION_TOTAL", round(sum(n / p * 100000.0::DOUBLE), 2) AS rate
        FROM clean LEFT JOIN places USING (dep, mun) LEFT JOIN people USING (k) GROUP BY ALL""",
)
def consolidated_rates(spark, folder):
    """All years cleaned, stacked, enriched and published; then one year is delivered again, corrected."""
    orders = table(spark, folder, "orders")
    years = [r[0] for r in orders.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]
    dep = "CASE o_orderkey % 6 WHEN 0 THEN ' valle ' WHEN 1 THEN 'Bolívar' WHEN 2 THEN 'La Guajira' WHEN 3 THEN 'Total general' WHEN 4 THEN 'Atlantis' ELSE 'CESAR' END"
    mun = (
        "CASE WHEN o_orderkey % 13 = 0 THEN 'NAN' WHEN o_orderkey % 17 = 0 THEN 'Vehiculo ' WHEN o_orderkey % 6 = 0 THEN 'Cali (CT)' "
        "WHEN o_orderkey % 6 = 1 THEN 'cartagena' WHEN o_orderkey % 7 = 0 THEN ' - ' ELSE 'MANAURE' END"
    )

    def sheet(year: int, more: int = 0):
        """The header spellings change with the years."""
        rows = orders.filter((F.col("o_orderdate") >= F.lit(f"{year}-01-01")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01")))
        return rows.select(
            F.expr(dep).alias("DEPARTAMENTO_" if year % 2 else "DEPARTAMENTO"), F.expr(mun).alias("MUNICICPIO" if year % 3 else "MUNICIPIO"),
            F.date_format("o_orderdate", "dd.MM.yyyy").alias("FECHA"), (F.col("o_custkey") + more).cast("string").alias("CANTIDAD"),
            *([F.lit(" ").alias("*AGRUPA_EDAD_PERSONA*")] if year % 2 else [F.lower("o_orderstatus").alias("GENERO")]),
        )

    known = F.array(*[F.struct(F.lit(d).alias("dpto"), F.lit(m).alias("nom_mpio"), F.lit(c).alias("code")) for d, m, c in YEAR_PLACES])
    raw_places = table(spark, folder, "region").limit(1).select(F.inline(known))
    people = table(spark, folder, "customer").groupBy((F.col("c_nationkey") % 3 + 1).alias("k")).agg((F.count(F.lit(1)) * 10).alias("TOTAL"))
    raw_people = people.join(raw_places, F.col("k") == F.col("code")).select(
        F.col("dpto").alias("DPNOM"), F.col("nom_mpio").alias("DPMP"), F.col("TOTAL").cast("string").alias("TOTAL"),
        F.explode(F.array(*[F.lit(str(y)) for y in years])).alias("ANIO"), F.lit("Total").alias("AREA_GEOGRAFICA"),
    )
    gazetteer = jobs.prepare_gazetteer(raw_places.withColumn("nom_mpio", F.regexp_replace("nom_mpio", r" \(CT\)", "")), F.col("code"))
    population = jobs.prepare_population(raw_people.withColumn("DPMP", F.regexp_replace("DPMP", r" \(CT\)", "")), years[0], years[-1])
    path = scratch_path(spark, "consolidated")
    schema = jobs.consolidate({y: sheet(y) for y in years}, F.lit("HURTO"), gazetteer, population, ["code"], path)
    jobs.consolidate({1997: sheet(1997, 1)}, F.lit("HURTO"), gazetteer, population, ["code"], path)
    done = jobs.consolidated(spark, path, schema)
    grouped = done.groupBy("DEPARTAMENTO", "MUNICIPIO", "ANIO", "TIPO_DELITO").agg(
        F.count(F.lit(1)).alias("n"), F.sum("CANTIDAD").alias("CANTIDAD"), F.max("code").alias("code"),
        F.max("POBLACION_TOTAL").alias("POBLACION_TOTAL"), F.sum("TASA_DELITO_100K").alias("rate"),
    )
    return rounded(grouped, "rate", digits=2)


@query("csv_kinds", "SELECT p_partkey, concat('É', p_name, 'ñ') AS name, p_size FROM part")
def csv_kinds(spark, folder):
    """One folder of delimited files in three separators and two encodings, one kind behind a byte-order mark."""
    parts = table(spark, folder, "part").select("p_partkey", F.expr("concat('É', p_name, 'ñ')").alias("name"), "p_size")
    path = scratch_path(spark, "kinds")
    for k, (separator, encoding, mark) in KINDS.items():
        files.write_csv(parts.filter(F.col("p_partkey") % 3 == k), f"{path}/{k}", separator, encoding, bool(mark))
    return files.read_csv(spark, path, parts.schema)
