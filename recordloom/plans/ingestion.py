"""Queries for scans, sinks and messy sheets.

The given tables hold no spreadsheets, so sheets are derived from the records: one
per year and offence, with title lines, a header that differs between years,
data, and a footer that differs between offences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import fixed, values
from recordloom.operators import joins
from recordloom.operators.frequency import counts
from recordloom.plans import jobs, model
from recordloom.plans.profiling import rounded
from recordloom.plans.registry import query
from recordloom.session import scratch_path, settle
from recordloom.sources import files, grid
from recordloom.sources.files import table

WITH_RECORDS = "WITH " + model.RECORDS_SQL
WITH_FACT = "WITH " + model.FACT_SQL

DATA_START = 100
EVEN_HEADER = ("DEPARTAMENTO", "MUNICIPIO", "ARMA MEDIO", "FECHA HECHO", "GENERO", "CANTIDAD")
ODD_HEADER = ("Departamento", "Ciudad", "Fecha", "Genero", "Armas Medios", "Cantidad")
SHEET_FIELDS = ("departamento", "municipio", "arma_medio", "fecha_hecho", "genero", "cantidad")

SHEETS_SQL = WITH_FACT + """, sheets AS (SELECT 'sheet_' || year || '_' || offence || '.csv' AS file, year, offence, count(*) AS rows,
    CASE WHEN year % 2 = 0 THEN 9 ELSE 10 END AS head,
    CASE offence WHEN '4-NOT SPECIFIED' THEN 0 WHEN '5-LOW' THEN 2 ELSE 3 END AS foot FROM fact GROUP BY ALL)"""


def sheets(spark, folder):
    """Grid of all sheets, landed once; positions order the lines, they are not line numbers."""
    name = F.concat(F.lit("sheet_"), F.col("year").cast("string"), F.lit("_"), F.col("offence"), F.lit(".csv"))
    rows = model.fact(spark, folder).withColumn("file", name)
    even = F.col("year") % 2 == 0
    day = F.date_format("event_time", "yyyyMMdd")
    data = rows.select(
        "file",
        (F.col("record_id") + DATA_START).alias("pos"),
        F.when(even, F.array("department", "municipality", "weapon", day, "gender", F.lit("1")))
        .otherwise(F.array("department", "municipality", day, "gender", "weapon", F.lit("1")))
        .alias("cells"),
    )
    every = rows.groupBy("file", "year", "offence").agg(F.max("record_id").alias("_last"))
    head = F.when(even, 9).otherwise(10)
    title = F.when(F.col("pos") == 0, F.array(F.lit("POLICIA NACIONAL"))).when(
        F.col("pos") == 3, F.array(F.lit("Hechos por municipio"), F.lit(""))
    )
    header = F.when(even, F.array(*[F.lit(h) for h in EVEN_HEADER])).otherwise(F.array(*[F.lit(h) for h in ODD_HEADER]))
    top = every.select("file", "year", F.explode(F.sequence(F.lit(0), head)).alias("pos")).select(
        "file", F.col("pos").cast("long").alias("pos"),
        F.when(F.col("pos") == head, header).otherwise(F.coalesce(title, F.array(F.lit("")))).alias("cells"),
    )
    source = [F.array(F.lit("Fuente: SIEDCO")), F.array(F.lit("Elaborado: analista"), F.lit("ANTIOQUIA"))]
    total = F.array(F.lit(""), F.lit("TOTAL"), F.lit("99"))
    foot = (
        F.when(F.col("offence") == "4-NOT SPECIFIED", F.array().cast("array<array<string>>"))
        .when(F.col("offence") == "5-LOW", F.array(*source))
        .otherwise(F.array(total, *source))
    )
    bottom = every.select("file", "_last", F.posexplode(foot).alias("_i", "cells")).select(
        "file", (F.col("_last") + DATA_START + 1 + F.col("_i")).alias("pos"), "cells"
    )
    return settle(top.unionByName(data).unionByName(bottom))


@query(
    "scan_csv",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL",
)
def scan_csv(spark, folder):
    orders = table(spark, folder, "orders")
    path = files.write_csv(orders, scratch_path(spark, "csv"), separator="\t")
    loaded = files.read_csv(spark, path, orders.schema)
    grouped = loaded.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount")
    )
    return rounded(grouped, "amount", digits=2)


ACCENTS = "concat('É', p_name, 'ñ')"


@query("scan_encoding", f"SELECT p_partkey, {ACCENTS} AS name FROM part")
def scan_encoding(spark, folder):
    """The file is written in a single-byte encoding; the reader has to notice."""
    named = table(spark, folder, "part").select("p_partkey", F.expr(ACCENTS).alias("name"))
    path = files.write_csv(named, scratch_path(spark, "latin"), encoding="ISO-8859-1")
    return files.read_csv(spark, path, named.schema)


@query("scan_json", "SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    return files.project_json(events, "props", "k long", {"k": "k"})


@query(
    "scan_json_records",
    "SELECT r_name AS dpto, n_name AS nom_mpio, r_regionkey AS cod_dpto, n_nationkey AS cod_mpio, CAST(n_nationkey AS DOUBLE) / 2 AS latitude FROM nation JOIN region ON r_regionkey = n_regionkey",
)
def scan_json_records(spark, folder):
    places = model.places(spark, folder)
    path = scratch_path(spark, "json")
    places.write.json(path)
    return files.read_json(spark, path, places.schema)


@query("scan_fixed_header", SHEETS_SQL + " SELECT file, rows + foot + (head - 9) AS lines FROM sheets")
def scan_fixed_header(spark, folder):
    lines = sheets(spark, folder)
    return counts(grid.below(lines, grid.header_at(lines, 9)), "file", n="lines")


@query("header_candidates", SHEETS_SQL + " SELECT file, CAST(head AS INTEGER) AS row_idx, 6 AS n_cells FROM sheets")
def header_candidates(spark, folder):
    found = grid.header_by_candidates(
        sheets(spark, folder), fixed.HEADER_CANDIDATES, fixed.SHEET_COLUMNS, fixed.HEADER_RENAMES
    )
    return found.select("file", "row_idx", F.size("cells").alias("n_cells"))


@query("header_detect", SHEETS_SQL + " SELECT file, CAST(head AS INTEGER) AS row_idx, CASE WHEN year % 2 = 0 THEN 7 ELSE 6 END AS hits FROM sheets")
def header_detect(spark, folder):
    return grid.header_by_words(sheets(spark, folder)).select("file", "row_idx", "hits")


@query("header_targets", SHEETS_SQL + " SELECT file, CAST(head AS INTEGER) AS row_idx FROM sheets")
def header_targets(spark, folder):
    return grid.header_by_targets(sheets(spark, folder), fixed.SHEET_COLUMNS).select("file", "row_idx")


@query("preview_rows", SHEETS_SQL + " SELECT file, least(5, head + 1 + rows + foot) AS lines FROM sheets")
def preview_rows(spark, folder):
    return counts(grid.preview(sheets(spark, folder), 5), "file", n="lines")


@query("footer_cut", SHEETS_SQL + " SELECT file, rows FROM sheets")
def footer_cut(spark, folder):
    lines = sheets(spark, folder)
    body = grid.below(lines, grid.header_by_words(lines))
    return counts(grid.above_cut(body, grid.footer_cut(body)), "file", n="rows")


@query(
    "load_sheets",
    WITH_FACT
    + """ SELECT department AS departamento, municipality AS municipio, weapon AS arma_medio, gender AS genero, year AS anio, offence AS delito,
        CAST(count(*) AS DOUBLE) AS cantidad, CAST(max(event_time) AS DATE) AS last_day FROM fact GROUP BY ALL""",
)
def load_sheets(spark, folder):
    lines = sheets(spark, folder)
    loaded = grid.records(lines, grid.header_by_words(lines), SHEET_FIELDS, fixed.COLUMN_SYNONYMS)
    typed = loaded.select(
        "departamento", "municipio", "arma_medio", "genero",
        F.regexp_extract("file", r"_(20\d{2}|19\d{2})_", 1).cast("int").alias("anio"),
        F.regexp_extract("file", r"_\d{4}_(.*)\.csv$", 1).alias("delito"),
        values.to_number(F.col("cantidad")).alias("cantidad"),
        values.parse_date(F.col("fecha_hecho")).alias("fecha"),
    )
    keys = ["departamento", "municipio", "arma_medio", "genero", "anio", "delito"]
    return typed.groupBy(*keys).agg(F.sum("cantidad").alias("cantidad"), F.max("fecha").alias("last_day"))


@query(
    "unified_records",
    WITH_FACT
    + """ SELECT department AS departamento, municipality AS municipio, weapon AS arma_medio, gender AS genero, CAST(NULL AS VARCHAR) AS codigo_dane,
        year AS "ANIO", upper(offence) AS "DELITO", CAST(count(*) AS DOUBLE) AS cantidad FROM fact GROUP BY ALL""",
)
def unified_records(spark, folder):
    """Years before 2000 are not in the sheet names' pattern, so the year comes from the event date there."""
    offence = F.regexp_extract("file", r"_\d{4}_(.*)\.csv$", 1)
    table_of_all = jobs.unify_sheets(sheets(spark, folder), offence)
    keys = ["departamento", "municipio", "arma_medio", "genero", "codigo_dane", "ANIO", "DELITO"]
    return table_of_all.groupBy(*keys).agg(F.sum("cantidad").alias("cantidad"))


@query(
    "load_audit",
    SHEETS_SQL + " SELECT file, head + 1 + rows + foot AS lines, CAST(head AS INTEGER) AS header_row, rows, 'loaded' AS status FROM sheets",
)
def load_audit(spark, folder):
    lines = sheets(spark, folder)
    headers = grid.header_by_candidates(lines, fixed.HEADER_CANDIDATES, fixed.SHEET_COLUMNS, fixed.HEADER_RENAMES)
    return grid.load_audit(lines, headers, grid.records(lines, headers, SHEET_FIELDS, fixed.COLUMN_SYNONYMS))


@query(
    "load_sheet_files",
    WITH_FACT + " SELECT department AS departamento, gender AS genero, count(*) AS n, round(sum(amount), 2) AS cantidad FROM fact GROUP BY ALL",
)
def load_sheet_files(spark, folder):
    """Sheets as files on disk: every part file carries its own header line."""
    rows = model.fact(spark, folder).select(
        F.col("gender").alias("SEXO"), F.col("amount").alias("Nro Casos"), F.col("department").alias("Dpto"), F.col("weapon").alias("Arma Medio")
    )
    lines = grid.read_grid(spark, files.write_csv(rows, scratch_path(spark, "sheets")))
    loaded = grid.records(
        lines, grid.header_by_words(lines), ("departamento", "genero", "cantidad", "municipio"), fixed.COLUMN_SYNONYMS
    )
    grouped = loaded.groupBy("departamento", "genero").agg(
        F.count(F.lit(1)).alias("n"), F.sum(values.to_number(F.col("cantidad"))).alias("cantidad")
    )
    return rounded(grouped, "cantidad", digits=2)


TEXT_LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"""


def _document_lines(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "file", "pos", F.split("line", " ").alias("cells")
    )


@query(
    "header_detect_text",
    TEXT_LINES_SQL
    + """, s AS (SELECT doc_id, i, """
    + " + ".join(f"CAST(contains(lower(line), '{w}') AS INTEGER)" for w in fixed.HEADER_WORDS)
    + """ AS hits FROM l WHERE i < 40)
      SELECT doc_id, CAST(arg_min(i, -hits * 1000 + i) AS INTEGER) AS row_idx, max(hits) AS hits FROM s GROUP BY 1""",
)
def header_detect_text(spark, folder):
    found = grid.header_by_words(_document_lines(spark, folder))
    return found.select(F.col("file").alias("doc_id"), "row_idx", "hits")


@query(
    "footer_cut_text",
    TEXT_LINES_SQL
    + r""", m AS (SELECT doc_id, i, line, coalesce(min(CASE WHEN regexp_matches(lower(line), '(^|\s)license(\s|:|$)') THEN i END) OVER w,
        min(CASE WHEN regexp_matches(lower(line), 'the|que|der') THEN i END) OVER w) AS cut FROM l WINDOW w AS (PARTITION BY doc_id))
      SELECT doc_id, count(*) AS kept FROM m WHERE (cut IS NULL OR i < cut) AND len(list_filter(string_split(line, ' '), lambda x: trim(x) <> '')) > 0 GROUP BY 1""",
)
def footer_cut_text(spark, folder):
    lines = _document_lines(spark, folder)
    cuts = grid.footer_cut(lines, r"(^|\s)license(\s|:|$)", "the|que|der")
    return counts(grid.above_cut(lines, cuts).select(F.col("file").alias("doc_id")), "doc_id", n="kept")


@query(
    "source_catalogue",
    """SELECT DISTINCT o_orderpriority AS category, CAST(year(o_orderdate) AS VARCHAR) || '_v1' AS edition,
        'landed/' || o_orderpriority || '/' || year(o_orderdate) || '.csv' AS url, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
)
def source_catalogue(spark, folder):
    """A category has one address per year, so its map is as short as the list of years."""
    listed = model.records(spark, folder).select("offence", F.col("year").cast("string").alias("y")).distinct()
    url = F.concat(F.lit("landed/"), "offence", F.lit("/"), "y", F.lit(".csv"))
    catalogue = listed.groupBy(F.col("offence").alias("category")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat("y", F.lit("_v1")), url))).alias("urls")
    )
    return files.source_list(catalogue)


@query("sink_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = files.write_csv(customers, scratch_path(spark, "csv"))
    return files.read_csv(spark, path, customers.schema, ",", "UTF-8")


@query(
    "sink_roundtrip",
    WITH_RECORDS
    + " SELECT year, offence, count(*) AS n, round(sum(CASE WHEN year = 1996 THEN amount + 1 ELSE amount END), 2) AS amount FROM records GROUP BY ALL",
)
def sink_roundtrip(spark, folder):
    """Write by year, then replace one year and leave the others alone."""
    rows = model.records(spark, folder).select("record_id", "offence", "amount", "year")
    path = files.write_by(rows, scratch_path(spark, "by-year"), ["year"])
    corrected = rows.filter(F.col("year") == 1996).withColumn("amount", F.col("amount") + 1)
    files.write_by(corrected, path, ["year"])
    stored = spark.read.schema(rows.schema).parquet(path)
    grouped = stored.groupBy("year", "offence").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return rounded(grouped, "amount", digits=2)


@query("sink_rewrite", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def sink_rewrite(spark, folder):
    """Read a version, correct it and store the next one."""
    base = scratch_path(spark, "versions")
    first = files.rewrite(table(spark, folder, "supplier").select("s_suppkey", "s_name"), base, 1)
    return files.rewrite(first.withColumn("s_name", F.upper("s_name")), base, 2)


@query(
    "sink_unmatched",
    WITH_FACT + ", " + model.PLACES_SQL
    + """ SELECT DISTINCT department, municipality FROM fact WHERE municipality NOT IN (SELECT nom_mpio FROM places WHERE cod_mpio % 3 = 0)""",
)
def sink_unmatched(spark, folder):
    known = model.places(spark, folder).filter(F.col("cod_mpio") % 3 == 0)
    lost = joins.unmatched_keys(model.fact(spark, folder), known, {"department": "dpto", "municipality": "nom_mpio"})
    path = files.write_csv(lost, scratch_path(spark, "unmatched"))
    return files.read_csv(spark, path, lost.schema, ",", "UTF-8")


@query("rows_per_file", "SELECT 'lineitem.parquet' AS file, count(*) AS rows FROM lineitem")
def rows_per_file(spark, folder):
    found = files.rows_per_file(table(spark, folder, "lineitem"))
    name = F.regexp_extract("file", r"([^/]+)(/part-[^/]*)?$", 1)
    return found.groupBy(name.alias("file")).agg(F.sum("rows").alias("rows"))
