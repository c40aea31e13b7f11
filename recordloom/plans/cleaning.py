"""Queries for column names, row repair and scalar cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from recordloom.functions import fixed, places, text, values
from recordloom.operators import conform, filters
from recordloom.operators.frequency import counts
from recordloom.plans import model
from recordloom.plans.registry import query
from recordloom.sources.files import table

WITH_RECORDS = "WITH " + model.RECORDS_SQL
WITH_FACT = "WITH " + model.FACT_SQL

# The same expressions make the dirty columns in Spark and in the check SQL.
DIRTY_GENDER = (
    "CASE o_orderkey % 7 WHEN 0 THEN '-' WHEN 1 THEN ' no reporta ' WHEN 2 THEN 'NO RESPORTADO ' "
    "WHEN 3 THEN NULL WHEN 4 THEN '  ' ELSE o_orderstatus END"
)
DIRTY_PLACE = (
    "CASE o_orderkey % 6 WHEN 0 THEN ' Bogotá  D.C. (CT)' WHEN 1 THEN 'Cúcuta' WHEN 2 THEN 'NAN' "
    "WHEN 3 THEN NULL WHEN 4 THEN 'Nariño (ct) 2' ELSE 'San  José' END"
)
DIRTY_DEPARTMENT = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'Atlántico' WHEN 1 THEN 'bogota d.c.' WHEN 2 THEN 'VALLE' WHEN 3 THEN 'nariño' "
    "WHEN 4 THEN 'Archipiélago de San Andrés' WHEN 5 THEN 'Elsewhere' WHEN 6 THEN NULL ELSE 'LA  GUAJIRA' END"
)
DIRTY_NUMBER = (
    "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'n/a' ELSE NULL END"
)
TITLE = "concat(' ', p_brand, ' / ', p_name, ' - ', p_type, ' ñandú')"
SOURCE_NAME = (
    "CASE o_orderkey % 3 WHEN 0 THEN concat('sheet_2019_v', CAST(2000 + o_orderkey % 25 AS VARCHAR(9)), '.xlsx') "
    "WHEN 1 THEN 'sheet_2018.xls' ELSE 'sheet.xls' END"
)


def _orders(spark, folder, **extra):
    base = table(spark, folder, "orders")
    return base.select("*", *[F.expr(e).alias(n) for n, e in extra.items()])


@query(
    "norm_colnames",
    f"""SELECT DISTINCT title, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '_', 'g'), '_') AS column_key,
        replace(replace(replace(upper(trim(title)), ' ', '_'), '/', '_'), '*', '') AS header_key
        FROM (SELECT {TITLE} AS title FROM part)""",
)
def norm_colnames(spark, folder):
    titles = table(spark, folder, "part").select(F.expr(TITLE).alias("title")).distinct()
    return titles.select(
        "title", text.column_key(F.col("title")).alias("column_key"), text.header_key(F.col("title")).alias("header_key")
    )


SYNONYM_NAMES = (
    "CASE o_orderkey % 9 WHEN 0 THEN 'Dpto' WHEN 1 THEN 'Municpio' WHEN 2 THEN 'Arma Empleada' WHEN 3 THEN 'SEXO' "
    "WHEN 4 THEN 'Fecha del Hecho' WHEN 5 THEN 'Grupo Etario' WHEN 6 THEN 'Nro Casos' WHEN 7 THEN 'Codigo DANE' "
    "ELSE o_orderpriority END"
)


@query(
    "synonym_map",
    f"""WITH k AS (SELECT trim(regexp_replace(lower({SYNONYM_NAMES}), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM orders)
        SELECT CASE
          WHEN regexp_full_match(name, 'depto|dep|departamento|dpto') THEN 'departamento'
          WHEN regexp_full_match(name, 'municipio|ciudad|mpio|municpio|munici?p[io]') THEN 'municipio'
          WHEN regexp_full_match(name, 'codigo_dane|cod_dane') THEN 'codigo_dane'
          WHEN regexp_full_match(name, 'arma|medio|arma_emple.*') THEN 'arma_medio'
          WHEN regexp_full_match(name, 'fecha|fecha_del_hecho') THEN 'fecha_hecho'
          WHEN regexp_full_match(name, 'genero|sexo') THEN 'genero'
          WHEN regexp_full_match(name, 'grupo_edad|grupo_etario') THEN 'agrupa_edad_persona'
          WHEN regexp_full_match(name, 'cantidad|nro_casos') THEN 'cantidad' ELSE name END AS standard, count(*) AS n
        FROM k GROUP BY ALL""",
)
def synonym_map(spark, folder):
    names = _orders(spark, folder, name=SYNONYM_NAMES).select(text.column_key(F.col("name")).alias("name"))
    return counts(names.select(text.first_full_match(F.col("name"), fixed.COLUMN_SYNONYMS).alias("standard")), "standard")


@query(
    "rename_columns",
    "SELECT o_orderstatus AS genero, count(*) AS cantidad, sum(CAST(o_custkey AS BIGINT))::BIGINT AS codigo_dane FROM orders GROUP BY ALL",
)
def rename_columns(spark, folder):
    drifting = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("SEXO"), F.lit(1).alias("Nro  Casos"), F.col("o_custkey").alias("Cod_DANE"),
        F.col("o_orderpriority").alias("Género"),
    )
    named = conform.rename_by_pattern(drifting, fixed.COLUMN_SYNONYMS)
    grouped = named.groupBy("genero").agg(
        F.sum("cantidad").alias("casos"), F.sum("codigo_dane").alias("codigo_dane")
    )
    return conform.rename_exact(grouped, {"casos": "cantidad"})


CONFORM_SCHEMA = StructType(
    [
        StructField("o_orderkey", LongType()),
        StructField("codigo_dane", IntegerType()),
        StructField("gender", StringType()),
        StructField("amount", DoubleType()),
    ]
)


@query(
    "conform_schema",
    f"""SELECT o_orderkey, CAST(NULL AS INTEGER) AS codigo_dane, o_orderstatus AS gender,
        TRY_CAST(trim({DIRTY_NUMBER}) AS DOUBLE) AS amount FROM orders""",
)
def conform_schema(spark, folder):
    dirty = _orders(spark, folder, amount=DIRTY_NUMBER).withColumnRenamed("o_orderstatus", "gender")
    return conform.conform_schema(dirty, CONFORM_SCHEMA)


@query("keep_known_columns", "SELECT o_orderstatus, o_orderpriority, o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def keep_known_columns(spark, folder):
    return conform.keep_known(table(spark, folder, "orders"), ["o_orderstatus", "absent", "o_orderpriority"], rest=True)


@query(
    "drop_empty_cols",
    "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE ' ' END AS genero, 'X' AS \"DELITO\" FROM orders",
)
def drop_empty_cols(spark, folder):
    noisy = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE ' ' END").alias("genero"),
        F.lit("   ").alias("arma_medio"),
        F.lit(None).cast("string").alias("municipio"),
        F.col("o_orderpriority").alias("unnamed_3"),
        F.lit("y").alias("delitos"),
        F.lit("X").alias("DELITO"),
    )
    return conform.drop_empty_columns(noisy)


@query(
    "year_from_source",
    f"""SELECT year, count(*) AS n FROM (SELECT CAST(CASE o_orderkey % 3 WHEN 0 THEN 2000 + o_orderkey % 25 WHEN 1 THEN 2018
        ELSE year(o_orderdate) END AS INTEGER) AS year FROM orders) GROUP BY year""",
)
def year_from_source(spark, folder):
    named = _orders(spark, folder, source=SOURCE_NAME)
    return counts(named.select(values.year_of_source(F.col("source"), F.col("o_orderdate")).alias("year")), "year")


BLANKS = "CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END"


@query(
    "dropna_all",
    f"""SELECT a, b FROM (SELECT CASE WHEN trim(a) <> '' THEN a END AS a, CASE WHEN trim(b) <> '' THEN b END AS b
        FROM (SELECT {BLANKS} AS a, {DIRTY_GENDER} AS b FROM orders)) WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def dropna_all(spark, folder):
    rows = _orders(spark, folder, a=BLANKS, b=DIRTY_GENDER).select("a", "b")
    return conform.blank_to_null(conform.drop_blank_rows(rows))


@query(
    "dropna_subset",
    f"""SELECT a, b, o_orderkey FROM (SELECT {BLANKS} AS a, {DIRTY_GENDER} AS b, o_orderkey FROM orders)
        WHERE trim(a) <> '' AND trim(b) <> ''""",
)
def dropna_subset(spark, folder):
    rows = _orders(spark, folder, a=BLANKS, b=DIRTY_GENDER).select("a", "b", "o_orderkey")
    return conform.drop_blank_rows(rows, ["a", "b"], how="any")


JUNK_TEXT = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'Total general' WHEN 1 THEN 'fuente: siedco' WHEN 2 THEN 'AGRUPACIÓN REFERENTE' "
    "WHEN 3 THEN NULL ELSE o_orderpriority END"
)


@query(
    "junk_regex",
    f"""SELECT department, o_orderkey FROM (SELECT {JUNK_TEXT} AS department, o_orderkey FROM orders)
        WHERE department IS NULL OR NOT regexp_matches(lower(department), 'total|fuente|elaborado|agrupación referente')""",
)
def junk_regex(spark, folder):
    rows = _orders(spark, folder, department=JUNK_TEXT).select("department", "o_orderkey")
    return filters.without_pattern(rows, ["department", "weapon"], fixed.JUNK_ROW)


@query(
    "junk_values",
    f"""SELECT place, count(*) AS n FROM (SELECT {DIRTY_PLACE} AS place FROM orders)
        WHERE place IS NULL OR place NOT IN ('NAN', 'Cúcuta') GROUP BY place""",
)
def junk_values(spark, folder):
    rows = _orders(spark, folder, place=DIRTY_PLACE)
    return filters.without_values(rows, "place", ["NAN", "Cúcuta"]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("filter_basic", WITH_RECORDS + " SELECT record_id, year, amount FROM records WHERE offence = '1-URGENT' AND year BETWEEN 1996 AND 1999 AND gender LIKE '%F%'")
def filter_basic(spark, folder):
    rows = model.records(spark, folder)
    wanted = (F.col("offence") == "1-URGENT") & F.col("year").between(1996, 1999) & F.contains(F.col("gender"), F.lit("F"))
    return rows.filter(wanted).select("record_id", "year", "amount")


@query("null_rows", f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, {BLANKS} AS a FROM orders) WHERE a IS NULL")
def null_rows(spark, folder):
    return filters.null_rows(_orders(spark, folder, a=BLANKS), "a", ["o_orderkey", "o_orderpriority"])


SWAP_DEPARTMENT = "CASE WHEN o_orderkey % 4 = 0 THEN 'Arma de Fuego' WHEN o_orderkey % 4 = 1 THEN 'ARMA BLANCA' ELSE 'Boyacá' END"
SWAP_WEAPON = "CASE WHEN o_orderkey % 8 = 0 THEN 'Nariño' WHEN o_orderkey % 4 = 2 THEN 'CONTUNDENTES' ELSE 'VALLE' END"


@query(
    "swap_columns",
    f"""SELECT CASE WHEN o_orderkey % 8 = 0 THEN w ELSE d END AS department, CASE WHEN o_orderkey % 8 = 0 THEN d ELSE w END AS weapon,
        count(*) AS n FROM (SELECT o_orderkey, {SWAP_DEPARTMENT} AS d, {SWAP_WEAPON} AS w FROM orders) GROUP BY ALL""",
)
def swap_columns(spark, folder):
    rows = _orders(spark, folder, department=SWAP_DEPARTMENT, weapon=SWAP_WEAPON)
    wrong = places.looks_like_weapon(F.col("department")) & places.is_department(F.col("weapon"))
    return counts(conform.swap_where(rows, "department", "weapon", wrong), "department", "weapon")


@query("swap_all", "SELECT o_orderpriority AS o_orderstatus, o_orderstatus AS o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def swap_all(spark, folder):
    return counts(conform.swap_columns(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


@query(
    "cond_update",
    WITH_FACT
    + """ SELECT CASE WHEN municipality LIKE '%NATION_7%' THEN 'MOVED' ELSE department END AS department, municipality,
        count(*) AS n FROM fact GROUP BY ALL""",
)
def cond_update(spark, folder):
    rows = model.fact(spark, folder)
    moved = conform.set_where(rows, "department", F.contains(F.col("municipality"), F.lit("NATION_7")), F.lit("MOVED"))
    return counts(moved, "department", "municipality")


REPLACED = {"1-URGENT": "2-HIGH", "2-HIGH": "HIGH", "5-LOW": "LOW"}


@query(
    "dict_replace",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW'
       ELSE o_orderpriority END AS offence, count(*) AS n FROM orders GROUP BY ALL""",
)
def dict_replace(spark, folder):
    rows = model.records(spark, folder)
    return counts(rows.select(values.replace_values(F.col("offence"), REPLACED).alias("offence")), "offence")


@query(
    "list_replace",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DESCONOCIDO' ELSE o_orderpriority END AS offence,
       count(*) AS n FROM orders GROUP BY ALL""",
)
def list_replace(spark, folder):
    rows = model.records(spark, folder)
    unknown = values.replace_all_with(F.col("offence"), ["1-URGENT", "2-HIGH"], fixed.UNKNOWN_PLACE)
    return counts(rows.select(unknown.alias("offence")), "offence")


@query(
    "filter_bundle",
    WITH_FACT
    + """ SELECT record_id, year, department, offence FROM fact WHERE year IN (1996, 1998) AND department IN ('ASIA', 'EUROPE')
        AND weapon IN ('BUILDING', 'MACHINERY')""",
)
def filter_bundle(spark, folder):
    chosen = {
        "year": [1996, 1998], "department": ["ASIA", "EUROPE"], "offence": [], "weapon": ["BUILDING", "MACHINERY"], "gender": None,
    }
    return model.fact(spark, folder).filter(filters.selection(chosen, strict=["department"])).select(
        "record_id", "year", "department", "offence"
    )


YEAR_TEXT = "CASE WHEN o_orderkey % 6 = 0 THEN 'NO REPORTADO' WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR(4)) END"


@query("year_clean", f"SELECT TRY_CAST(y AS INTEGER) AS year, count(*) AS n FROM (SELECT {YEAR_TEXT} AS y FROM orders) WHERE TRY_CAST(y AS INTEGER) IS NOT NULL GROUP BY ALL")
def year_clean(spark, folder):
    return counts(_orders(spark, folder, y=YEAR_TEXT).select(values.clean_year(F.col("y")).alias("year")), "year")


@query("distinct_sorted", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY 1 LIMIT 10")
def distinct_sorted(spark, folder):
    return filters.distinct_values(table(spark, folder, "part"), "p_brand", 10)


@query(
    "text_key",
    r"""SELECT doc_id, md5(k) AS key_md5, CAST(length(k) AS INTEGER) AS key_length FROM (SELECT doc_id, trim(regexp_replace(
        strip_accents(upper(replace(text, 'ß', 'ss'))), '\s+', ' ', 'g')) AS k FROM documents)""",
)
def text_key(spark, folder):
    keyed = table(spark, folder, "documents").select("doc_id", text.text_key(F.col("text")).alias("k"))
    return keyed.select("doc_id", F.md5("k").alias("key_md5"), F.length("k").alias("key_length"))


@query(
    "text_key_words",
    f"""SELECT department_key, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(strip_accents(upper(coalesce(
        {DIRTY_DEPARTMENT}, ''))), '[^A-Z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS department_key FROM orders) GROUP BY ALL""",
)
def text_key_words(spark, folder):
    rows = _orders(spark, folder, department=DIRTY_DEPARTMENT)
    return counts(rows.select(text.text_key_words(F.col("department")).alias("department_key")), "department_key")


@query(
    "text_columns",
    """SELECT upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type, p_size, p_partkey FROM part""",
)
def text_columns(spark, folder):
    rows = table(spark, folder, "part").select("p_name", "p_brand", "p_type", "p_size", "p_partkey")
    return conform.on_text(rows, text.text_key)


@query(
    "place_clean",
    f"""SELECT place, letters, count(*) AS n FROM (SELECT
        CASE o_orderkey % 6 WHEN 0 THEN 'BOGOTA D.C.' WHEN 1 THEN 'CUCUTA' WHEN 4 THEN 'NARINO 2' WHEN 5 THEN 'SAN JOSE' END AS place,
        CASE o_orderkey % 6 WHEN 0 THEN 'BOGOTA DC' WHEN 1 THEN 'CUCUTA' WHEN 4 THEN 'NARINO' WHEN 5 THEN 'SAN JOSE' END AS letters
        FROM orders) GROUP BY ALL""",
)
def place_clean(spark, folder):
    place = F.col("place")
    rows = _orders(spark, folder, place=DIRTY_PLACE).select(
        text.place_clean(place).alias("place"), text.place_clean(place, letters_only=True).alias("letters")
    )
    return rows.groupBy("place", "letters").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canon_lookup",
    f"""SELECT CASE o_orderkey % 8 WHEN 0 THEN 'ATLÁNTICO' WHEN 1 THEN 'BOGOTÁ D.C.' WHEN 2 THEN 'VALLE DEL CAUCA'
        WHEN 3 THEN 'NARIÑO' WHEN 4 THEN 'SAN ANDRÉS' WHEN 7 THEN 'LA GUAJIRA' ELSE {DIRTY_DEPARTMENT} END AS department,
        count(*) AS n FROM orders GROUP BY 1""",
)
def canon_lookup(spark, folder):
    rows = _orders(spark, folder, raw=DIRTY_DEPARTMENT).select(places.official_department(F.col("raw")).alias("department"))
    return rows.groupBy("department").agg(F.count(F.lit(1)).alias("n"))


DATE_TEXT = (
    "CASE o_orderkey % 7 WHEN 0 THEN {compact} WHEN 1 THEN {iso} WHEN 2 THEN {day_first} "
    "WHEN 3 THEN '31/02/2020' WHEN 4 THEN 'sin fecha' WHEN 5 THEN NULL ELSE concat({compact}, '.0') END"
)


@query(
    "parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2, 6) THEN CAST(o_orderdate AS DATE) END AS event_date FROM orders""",
)
def parse_date(spark, folder):
    written = DATE_TEXT.format(
        compact="date_format(o_orderdate, 'yyyyMMdd')",
        iso="date_format(o_orderdate, 'yyyy-MM-dd')",
        day_first="date_format(o_orderdate, 'dd/MM/yyyy')",
    )
    return _orders(spark, folder, d=written).select("o_orderkey", values.parse_date(F.col("d")).alias("event_date"))


@query("to_numeric", f"SELECT o_orderkey, TRY_CAST(trim({DIRTY_NUMBER}) AS DOUBLE) AS cantidad FROM orders")
def to_numeric(spark, folder):
    return _orders(spark, folder, x=DIRTY_NUMBER).select("o_orderkey", values.to_number(F.col("x")).alias("cantidad"))


@query(
    "category_clean",
    f"""SELECT CASE WHEN g IS NULL OR g IN ('', '-', 'NO REPORTA', 'NO RESPORTADO') THEN 'NO REPORTADO' ELSE g END AS gender,
        count(*) AS n FROM (SELECT upper(trim({DIRTY_GENDER})) AS g FROM orders) GROUP BY ALL""",
)
def category_clean(spark, folder):
    cleaned = values.clean_category(F.col("g"), fixed.CATEGORY_SPELLINGS, blank="NO REPORTADO")
    return counts(_orders(spark, folder, g=DIRTY_GENDER).select(cleaned.alias("gender")), "gender")


@query(
    "code_compose",
    """SELECT s_suppkey, CASE WHEN length(place) > 3 THEN lpad(place, 5, '0')
        ELSE lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(place, 3, '0') END AS code
       FROM (SELECT *, CAST(s_suppkey % 2700 * 37 AS VARCHAR) AS place FROM supplier)""",
)
def code_compose(spark, folder):
    rows = table(spark, folder, "supplier").withColumn("place", F.col("s_suppkey") % 2700 * 37)
    return rows.select("s_suppkey", values.compose_code(F.col("s_nationkey"), F.col("place")).alias("code"))


@query(
    "row_text",
    "SELECT p_partkey, lower(concat_ws(' ', p_brand, p_name, coalesce(CAST(p_size AS VARCHAR), ''))) AS line FROM part",
)
def row_text(spark, folder):
    cells = F.array("p_brand", "p_name", F.col("p_size").cast("string"))
    return table(spark, folder, "part").select("p_partkey", text.row_text(cells).alias("line"))


@query(
    "regex_functions",
    r"""SELECT page_id, regexp_matches(url, '\d{3}') AS has_number, regexp_full_match(url, 'https?://[^?#]*') AS plain_url,
        CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS items FROM pages""",
)
def regex_functions(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        F.col("url").rlike(r"\d{3}").alias("has_number"),
        F.col("url").rlike(r"^(?:https?://[^?#]*)$").alias("plain_url"),
        F.size(F.regexp_extract_all("html", F.lit("(<li>)"), 1)).alias("items"),
    )


@query("truncate_label", "SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 10) || '...' ELSE c_name END AS label FROM customer")
def truncate_label(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", text.short_label(F.col("c_name"), 10).alias("label"))


@query(
    "display_text",
    """SELECT o_orderpriority AS offence, format('{:,}', n) || ' (' || printf('%.1f', n * 100.0 / t) || '%)' AS shown
       FROM (SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS t FROM orders GROUP BY 1)""",
)
def display_text(spark, folder):
    from recordloom.operators.frequency import total_of

    cells = counts(model.records(spark, folder), "offence")
    return cells.select("offence", values.count_label(F.col("n"), values.percent(F.col("n"), total_of(cells))).alias("shown"))
