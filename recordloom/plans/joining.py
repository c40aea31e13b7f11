"""Queries for enrichment joins, audits, corrections, unions and key comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import fixed
from recordloom.functions.values import compose_code, rate_per_100k, replace_values
from recordloom.operators import filters, joins
from recordloom.operators.conform import replace_pairs, stack_by_name
from recordloom.operators.frequency import counts, counts_with_nulls, only_top
from recordloom.operators.ranking import first_per_key
from recordloom.plans import model
from recordloom.plans.registry import query
from recordloom.session import settle
from recordloom.sources.files import table

WITH_FACT = "WITH " + model.FACT_SQL
WITH_PLACES = WITH_FACT + ", " + model.PLACES_SQL
WITH_ALL = WITH_PLACES + ", " + model.POPULATION_SQL

ON_PLACE = {"department": "dpto", "municipality": "nom_mpio"}


def known_places(spark, folder):
    """Gazetteer with some places missing, so that unmatched keys exist."""
    return model.places(spark, folder).filter(F.col("cod_mpio") % 4 != 1)


@query(
    "left_join_indicator",
    WITH_PLACES
    + """ SELECT record_id, department, municipality, cod_mpio, latitude,
        CASE WHEN nom_mpio IS NULL THEN 'left_only' ELSE 'both' END AS match
        FROM fact LEFT JOIN (SELECT * FROM places WHERE cod_mpio % 4 <> 1) ON dpto = department AND nom_mpio = municipality""",
)
def left_join_indicator(spark, folder):
    joined = joins.attach(model.fact(spark, folder), known_places(spark, folder), ON_PLACE, "match")
    return joined.select("record_id", "department", "municipality", "cod_mpio", "latitude", "match")


@query(
    "left_join_year",
    WITH_ALL
    + """ SELECT record_id, fact.department, fact.municipality, fact.year, population FROM fact
        LEFT JOIN (SELECT * FROM population WHERE year <> 1998) p
        ON p.department = fact.department AND p.municipality = fact.municipality AND p.year = fact.year""",
)
def left_join_year(spark, folder):
    people = model.population(spark, folder).filter(F.col("year") != 1998)
    rows = model.fact(spark, folder).select("record_id", "department", "municipality", "year")
    return joins.attach_same(rows, people, ["department", "municipality", "year"], ["population"])


@query(
    "left_join_columns",
    WITH_PLACES + " SELECT record_id, municipality, latitude FROM fact LEFT JOIN places ON nom_mpio = municipality",
)
def left_join_columns(spark, folder):
    reference = model.places(spark, folder).withColumnRenamed("nom_mpio", "municipality")
    rows = model.fact(spark, folder).select("record_id", "municipality")
    return joins.attach_same(rows, reference, ["municipality"], ["latitude"])


@query(
    "anti_unmatched",
    WITH_PLACES
    + """ SELECT DISTINCT department, municipality FROM fact WHERE NOT EXISTS
        (SELECT 1 FROM places WHERE cod_mpio % 4 <> 1 AND dpto = department AND nom_mpio = municipality) ORDER BY 1, 2""",
)
def anti_unmatched(spark, folder):
    return joins.unmatched_keys(model.fact(spark, folder), known_places(spark, folder), ON_PLACE)


@query(
    "join_coalesce",
    WITH_FACT
    + """ SELECT department, CASE WHEN n_nationkey % 3 = 0 THEN 'FIXED ' || municipality ELSE municipality END AS municipality,
        count(*) AS n FROM fact JOIN nation ON n_name = municipality GROUP BY ALL""",
)
def join_coalesce(spark, folder):
    fixes = model.places(spark, folder).filter(F.col("cod_mpio") % 3 == 0).select(
        F.col("dpto").alias("department"), F.col("nom_mpio").alias("municipality"),
        F.concat(F.lit("FIXED "), "nom_mpio").alias("corrected"),
    )
    cells = counts(model.fact(spark, folder), "department", "municipality")
    return joins.apply_corrections(cells, fixes, ["department", "municipality"], {"municipality": "corrected"})


@query(
    "composite_remap",
    WITH_FACT
    + """ SELECT CASE WHEN department = 'ASIA' AND municipality = 'NATION_12' THEN 'EUROPE' ELSE department END AS department,
        CASE WHEN department = 'ASIA' AND municipality = 'NATION_12' THEN 'NATION_99' WHEN department = 'AFRICA' AND
        municipality = 'NATION_5' THEN 'NATION 5' ELSE municipality END AS municipality, count(*) AS n FROM fact GROUP BY 1, 2""",
)
def composite_remap(spark, folder):
    pairs = [("ASIA", "NATION_12", "EUROPE", "NATION_99"), ("AFRICA", "NATION_5", "AFRICA", "NATION 5")]
    cells = counts(model.fact(spark, folder), "department", "municipality")
    moved = replace_pairs(cells, "department", "municipality", [*pairs, *fixed.PLACE_PAIRS])
    return moved.groupBy("department", "municipality").agg(F.sum("n").alias("n"))


@query(
    "lookup_lastwins",
    """WITH d AS (SELECT p_name AS place, arg_max(p_brand, p_partkey) AS brand FROM part WHERE p_size > 10 GROUP BY p_name)
       SELECT p_partkey, p_name AS place, coalesce(d.brand, p_brand) AS brand FROM part LEFT JOIN d ON d.place = p_name""",
)
def lookup_lastwins(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("place"), F.col("p_brand").alias("brand"), "p_size")
    reference = parts.filter(F.col("p_size") > 10).toDF(*parts.columns)
    fixed_rows = joins.lookup_last(parts, reference, "place", "brand", [F.desc("p_partkey")], "brand")
    return fixed_rows.select("p_partkey", "place", "brand")


def _misspelt(spark, folder):
    """Names of customers and parts with a letter doubled, dropped or changed."""
    places = table(spark, folder, "part").select(
        F.expr(
            "CASE p_partkey % 5 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN substring(p_name, 2) "
            "WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN p_name ELSE concat(p_type, p_name) END"
        ).alias("place")
    )
    return places, table(spark, folder, "part").select(F.col("p_name").alias("known")).distinct()


MISSPELT_SQL = """WITH names AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN substring(p_name, 2)
    WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN p_name ELSE concat(p_type, p_name) END AS name FROM part),
  known AS (SELECT DISTINCT p_name AS match FROM part)"""


@query(
    "fuzzy_match",
    MISSPELT_SQL
    + """, scored AS (SELECT name, match, 1.0 - CAST(levenshtein(name, match) AS DOUBLE) / greatest(length(name), length(match)) AS score
        FROM names, known)
      SELECT name, match, round(score, 6) AS score FROM scored WHERE score >= 0.75
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, match) = 1""",
)
def fuzzy_match(spark, folder):
    names, known = _misspelt(spark, folder)
    found = joins.close_names(names, known, "place", "known", 0.75, "edit")
    return found.select("name", "match", F.round("score", 6).alias("score"))


@query("fuzzy_blocks")
def fuzzy_blocks(spark, folder):
    names, known = _misspelt(spark, folder)
    found = joins.close_names(names, known, "place", "known", 0.85, "blocks")
    return found.select("name", "match", F.round("score", 6).alias("score"))


SEGMENT_TEXT = (
    "CASE c_custkey % 5 WHEN 0 THEN substring(c_mktsegment, 1, length(c_mktsegment) - 1) WHEN 1 THEN concat(c_mktsegment, 's') "
    "WHEN 2 THEN concat('X', substring(c_mktsegment, 2)) WHEN 3 THEN 'unheard of' ELSE c_mktsegment END"
)


@query("corrected_names", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN 'unheard of' ELSE c_mktsegment END AS segment FROM customer")
def corrected_names(spark, folder):
    """Misspelt names take the closest known one, as told by matching blocks; unknown ones stay."""
    known = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("known")).distinct()
    misspelt = table(spark, folder, "customer").select("c_custkey", F.expr(SEGMENT_TEXT).alias("segment"))
    return joins.correct_names(misspelt, settle(known), {"segment": "known"}, "segment")


@query(
    "topn_semi",
    WITH_FACT
    + """ SELECT record_id, municipality FROM fact WHERE municipality IN
        (SELECT municipality FROM fact GROUP BY 1 ORDER BY count(*) DESC, municipality LIMIT 5)""",
)
def topn_semi(spark, folder):
    rows = model.fact(spark, folder).select("record_id", "municipality")
    return only_top(rows, counts(rows, "municipality"), "municipality", 5).select("record_id", "municipality")


@query(
    "whitelist_semi",
    WITH_PLACES + " SELECT record_id, municipality FROM fact WHERE municipality IN (SELECT nom_mpio FROM places WHERE cod_mpio % 2 = 0)",
)
def whitelist_semi(spark, folder):
    known = model.places(spark, folder).filter(F.col("cod_mpio") % 2 == 0).select(F.col("nom_mpio").alias("municipality"))
    rows = model.fact(spark, folder).select("record_id", "municipality")
    return filters.only_known(rows, known, ["municipality"]).select("record_id", "municipality")


@query(
    "drop_unofficial",
    WITH_PLACES
    + """ SELECT municipality, count(*) AS n FROM fact WHERE municipality NOT IN (SELECT nom_mpio FROM places WHERE cod_mpio % 5 = 2)
        GROUP BY ALL""",
)
def drop_unofficial(spark, folder):
    unofficial = model.places(spark, folder).filter(F.col("cod_mpio") % 5 == 2).select(F.col("nom_mpio").alias("municipality"))
    return counts(filters.without_known(model.fact(spark, folder), unofficial, ["municipality"]), "municipality")


UNRECORDED = "CASE o_orderkey % 6 WHEN 0 THEN 'NO REGISTRA' WHEN 1 THEN 'NO REPORTADO' WHEN 2 THEN '-' WHEN 3 THEN '' WHEN 4 THEN 'LA VICTORIA' ELSE o_orderpriority END"


@query(
    "drop_unrecorded",
    f"""SELECT place, count(*) AS n FROM (SELECT {UNRECORDED} AS place FROM orders)
        WHERE place NOT IN ('NO REGISTRA', 'NO REPORTADO', '-', '', 'LA VICTORIA', 'PUERTO SANTANDER', 'PUERTO COLOMBIA') GROUP BY ALL""",
)
def drop_unrecorded(spark, folder):
    rows = table(spark, folder, "orders").select(F.expr(UNRECORDED).alias("place"))
    for unwanted in (fixed.UNRECORDED, fixed.UNREPORTED, fixed.BLANK_PLACES, fixed.UNOFFICIAL_PLACES):
        rows = filters.without_values(rows, "place", unwanted)
    return counts(rows, "place")


@query(
    "union_by_name",
    WITH_FACT
    + """ SELECT gender, age_group, year, count(*) AS n FROM (
          SELECT gender, NULL AS age_group, year FROM fact UNION ALL
          SELECT NULL, l_returnflag, CAST(year(l_shipdate) AS INTEGER) FROM lineitem) GROUP BY ALL""",
)
def union_by_name(spark, folder):
    stacked = stack_by_name(
        [model.records(spark, folder).select("gender", "year"), model.lines(spark, folder).select("year", "age_group")]
    )
    return counts_with_nulls(stacked, "gender", "age_group", "year")


@query(
    "set_difference",
    """SELECT k AS nation, side FROM (
         SELECT DISTINCT s_nationkey AS k, 'left_only' AS side FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
         UNION ALL SELECT n_nationkey, 'right_only' FROM nation WHERE n_regionkey < 3 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))""",
)
def set_difference(spark, folder):
    mine = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("nation"))
    theirs = table(spark, folder, "nation").filter(F.col("n_regionkey") < 3).select(F.col("n_nationkey").alias("nation"))
    return joins.key_difference(mine, theirs, "nation")


@query("distinct_rows", WITH_FACT + " SELECT DISTINCT department, offence, gender FROM fact")
def distinct_rows(spark, folder):
    return model.fact(spark, folder).select("department", "offence", "gender").distinct()


@query(
    "dedupe_first",
    WITH_ALL
    + """ SELECT department, municipality, year, population FROM population""",
)
def dedupe_first(spark, folder):
    areas = F.explode(F.array(F.lit("TOTAL"), F.lit("CABECERA"), F.lit("RURAL"))).alias("area")
    people = model.population(spark, folder).select("*", areas).filter(F.col("area") == fixed.WHOLE_AREA)
    doubled = people.unionByName(people.withColumn("population", F.col("population") + 1))
    first = first_per_key(doubled, ["department", "municipality", "year"], [F.col("population")])
    return first.select("department", "municipality", "year", "population")


@query(
    "gazetteer_prepared",
    WITH_PLACES
    + """ SELECT CASE WHEN nom_mpio LIKE '%_24' THEN 'MIDDLE' ELSE dpto END AS department, upper(nom_mpio) AS municipality,
        lpad(CAST(cod_dpto AS VARCHAR), 2, '0') || lpad(CAST(cod_mpio AS VARCHAR), 3, '0') AS code FROM places""",
)
def gazetteer_prepared(spark, folder):
    raw = model.places(spark, folder)
    moved = F.when(F.endswith(F.col("nom_mpio"), F.lit("_24")), F.lit("MIDDLE")).otherwise(F.col("dpto"))
    return raw.select(
        replace_values(moved, fixed.DEPARTMENT_TO_GAZETTEER).alias("department"),
        F.upper("nom_mpio").alias("municipality"),
        compose_code(F.col("cod_dpto"), F.col("cod_mpio")).alias("code"),
    )


@query(
    "rate_100k",
    WITH_ALL
    + """ SELECT record_id, fact.year, round(amount / nullif(population, 0) * 100000, 4) AS rate FROM fact
        LEFT JOIN population p ON p.department = fact.department AND p.municipality = fact.municipality AND p.year = fact.year""",
)
def rate_100k(spark, folder):
    rows = model.fact(spark, folder).select("record_id", "department", "municipality", "year", "amount")
    joined = joins.attach_same(rows, model.population(spark, folder), ["department", "municipality", "year"], ["population"])
    return joined.select("record_id", "year", F.round(rate_per_100k(F.col("amount"), F.col("population")), 4).alias("rate"))


