"""The records, places and population that the queries run on, as views over the given tables.

Orders stand for offence records, their customer's nation and region for place and
department; order lines carry a count and an age group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import settle
from recordloom.sources.files import table

RECORDS_SQL = """records AS (
  SELECT o_orderkey AS record_id, o_custkey AS person_id, o_orderpriority AS offence, o_orderstatus AS gender,
         CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS amount, o_orderdate AS event_time
  FROM orders)"""
FACT_SQL = RECORDS_SQL + """, fact AS (
  SELECT records.*, r_name AS department, n_name AS municipality, c_mktsegment AS weapon
  FROM records JOIN customer ON c_custkey = person_id
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
LINES_SQL = """lines AS (
  SELECT l_orderkey AS record_id, l_returnflag AS age_group, l_linestatus AS status,
         CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax
  FROM lineitem)"""
PLACES_SQL = """places AS (
  SELECT r_name AS dpto, n_name AS nom_mpio, r_regionkey AS cod_dpto, n_nationkey AS cod_mpio,
         CAST(n_nationkey AS DOUBLE) / 2 AS latitude
  FROM nation JOIN region ON r_regionkey = n_regionkey)"""
POPULATION_SQL = """population AS (
  SELECT r_name AS department, n_name AS municipality, y.year AS year,
         people * 100 + y.year - (SELECT CAST(min(year(o_orderdate)) AS INTEGER) FROM orders) AS population
  FROM (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY c_nationkey) c
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) y)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Offence records without their place; one narrow scan."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderpriority").alias("offence"),
        F.col("o_orderstatus").alias("gender"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("event_time"),
    )


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Gazetteer of places; both tables are small files."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("dpto"),
        F.col("n_name").alias("nom_mpio"),
        F.col("r_regionkey").alias("cod_dpto"),
        F.col("n_nationkey").alias("cod_mpio"),
        (F.col("n_nationkey").cast("double") / 2).alias("latitude"),
    )


def fact(spark: SparkSession, folder: str) -> DataFrame:
    """Offence records with department, municipality and weapon."""
    people = table(spark, folder, "customer").join(
        places(spark, folder), F.col("c_nationkey") == F.col("cod_mpio")
    )
    base = records(spark, folder)
    return base.join(people, F.col("person_id") == F.col("c_custkey")).select(
        *base.columns,
        F.col("dpto").alias("department"),
        F.col("nom_mpio").alias("municipality"),
        F.col("c_mktsegment").alias("weapon"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Counted lines with their measures and age group."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        F.col("l_returnflag").alias("age_group"),
        F.col("l_linestatus").alias("status"),
        F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def population(spark: SparkSession, folder: str) -> DataFrame:
    """Inhabitants per place and year of the records, counted from the customers.

    One row per place and year; settled so that the planner knows it is small.
    """
    years = [r[0] for r in records(spark, folder).select("year").distinct().orderBy("year").collect()]
    people = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    return settle(
        people.join(places(spark, folder), F.col("c_nationkey") == F.col("cod_mpio")).select(
            F.col("dpto").alias("department"),
            F.col("nom_mpio").alias("municipality"),
            F.explode(F.array(*[F.lit(y) for y in years])).alias("year"),
            "people",
        ).select("department", "municipality", "year", (F.col("people") * 100 + F.col("year") - years[0]).alias("population"))
    )
