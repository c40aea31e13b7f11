"""The whole jobs a records office runs: unify sheets, clean a year, enrich with places and people."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.functions import fixed, places, text, values
from recordloom.operators import conform, filters, joins
from recordloom.operators.ranking import first_per_key
from recordloom.session import settle
from recordloom.sources import files, grid, publish, quarantine

PLACE = ["DEPARTAMENTO", "MUNICIPIO"]
PLACE_YEAR = [*PLACE, "ANIO"]


def unify_sheets(lines: DataFrame, category: Column, headers: DataFrame | None = None) -> DataFrame:
    """One standard table out of sheets with unknown headers, footers and column names.

    ``category`` is the offence as an expression of ``file``.  Rows whose department
    and weapon are exchanged are repaired; departments get their official spelling.
    """
    found = grid.header_by_words(lines) if headers is None else headers
    columns = [c for c in fixed.STANDARD_COLUMNS if c not in ("ANIO", "DELITO")]
    loaded = grid.records(lines, found, columns, fixed.COLUMN_SYNONYMS)
    return _standard(loaded.withColumns({"category": category, "year": values.year_of_source(F.col("file"))}))


def official_pair(department: Column, place: Column, irregular: Iterable[str] = ()) -> Column:
    """Department and place as the gazetteer writes them, corrected by pair, the capital last: a struct.

    Places listed as ``irregular`` become the unknown place; a null place stays null.
    Every step works on the result of the one before it, which is worked out once.
    """
    pair = lambda d, p: F.struct(d.alias("department"), p.alias("place"))

    def named(keys: Column) -> Column:
        own = values.replace_values(keys["department"], fixed.DEPARTMENT_TO_GAZETTEER)
        known = values.replace_all_with(keys["place"], irregular, fixed.UNKNOWN_PLACE) if irregular else keys["place"]
        return values.let(pair(own, known), corrected)

    def corrected(own: Column) -> Column:
        listed = conform.listed_pair(own["department"], own["place"], fixed.PLACE_PAIRS, ("department", "place"))
        return values.let(F.coalesce(listed, own), capital)

    def capital(done: Column) -> Column:
        return pair(places.capital_department(done["place"], done["department"]), places.capital_place(done["place"]))

    place_key = values.let(place, lambda p: F.when(p.isNotNull(), text.text_key(p)))
    return values.let(pair(text.text_key(department), place_key), named)


def to_gazetteer_names(df: DataFrame, department: str, place: str) -> DataFrame:
    """``df`` with department and place as the gazetteer writes them; a null place is empty."""
    named = df.withColumn("_pair", official_pair(F.col(department), F.coalesce(F.col(place), F.lit(""))))
    return named.withColumns({department: F.col("_pair.department"), place: F.col("_pair.place")}).drop("_pair")


def clean_year(
    df: DataFrame, offence: Column, year: Column, junk: str = fixed.JUNK_ROW, irregular: Iterable[str] = (), official_only: bool = False
) -> DataFrame:
    """A yearly sheet with known column names, cleaned row by row in one pass.

    ``irregular`` place names become the unknown place instead of being kept or
    dropped; ``official_only`` drops departments that the country does not have.
    Names are corrected and judged inside one generated array, so that no filter
    repeats the corrections.
    """
    known = conform.keep_known(conform.rename_exact(df, fixed.HEADER_RENAMES), fixed.SHEET_COLUMNS)
    rows = filters.without_pattern(conform.drop_blank_rows(known), [*PLACE, "ARMAS_MEDIOS"], junk)
    changes: Mapping[str, Column] = {
        "CODIGO_DANE": values.to_number(F.col("CODIGO_DANE"), "bigint"),
        "FECHA_HECHO": values.parse_date(F.col("FECHA_HECHO")),
        "GENERO": values.clean_category(F.col("GENERO"), fixed.CATEGORY_SPELLINGS),
        "AGRUPA_EDAD_PERSONA": values.clean_category(F.col("AGRUPA_EDAD_PERSONA"), fixed.CATEGORY_SPELLINGS, fixed.UNREPORTED[0]),
        "CANTIDAD": values.to_number(F.col("CANTIDAD"), "bigint"),
    }
    others = [changes.get(c, F.col(c)).alias(c) for c in rows.columns if c not in PLACE]
    unwanted = [*fixed.UNRECORDED, *fixed.UNREPORTED, *fixed.BLANK_PLACES]

    def wanted(pair: Column) -> Column:
        kept = pair["place"].isNotNull() & ~pair["place"].isin(unwanted) & ~pair["department"].isin(unwanted)
        return kept & places.is_gazetteer_department(pair["department"]) if official_only else kept

    pair = official_pair(F.col("DEPARTAMENTO"), text.place_clean(F.col("MUNICIPIO")), irregular)
    named = rows.select(*others, F.inline(F.filter(F.array(pair), wanted)).alias(*PLACE))
    return named.withColumns({"TIPO_DELITO": offence, "ANIO": year})


def prepare_gazetteer(raw: DataFrame, order: Column) -> DataFrame:
    """Gazetteer keyed like the records, one row per place."""
    named = to_gazetteer_names(raw.withColumnsRenamed({"dpto": "DEPARTAMENTO", "nom_mpio": "MUNICIPIO"}), *PLACE)
    return settle(first_per_key(named, PLACE, [order]))


def prepare_population(raw: DataFrame, first_year: int, last_year: int, containing: bool = False) -> DataFrame:
    """Whole-area population keyed like the records, one row per place and year.

    The area must be called total; ``containing`` takes every area whose name has that word.
    """
    area = F.upper(F.trim("AREA_GEOGRAFICA"))
    is_whole = F.contains(area, F.lit(fixed.WHOLE_AREA)) if containing else area == fixed.WHOLE_AREA
    whole = raw.filter(is_whole).withColumns(
        {"ANIO": values.clean_year(F.col("ANIO")), "POBLACION_TOTAL": values.to_number(F.col("TOTAL"), "bigint")}
    )
    wanted = whole.filter(F.col("ANIO").between(first_year, last_year)).dropna(subset=["POBLACION_TOTAL"])
    named = to_gazetteer_names(wanted.withColumnsRenamed({"DPNOM": "DEPARTAMENTO", "DPMP": "MUNICIPIO"}), *PLACE)
    kept = named.select(*PLACE_YEAR, "POBLACION_TOTAL")
    return settle(first_per_key(kept, PLACE_YEAR, [F.col("POBLACION_TOTAL")]))


def enrich(df: DataFrame, gazetteer: DataFrame, population: DataFrame, columns: list[str]) -> DataFrame:
    """Records with gazetteer ``columns``, population and their own rate; every record is kept, none is doubled."""
    joins.require_unique(gazetteer, PLACE)
    joins.require_unique(population, PLACE_YEAR)
    placed = joins.attach_same(df, gazetteer, PLACE, columns)
    peopled = joins.attach_same(placed, population, PLACE_YEAR, ["POBLACION_TOTAL"])
    return peopled.withColumn("TASA_DELITO_100K", values.rate_per_100k(F.col("CANTIDAD"), F.col("POBLACION_TOTAL")))


def consolidate(
    sheets: Mapping[int, DataFrame],
    offence: Column,
    gazetteer: DataFrame,
    population: DataFrame,
    columns: list[str],
    folder: str,
) -> StructType:
    """Clean the sheets of several years, stack and enrich them, and publish the years in ``folder``.

    A later call with some of the years replaces these and leaves the others as
    published; readers (:func:`consolidated`) see the old table until it is done.
    """
    years = [
        clean_year(sheet, offence, F.lit(int(year)), fixed.JUNK_ROW_LONG, fixed.NOT_A_PLACE, official_only=True)
        for year, sheet in sorted(sheets.items())
    ]
    done = enrich(conform.stack_by_name(years), gazetteer, population, columns)
    publish.publish(done, folder, "ANIO")
    return done.schema


def consolidated(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The published table of all years."""
    return publish.published(spark, folder, schema, "ANIO")


def unify_files(
    spark: SparkSession, path: str, catalogue: DataFrame
) -> tuple[quarantine.Intake, DataFrame, DataFrame]:
    """The standard table out of a folder of landed sheets and their catalogue.

    Returns the rows that can be used and those set aside, a report that accounts
    for every line of every file, and the plan of the load.  Only planned files are
    read; category and year come from the catalogue.
    """
    landed = files.landed_files(spark, path)
    plan = settle(files.plan_loads(files.source_list(catalogue), landed))
    planned = plan.filter(F.col("status") == "planned").select("file", "category", "year")
    listed = [r["path"] for r in landed.join(planned, "file", "left_semi").select("path").collect()]
    if not listed:
        raise ValueError(f"nothing that the catalogue plans has landed in {path}")
    lines = grid.read_grid(spark, listed)
    headers = grid.header_by_words(lines)
    columns = [c for c in fixed.STANDARD_COLUMNS if c not in ("ANIO", "DELITO")]
    kinds = settle(grid.line_kinds(lines, headers))
    raw = grid.raw_records(kinds, headers, columns, fixed.COLUMN_SYNONYMS)
    blank = lambda c: F.col(c).isNull()
    intake = quarantine.divide(
        raw,
        {
            "header again": F.col("_again"),
            "cells beyond the header": F.col("_beyond"),
            "no place": blank("departamento") & blank("municipio"),
            "no quantity": ~blank("cantidad") & values.to_number(F.col("cantidad")).isNull(),
            "no date": ~blank("fecha_hecho") & values.parse_date(F.col("fecha_hecho")).isNull(),
        },
    )
    report = grid.load_report(kinds, intake.bad)
    return quarantine.Intake(_standard(intake.good.join(planned, "file")), intake.bad, intake.seen), report, plan


def _standard(raw: DataFrame) -> DataFrame:
    """Accepted rows as the standard table, with places repaired, ``category`` and ``year`` of the file."""
    year = F.coalesce(F.col("year"), F.year(values.parse_date(F.col("fecha_hecho"))))
    typed = raw.withColumns({"cantidad": values.to_number(F.col("cantidad")), "ANIO": year, "DELITO": F.upper("category")})
    wrong = places.looks_like_weapon(F.col("departamento")) & places.is_department(F.col("arma_medio"))
    repaired = conform.swap_where(typed, "departamento", "arma_medio", wrong)
    named = repaired.withColumn("departamento", places.official_department(F.col("departamento")))
    return conform.keep_known(named, fixed.STANDARD_COLUMNS)
