"""Sheets and files on disk."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import fixed
from recordloom.sources import files, grid

FIELDS = ("departamento", "municipio", "arma_medio", "genero", "cantidad")

WITH_TOTAL = """POLICIA NACIONAL
,,,

Hechos por municipio,,,
,,,
Dpto,Municipio,ARMA MEDIO,Sexo,Cantidad,Cantidad
Antioquia,Medellín,"ARMA, BLANCA",M,3,9
META,,FUEGO,F,1,9
TOTAL,,,,4,
BOYACA,TUNJA,FUEGO,F,1,1
Fuente: SIEDCO,,,,
"""
WITHOUT_TOTAL = """Departamento,Arma Medio,Genero
HUILA,FUEGO,F
,,
CESAR,BLANCA,M
Elaborado: alguien,,
CALDAS,X,Y
"""


@pytest.fixture
def sheets(tmp_path, spark):
    (tmp_path / "hurto_2019.csv").write_text(WITH_TOTAL, encoding="utf-8")
    (tmp_path / "hurto_2020.csv").write_text(WITHOUT_TOTAL, encoding="utf-8")
    return grid.read_grid(spark, str(tmp_path))


def short(df):
    return {r["file"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_header_by_words(sheets):
    found = short(grid.header_by_words(sheets))
    assert {name: r["row_idx"] for name, r in found.items()} == {"hurto_2019.csv": 5, "hurto_2020.csv": 0}


def test_header_by_targets_and_fallback(sheets):
    found = short(grid.header_by_targets(sheets, ["DPTO", "MUNICIPIO", "SEXO"], fallbacks=(1, 0)))
    assert {name: r["row_idx"] for name, r in found.items()} == {"hurto_2019.csv": 5, "hurto_2020.csv": 1}


def test_header_by_candidates(sheets):
    found = short(grid.header_by_candidates(sheets, (5, 0), fixed.SHEET_COLUMNS, fixed.HEADER_RENAMES, least=2))
    assert {name: r["row_idx"] for name, r in found.items()} == {"hurto_2019.csv": 5, "hurto_2020.csv": 0}
    none = grid.header_by_candidates(sheets, (1, 2), fixed.SHEET_COLUMNS, fixed.HEADER_RENAMES)
    assert none.count() == 0


def test_records_are_cut_and_conformed(sheets):
    loaded = grid.records(sheets, grid.header_by_words(sheets), FIELDS, fixed.COLUMN_SYNONYMS)
    rows = sorted(tuple(r)[1:] for r in loaded.collect())
    assert rows == [
        ("Antioquia", "Medellín", "ARMA, BLANCA", "M", "3"),
        ("CESAR", None, "BLANCA", "M", None),
        ("HUILA", None, "FUEGO", "F", None),
        ("META", None, "FUEGO", "F", "1"),
    ]


def test_audit_lists_sheets_without_header(sheets):
    headers = grid.header_by_candidates(sheets, (0,), fixed.SHEET_COLUMNS, fixed.HEADER_RENAMES, least=2)
    audit = short(grid.load_audit(sheets, headers, grid.records(sheets, headers, FIELDS, fixed.COLUMN_SYNONYMS)))
    assert (audit["hurto_2019.csv"]["status"], audit["hurto_2019.csv"]["rows"]) == ("no header", 0)
    assert (audit["hurto_2020.csv"]["status"], audit["hurto_2020.csv"]["rows"], audit["hurto_2020.csv"]["lines"]) == ("loaded", 2, 6)


def test_line_order_survives_split_files(tmp_path, spark):
    """A file read by several tasks keeps its line order and its footer cut."""
    lines = ["title", "Departamento,Arma Medio,Cantidad"] + [f"D{i},FUEGO,{i}" for i in range(20000)] + ["TOTAL,,1"] + ["X,Y,7"] * 500
    (tmp_path / "big.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        raw = grid.read_grid(spark, str(tmp_path))
        assert raw.select("pos.block").distinct().count() > 3
        loaded = grid.records(raw, grid.header_by_words(raw), ("departamento", "cantidad"), fixed.COLUMN_SYNONYMS)
        got = loaded.agg(F.count(F.lit(1)), F.sum(F.col("cantidad").cast("long"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert tuple(got) == (20000, sum(range(20000)))


def test_encoding_and_separator(tmp_path, spark):
    (tmp_path / "a.txt").write_bytes("n\tm\n1\tNariño\n".encode("latin-1"))
    df = files.read_csv(spark, str(tmp_path / "a.txt"), spark.createDataFrame([], "n int, m string").schema)
    assert tuple(df.first()) == (1, "Nariño")
    (tmp_path / "b.txt").write_text("n,m\nx,Ñ\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "b.txt"), df.schema)
    assert tuple(df.first()) == (None, "Ñ")


def test_partition_rewrite_touches_one_year(tmp_path, spark):
    df = spark.createDataFrame([(1, 2018), (2, 2019), (3, 2019)], "n int, year int")
    path = files.write_by(df, str(tmp_path / "t"), ["year"])
    files.write_by(spark.createDataFrame([(9, 2019)], "n int, year int"), path, ["year"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 2018), (9, 2019)]


def test_source_list(spark):
    catalogue = spark.createDataFrame([("a", {"2020_v1": "u", "2019": "w", "x": "z"})], "category string, urls map<string,string>")
    got = {r["edition"]: r["year"] for r in files.source_list(catalogue).collect()}
    assert got == {"2020_v1": 2020, "2019": 2019, "x": None}
