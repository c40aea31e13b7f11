"""Landed files: settings, records over several lines, catalogue, quarantine, publication."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import fixed
from recordloom.plans import jobs
from recordloom.sources import files, grid, landing, publish, quarantine


@pytest.fixture
def splits(spark):
    """Sets how files are split; the session's settings come back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size, least=None):
        for n, value in zip(names, (size, size, least)):
            if value is not None:
                spark.conf.set(n, str(value))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value) if value is not None else spark.conf.unset(n)


def cells_of(spark, path, **options):
    rows = grid.read_grid(spark, str(path), **options).orderBy("file", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["cells"])
    return found


def random_sheet(seed: int, rows: int, separator: str) -> tuple[list[list[str]], str]:
    rng = random.Random(seed)
    pieces = ["a", "long word", 'x "quoted" y', "line\nbreak", f"one{separator}two", "", '"', 'end"', "\n", "ñ", '""', f'"{separator}\n"']
    table = [["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))).strip(" ") for _ in range(4)] for _ in range(rows)]
    table = [["r" + r[0], *r[1:]] for r in table]
    out = io.StringIO()
    csv.writer(out, delimiter=separator, lineterminator="\n").writerows(table)
    return table, out.getvalue()


@pytest.mark.parametrize(("size", "least"), [(300, None), (1000, 9), (1 << 20, 1)])
def test_records_over_lines_and_splits(tmp_path, spark, splits, size, least):
    want = {}
    for k, separator in enumerate((",", ";", "\t")):
        want[f"s{k}.csv"], written = random_sheet(k, 150, separator)
        (tmp_path / f"s{k}.csv").write_text(written, encoding="utf-8")
    splits(size, least)
    assert cells_of(spark, tmp_path) == want


def test_long_open_cell_over_many_splits(tmp_path, spark, splits):
    body = "\n".join(f"line {k}, with comma" for k in range(60))
    (tmp_path / "a.csv").write_text(f'h,i\n1,"{body}"\n2,x\n3,"y"\n')
    splits(100)
    assert cells_of(spark, tmp_path)["a.csv"] == [["h", "i"], ["1", body], ["2", "x"], ["3", "y"]]


def test_stray_quote_swallows_nothing(tmp_path, spark):
    lines = ["h,i", '1,"never closed'] + [f"{k},x" for k in range(50)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    found = cells_of(spark, tmp_path, most_lines=20)["a.csv"]
    assert len(found) == 52 and found[2:] == [[str(k), "x"] for k in range(50)]


def test_quote_inside_a_plain_cell_opens_nothing(tmp_path, spark):
    (tmp_path / "a.csv").write_text('a,5" tube\nb,6" tube\n"c ""d""",7\n')
    assert cells_of(spark, tmp_path)["a.csv"] == [["a", '5" tube'], ["b", '6" tube'], ['c "d"', "7"]]


def test_settings_of_each_file(tmp_path, spark):
    (tmp_path / "bom.csv").write_bytes("﻿Dpto\tMpio\nNariño\tLa Unión\n".encode())
    (tmp_path / "latin.csv").write_bytes("Dpto;Área\nNariño;1,5\nMeta;2,5\n".encode("latin-1"))
    (tmp_path / "plain.csv").write_bytes('Dpto,Mpio\n"a;b;c;d",Cali\n'.encode())
    (tmp_path / "one.csv").write_bytes(b"only\ncolumn\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    found = landing.file_settings(landing.raw_lines(spark, str(tmp_path))).collect()
    kinds = {r.file.rsplit("/", 1)[1]: (r.encoding, r.separator, r.lines, r.broken_lines) for r in found}
    assert kinds == {
        "bom.csv": ("UTF-8", "\t", 2, 0), "latin.csv": ("ISO-8859-1", ";", 3, 2), "plain.csv": ("UTF-8", ",", 2, 0), "one.csv": ("UTF-8", ",", 2, 0),
    }
    cells = cells_of(spark, tmp_path)
    assert cells["bom.csv"] == [["Dpto", "Mpio"], ["Nariño", "La Unión"]]
    assert cells["latin.csv"][:2] == [["Dpto", "Área"], ["Nariño", "1,5"]]
    assert cells["plain.csv"][1] == ["a;b;c;d", "Cali"]


def test_csv_of_several_kinds_with_corrupt_lines(tmp_path, spark):
    (tmp_path / "a.csv").write_bytes("n;m\n1;Nariño\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("﻿n,m\n2,Ñ\nx,Y\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path), spark.createDataFrame([], "n int, m string").schema, corrupt="line")
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "Nariño", None), (2, "Ñ", None), (None, "Y", "x,Y")]


def test_csv_with_byte_order_mark(tmp_path, spark):
    df = spark.createDataFrame([(1, "ñ")], "n int, m string")
    files.write_csv(df, str(tmp_path / "o"), mark=True)
    part = next((tmp_path / "o").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfn,m\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "o"), df.schema).collect()] == [(1, "ñ")]


def test_plan_of_a_catalogue(spark):
    listed = [
        ("a", "2020_v1", "https://h/A%20one.csv"), ("a", "2020_v2", "https://h/a%20two.csv"), ("a", "2021", "https://h/gone.csv"),
        ("a", "2022_v1", "https://h/old.csv"), ("a", "2022_v2", "https://h/notyet.csv"), ("b", "2020", "https://h/a%20two.csv"),
    ]
    catalogue = spark.createDataFrame(listed, "category string, edition string, url string")
    catalogue = catalogue.withColumn("year", F.substring("edition", 1, 4).cast("int"))
    landed = ["file:/x/a%20one.csv", "file:/x/a%20two.csv", "file:/y/A%20TWO.csv", "file:/x/old.csv", "file:/x/name=more.csv/part-00000-77.csv"]
    plan = files.plan_loads(catalogue, spark.createDataFrame([(f,) for f in landed], "file string")).collect()
    got = sorted((r["name"], r["category"] or "", r["edition"] or "", r["status"]) for r in plan)
    assert got == sorted([
        ("a one.csv", "a", "2020_v1", "doubled"), ("a two.csv", "a", "2020_v2", "planned"), ("a two.csv", "a", "2020_v2", "doubled"),
        ("a two.csv", "b", "2020", "doubled"), ("a two.csv", "b", "2020", "doubled"), ("gone.csv", "a", "2021", "missing"),
        ("old.csv", "a", "2022_v1", "planned"), ("notyet.csv", "a", "2022_v2", "missing"), ("more.csv", "", "", "extra"),
    ])


def test_unified_files_account_for_every_line(tmp_path, spark):
    (tmp_path / "h 2019.csv").write_text(
        "POLICIA\n\nDpto,Municipio,Arma Medio,Fecha Hecho,Cantidad\nMETA,Acacías,FUEGO,15.05.2019,3\n,,,,\nMETA,Granada,\"A\nB\",99,1\n"
        "Dpto,Municipio,Arma Medio,Fecha Hecho,Cantidad\nMETA,Granada,X,20190101,n\nMETA,Granada,X,20190101,2,more\n,,X,20190101,2\nTOTAL,,,,9\nnote\n"
    )
    (tmp_path / "extra.csv").write_text("Dpto,Municipio,Cantidad\nMETA,X,1\n")
    (tmp_path / "h2020.csv").write_text("nothing\nhere\n")
    catalogue = spark.createDataFrame([("hurto", {"2019": "u/h%202019.csv", "2020": "u/h2020.csv", "2021": "u/no.csv"})], "category string, urls map<string,string>")
    intake, report, plan = jobs.unify_files(spark, str(tmp_path), catalogue)
    assert [(r.municipio, r.arma_medio, r.cantidad, r.ANIO, r.DELITO) for r in intake.good.collect()] == [("Acacías", "FUEGO", 3.0, 2019, "HURTO")]
    assert intake.seen == {
        "rows": 7, "good": 1, "header again": 1, "cells beyond the header": 1, "no place": 2, "no quantity": 1, "no date": 1,
    }
    lines = {(r.file.rsplit("/", 1)[1], r.outcome): r.lines for r in report.collect() if r.lines}
    assert lines == {
        ("h%202019.csv", "title"): 2, ("h%202019.csv", "header"): 1, ("h%202019.csv", "blank"): 1, ("h%202019.csv", "footer"): 2, ("h%202019.csv", "good"): 1,
        **{("h%202019.csv", reason): 1 for reason in ("header again", "cells beyond the header", "no place", "no quantity", "no date")},
        ("h2020.csv", "header"): 1, ("h2020.csv", "no place"): 1,
    }
    assert {r["name"]: r.status for r in plan.collect()} == {"h 2019.csv": "planned", "h2020.csv": "planned", "no.csv": "missing", "extra.csv": "extra"}
    with pytest.raises(ValueError, match="nothing"):
        jobs.unify_files(spark, str(tmp_path), catalogue.filter("false"))


def test_quarantine_reconciles(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "")], "k int, v string")
    intake = quarantine.divide(rows, {"blank": F.col("v") == "", "two": F.col("k") == 2})
    assert sorted(map(tuple, intake.good.collect()), key=str) == [(1, "a"), (1, None)]
    assert {(r.k, r.v, r.reason) for r in intake.bad.collect()} == {(2, "b", "two"), (2, "", "blank")}
    assert intake.seen == {"rows": 4, "good": 2, "blank": 1, "two": 1}
    assert sorted(map(tuple, quarantine.reconcile(rows, intake, ["k"]).collect())) == [(1, 2, 2, 0, 0), (2, 2, 0, 2, 0)]
    nothing = quarantine.divide(rows.limit(0), {"blank": F.col("v") == ""})
    assert nothing.good.count() == nothing.bad.count() == 0 and nothing.seen["rows"] == 0


class Crash(Exception):
    pass


def crash():
    raise Crash


def test_publication_swaps_whole_parts(tmp_path, spark):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2018), (2, 2019), (3, 2019)], "n int, ANIO int")
    read = lambda number=None: sorted(map(tuple, publish.published(spark, folder, df.schema, "ANIO", number).collect()))
    assert read() == []
    assert publish.publish(df, folder, "ANIO") == 1
    again = spark.createDataFrame([(9, 2019)], "n int, ANIO int")
    with pytest.raises(Crash):
        publish.publish(again, folder, "ANIO", before_swap=crash)
    assert read() == [(1, 2018), (2, 2019), (3, 2019)]
    (tmp_path / "t" / "manifests" / "2").mkdir()  # a manifest that was never committed
    (tmp_path / "t" / "manifests" / "2" / "part-0.json").write_text("{}")
    assert read() == [(1, 2018), (2, 2019), (3, 2019)]
    assert publish.publish(again, folder, "ANIO") == 3
    assert read() == [(1, 2018), (9, 2019)] and read(1) == [(1, 2018), (2, 2019), (3, 2019)]
    assert publish.manifest(spark, folder)[0][2] == 1
    assert publish.forget(spark, folder, keep=2) == 1  # rows of the crash
    assert read(1) == [(1, 2018), (2, 2019), (3, 2019)]
    assert publish.forget(spark, folder, keep=1) == 1
    assert read() == [(1, 2018), (9, 2019)]
    with pytest.raises(ValueError, match="null"):
        publish.publish(spark.createDataFrame([(1, None)], "n int, ANIO int"), folder, "ANIO")


def test_an_overtaken_publication_changes_nothing(tmp_path, spark):
    folder = str(tmp_path / "t")
    row = lambda n: spark.createDataFrame([(n, 2018)], "n int, ANIO int")
    publish.publish(row(1), folder, "ANIO")
    with pytest.raises(RuntimeError, match="overtaken"):
        publish.publish(row(2), folder, "ANIO", before_swap=lambda: publish.publish(row(3), folder, "ANIO"))
    assert [r.n for r in publish.published(spark, folder, row(0).schema, "ANIO").collect()] == [3]


def test_cleaning_a_year_works_every_name_out_once(spark):
    raw = spark.createDataFrame(
        [("valle ", "cali (ct)", "x"), ("Boyacá", "Vehiculo", "x"), ("Boyacá", None, "x"), ("Atlantis", "Cali", "x"), ("META", "no registra ", "x"), ("Bogotá D.C.", "Bogotá", "x"),
         ("META", "MINISTERIO", "x"), ("Elaborado por", "y", "x")],
        "DEPARTAMENTO string, MUNICIPIO string, ARMA_MEDIO string",
    )
    done = jobs.clean_year(raw, F.lit("H"), F.lit(2020), fixed.JUNK_ROW_LONG, fixed.NOT_A_PLACE, official_only=True)
    assert sorted((r.DEPARTAMENTO, r.MUNICIPIO) for r in done.collect()) == [
        ("BOYACA", "DESCONOCIDO"), ("CUNDINAMARCA", "BOGOTA, D.C."), ("VALLE DEL CAUCA", "SANTIAGO DE CALI"),
    ]
    kept = jobs.clean_year(raw, F.lit("H"), F.lit(2020)).collect()
    assert ("ATLANTIS", "CALI") in {(r.DEPARTAMENTO, r.MUNICIPIO) for r in kept}
    plan = done.filter(F.col("MUNICIPIO") != "z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 12 and len(plan) < 60_000
