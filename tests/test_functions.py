"""Scalar functions on hand-written values, dirty ones included."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from recordloom.functions import fixed, text, values
from recordloom.functions.pvalues import beta_part, chi2_tail, f_upper, gamma_tail


def results(spark, function, inputs):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", function(F.col("v")).alias("out"))
    return [r["out"] for r in df.orderBy("i").collect()]


def test_text_key(spark):
    dirty = ["  Bogotá,  D.C. ", "nariño", "Cúcuta\t\n x", None, "", "a  b", "straße", "Łódź æ"]
    clean = ["BOGOTA, D.C.", "NARINO", "CUCUTA X", "", "", "A B", "STRASSE", "LODZ AE"]
    assert results(spark, text.text_key, dirty) == clean


def test_text_key_words(spark):
    assert results(spark, text.text_key_words, ["Bogotá D.C.", None, "a--b_c"]) == ["BOGOTA D C", "", "A B_C"]


def test_place_clean(spark):
    assert results(spark, text.place_clean, ["Tunja (CT)", "nan", None, " Ñame 2 "]) == ["TUNJA", None, None, "NAME 2"]
    letters = results(spark, lambda c: text.place_clean(c, letters_only=True), ["Bogotá D.C.", "Cúcuta 1"])
    assert letters == ["BOGOTA DC", "CUCUTA"]


def test_column_names(spark):
    names = ["  ARMA  MEDIO ", "*AGRUPA EDAD PERSONA*", "Código/DANE", "Unnamed: 3"]
    expected = ["arma_medio", "agrupa_edad_persona", "codigo_dane", "unnamed_3"]
    assert text.column_keys(names) == expected
    assert results(spark, text.column_key, names) == expected
    assert results(spark, text.header_key, [" *Agrupa edad/persona* "]) == ["AGRUPA_EDAD_PERSONA"]


def test_synonyms_whole_name_first_pattern(spark):
    found = results(spark, lambda c: text.first_full_match(c, fixed.COLUMN_SYNONYMS), ["dpto", "municpio", "arma_empleada", "sexo", "total", "totales", None])
    assert found == ["departamento", "municipio", "arma_medio", "genero", "cantidad", "totales", None]


def test_dates(spark):
    written = ["20210515", "20210515.0", "2021-05-15", "15/05/2021", "31/02/2020", "texto", None, "", "2021"]
    day = datetime.date(2021, 5, 15)
    assert results(spark, values.parse_date, written) == [day, day, day, day, None, None, None, None, None]


def test_date_forms(spark):
    day = datetime.date(2021, 5, 3)
    forms = ["3/5/21", "03.05.2021", "2021-5-3", "2021/05/03 23:10:00.5", "3 de mayo de 2021", "3-MAY-2021", "03/05/2021 11:30 PM", "2021.5.3", "20210503 10:00"]
    assert results(spark, values.parse_date, forms) == [day] * len(forms)
    assert results(spark, values.parse_date, ["12/31/2020 11:30 PM", "15 jan 2021", "1/2/70", "1/2/68"]) == [
        datetime.date(2020, 12, 31), datetime.date(2021, 1, 15), datetime.date(1970, 2, 1), datetime.date(2068, 2, 1),
    ]
    assert results(spark, values.parse_date, ["31/31/2020", "2021-13-01", "3 xyz 2021", "1/2/345", "12:30", "99999999", "00/00/0000"]) == [None] * 7


def test_a_value_is_worked_out_once(spark):
    df = spark.range(3).select(values.let(F.col("id") + F.rand(3), lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("s"))
    assert all(r.s.a == r.s.b for r in df.collect())


def test_whole_numbers_with_a_point(spark):
    whole = lambda c: values.to_number(c, "bigint")
    assert results(spark, whole, ["3.0", " 4 ", "-5.00", "3.5", "3.", "x", ""]) == [3, 4, -5, None, 3, None, None]


def test_typographic_signs_and_spaces(spark):
    assert results(spark, text.text_key, ["O’Brien – “x”…", "a b c", "N° 5", "¿qué?"]) == ["O'BRIEN - \"X\"...", "A B C", "Ndeg 5", "?QUE?"]


def test_tails_at_large_degrees_of_freedom():
    for dof in (2e5, 2e7, 2e9):
        at = dof + 1.6448536269514722 * math.sqrt(2 * dof)
        assert gamma_tail(dof / 2, at / 2) == pytest.approx(0.05, abs=5e-4)
        assert 0.49 < gamma_tail(dof / 2, dof / 2) < 0.5
    assert f_upper(2.2231, 5, 1000) == pytest.approx(0.05, abs=1e-4)
    assert f_upper(2.2141, 5, 1e9) == pytest.approx(gamma_tail(2.5, 2.2141 * 2.5), rel=1e-4)
    assert f_upper(0.0, 5, 10) == 1.0 and f_upper(1e6, 5, 1000) < 1e-100


def test_year_of_source(spark):
    names = ["hurto_2018_2019.xlsx", "Hurto%20a%20personas2024_0.xlsx", "abigeato_6.xls", None]
    assert results(spark, lambda c: values.year_of_source(c), names) == [2019, 2024, None, None]


def test_numbers(spark):
    assert results(spark, values.to_number, [" 12 ", "1e2", "x", None, ""]) == [12.0, 100.0, None, None, None]
    assert results(spark, values.clean_year, ["2019", "NO REPORTADO", None]) == [2019, None, None]


def test_replacement_does_not_chain(spark):
    swapped = results(spark, lambda c: values.replace_values(c, {"A": "B", "B": "A"}), ["A", "B", "C", None])
    assert swapped == ["B", "A", "C", None]


def test_categories(spark):
    spelled = ["-", " no reporta ", "NO RESPORTADO", "adolsecentes", "  ", None, "Adultos"]
    found = results(spark, lambda c: values.clean_category(c, fixed.CATEGORY_SPELLINGS, "NO REPORTADO"), spelled)
    assert found == ["NO REPORTADO"] * 3 + ["ADOLESCENTES", "NO REPORTADO", "NO REPORTADO", "ADULTOS"]
    assert results(spark, lambda c: values.clean_category(c, fixed.CATEGORY_SPELLINGS), ["-", None]) == ["NO REPORTADO", None]


def test_codes(spark):
    df = spark.createDataFrame([(5, "1"), (5, "001"), (5, "05001"), (91, "405"), (5, "123456")], "d int, m string")
    assert [r[0] for r in df.select(values.compose_code(F.col("d"), F.col("m"))).collect()] == [
        "05001", "05001", "05001", "91405", "123456",
    ]


def test_rate_and_labels(spark):
    df = spark.createDataFrame([(5, 1000), (5, 0), (5, None)], "n int, p int")
    assert [r[0] for r in df.select(values.rate_per_100k(F.col("n"), F.col("p"))).collect()] == [500.0, None, None]
    assert results(spark, lambda c: text.short_label(c, 3), ["abc", "abcd", None]) == ["abc", "abc...", None]
    shown = df.select(values.count_label(F.lit(1234), F.lit(5.55))).first()[0]
    assert shown in ("1,234 (5.6%)", "1,234 (5.5%)")


def test_tails_have_known_values():
    assert gamma_tail(4, 5) == pytest.approx(math.exp(-5) * (1 + 5 + 12.5 + 125 / 6), rel=1e-12)
    assert gamma_tail(0.5, 1.92) == pytest.approx(math.erfc(math.sqrt(1.92)), rel=1e-12)
    assert beta_part(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-12)
    x, a = 0.9999, 30000
    assert beta_part(a, 2, x) == pytest.approx(x**a * (1 + a * (1 - x)), rel=1e-8)


def test_tail_column(spark):
    rows = spark.createDataFrame([(7.0, 2.0), (0.0, 3.0), (None, 2.0), (1.0, 0.0)], "x double, d double")
    out = [r[0] for r in rows.select(chi2_tail(F.col("x"), F.col("d"))).collect()]
    assert out[0] == pytest.approx(math.exp(-3.5)) and out[1] == 1.0 and out[2:] == [None, None]
