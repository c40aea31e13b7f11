"""Operators on small frames: ties, nulls, empty input, hot keys and invariants."""

import difflib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import fixed, text
from recordloom.operators import clusters, conform, crosstab, cube, filters, frequency, joins, ranking, star, stats, summary, trends


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"k{rng.randint(0, 20)}", 5.0 if hot else float(rng.randint(0, 400)), rng.randint(0, 30)))
    df = spark.createDataFrame(rows, "id int, key string, x double, y int").repartition(6)
    return df.cache(), rows


@pytest.fixture
def many_slices(spark):
    """Keep range partitions apart so that totals really cross slices."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_running_total_crosses_slices(spark, many_slices, skewed):
    df, rows = skewed
    cells = ranking.value_cells(df, "x")
    got = {r["x"]: (r["cum"], r["total"]) for r in ranking.running_total(cells, "n", [F.col("x")]).collect()}
    xs = sorted(r[2] for r in rows)
    assert all(got[x] == (sum(v <= x for v in xs), len(xs)) for x in set(xs))


def test_quantiles_with_hot_group(spark, many_slices, skewed):
    df, rows = skewed
    got = {r["key"]: r for r in ranking.quantiles(df, ["x"], [0.25, 0.5, 0.95], ["key"]).collect()}
    for key in {r[1] for r in rows}:
        xs = [r[2] for r in rows if r[1] == key]
        assert [got[key][f"q{i}"] for i in range(3)] == pytest.approx([quantile(xs, p) for p in (0.25, 0.5, 0.95)])


def test_quantiles_match_the_single_task_aggregate(spark, skewed):
    df, _ = skewed
    want = df.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.9)))).first()[0]
    got = ranking.quantiles(df, ["x"], [0.1, 0.9]).first()
    assert [got["q0"], got["q1"]] == pytest.approx(want)


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3, 1, 3, 2, 3)], "v int")
    got = {r["v"]: r["avg_rank"] for r in ranking.average_ranks(ranking.value_cells(df, "v"), "v").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 4.0}


def test_top_n_ties_and_first_per_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "k string, n int")
    assert [r["k"] for r in ranking.top_n(df, 2, frequency.biggest_first("k")).collect()] == ["c", "a"]
    twice = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(r["v"] for r in ranking.first_per_key(twice, ["k"], [F.col("o")]).collect()) == ["y", "z"]


def test_swap_twice_is_identity(spark):
    rows = [("Arma blanca", "Nariño"), ("Boyacá", "CONTUNDENTES"), ("ARMA DE FUEGO", "otro"), (None, "META")]
    df = spark.createDataFrame(rows, "department string, weapon string")
    mask = text.text_key_words(F.col("department")).rlike(fixed.WEAPON_WORDS) & text.text_key_words(
        F.col("weapon")
    ).isin(list(fixed.DEPARTMENT_KEYS))
    once = conform.swap_where(df, "department", "weapon", mask).collect()
    assert [tuple(r) for r in once] == [("Nariño", "Arma blanca"), *rows[1:]]
    assert [tuple(r) for r in conform.swap_columns(conform.swap_columns(df, "department", "weapon"), "department", "weapon").collect()] == rows


def test_rename_by_pattern_keeps_first_duplicate(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Dpto", "DEPARTAMENTO", "Algo Más"])
    out = conform.rename_by_pattern(df, fixed.COLUMN_SYNONYMS)
    assert out.columns == ["departamento", "algo_mas"] and out.first()["departamento"] == 1


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([("a", " ", None, "u", "d")], "x string, y string, z string, unnamed_3 string, delito string")
    assert conform.drop_empty_columns(df).columns == ["x"]


def test_drop_blank_rows(spark):
    df = spark.createDataFrame([("a", None), (" ", None), (None, "b"), ("a", "b")], "x string, y string")
    assert conform.drop_blank_rows(df).count() == 3
    assert conform.drop_blank_rows(df, ["x", "y"], how="any").count() == 1


def test_union_counts_add_up(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", True), ("z", None)], "s string, f boolean")
    out = conform.stack_by_name([a, b])
    assert out.columns == ["n", "s", "f"] and out.count() == 3


def test_filters(spark):
    df = spark.createDataFrame([("TOTAL general", 1), ("fuente x", 2), (None, 3), ("META", 4)], "d string, n int")
    assert [r["n"] for r in filters.without_pattern(df, ["d"], fixed.JUNK_ROW).collect()] == [3, 4]
    assert [r["n"] for r in filters.without_values(df, "d", ["META"]).collect()] == [1, 2, 3]
    assert df.filter(filters.selection({"d": [], "n": None})).count() == 4
    assert df.filter(filters.selection({"d": []}, strict=["d"])).count() == 0
    assert df.filter(filters.selection({"n": [1, 4], "d": ["META"]})).count() == 1


def test_trim_on_empty_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (100.0,)], "x double")
    assert [r["x"] for r in filters.trim_above(df, {"x": 0.5}).collect()] == [1.0]
    assert filters.trim_above(df.filter("x > 1000"), {"x": 0.5}).count() == 0


def test_matched_plus_unmatched(spark):
    fact = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("B", "x")], "department string, municipality string")
    ref = spark.createDataFrame([("A", "x", 1), ("B", "z", 2)], "dpto string, nom_mpio string, code int")
    on = {"department": "dpto", "municipality": "nom_mpio"}
    joined = joins.attach(fact, ref, on, "match").groupBy("match").count().collect()
    assert {r["match"]: r["count"] for r in joined} == {"both": 1, "left_only": 3}
    assert [tuple(r) for r in joins.unmatched_keys(fact, ref, on).collect()] == [("A", "y"), ("B", "x")]


def test_composite_fix_leaves_homonyms_alone(spark):
    fact = spark.createDataFrame([("CESAR", "MANAURE"), ("LA GUAJIRA", "MANAURE")], "department string, municipality string")
    fixes = spark.createDataFrame([("CESAR", "MANAURE", "MANAURE BALCON DEL CESAR")], "department string, municipality string, fix string")
    out = joins.apply_corrections(fact, fixes, ["department", "municipality"], {"municipality": "fix"})
    assert sorted(r["municipality"] for r in out.collect()) == ["MANAURE", "MANAURE BALCON DEL CESAR"]


def test_lookup_last_wins(spark):
    ref = spark.createDataFrame([("x", "A", 1), ("x", "B", 2)], "m string, d string, o int")
    fact = spark.createDataFrame([("x", "?"), ("y", "?")], "m string, dep string")
    out = joins.lookup_last(fact, ref, "m", "d", [F.desc("o")], "dep")
    assert {r["m"]: r["dep"] for r in out.collect()} == {"x": "B", "y": "?"}


NAMES = ["SAN JOSE DE CUCUTA", "CUCUTA", "GUICAN", "LOPEZ DE MICAY", "PURISIMA", "CALI", "A", "MARIQUITA", "TOLU", "CHIVOLO"]


def _typos(seed):
    rng = random.Random(seed)
    out = set()
    for name in NAMES:
        for _ in range(12):
            letters = list(name)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(letters)) if letters else 0
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "A", "SE"])
            out.add("".join(letters))
    return sorted(n for n in out if n)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("method,cutoff", [("edit", 0.85), ("edit", 0.5), ("blocks", 0.85), ("blocks", 0.75), ("blocks", 0.4)])
def test_close_names_equals_brute_force(spark, method, cutoff):
    names = _typos(3)

    def score(a, b):
        if method == "edit":
            return 1.0 - _edits(a, b) / max(len(a), len(b))
        return difflib.SequenceMatcher(None, b, a).ratio()

    want = {}
    for a in names:
        best = min(((-score(a, b), b) for b in NAMES), default=None)
        if best and -best[0] >= cutoff:
            want[a] = best[1]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    ref = spark.createDataFrame([(n,) for n in NAMES], "r string")
    got = {r["name"]: r["match"] for r in joins.close_names(frame, ref, "n", "r", cutoff, method).collect()}
    assert got == want


def test_correct_names_only_touches_unmatched(spark):
    ref = spark.createDataFrame([("A", "CUCUTA"), ("A", "CALI")], "dpto string, nom string")
    fact = spark.createDataFrame([("A", "CUCUTTA"), ("A", "CALI"), ("A", "ZZZ")], "dep string, mun string")
    out = joins.correct_names(fact, ref, {"dep": "dpto", "mun": "nom"}, "mun")
    assert sorted(r["mun"] for r in out.collect()) == ["CALI", "CUCUTA", "ZZZ"]


def test_frequency_table_counts_null_rows_in_percent(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    rows = [tuple(r) for r in frequency.frequency_table(df, "k").orderBy("cum_pct").collect()]
    assert rows == [("a", 2, 50.0, 50.0), ("b", 1, 25.0, 75.0)]


def test_modes_and_extremes(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "k string, z string")
    got = {r["column"]: r for r in frequency.modes(df, ["k", "z"]).collect()}
    assert (got["k"]["mode"], got["k"]["mode_n"], got["k"]["distinct_values"]) == ("a", 1, 2)
    assert got["z"]["mode"] is None
    ends = frequency.extremes(frequency.counts(df, "k"), "k").first()
    assert (ends["max_value"], ends["min_value"]) == ("a", "a")


def test_crosstab_margins_add_up(spark, skewed):
    df, rows = skewed
    long = crosstab.crosstab_margins(df, "key", "y").collect()
    cells = [r["n"] for r in long if r["key"] != "All" and r["y"] != "All"]
    grand = [r["n"] for r in long if r["key"] == "All" and r["y"] == "All"]
    assert sum(cells) == grand[0] == len(rows)
    shares = crosstab.row_percent(frequency.tally(df, "key", "y"), "key", "y").groupBy("key").agg(F.sum("pct").alias("s"))
    assert all(r["s"] == pytest.approx(100.0) for r in shares.collect())


def test_crosstab_zero_fill_drops_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x"), ("a", None)], "r string, c string")
    got = {r["r"]: (r["x"], r["y"]) for r in crosstab.crosstab(df, "r", "c").collect()}
    assert got == {"a": (1, 0), "b": (0, 1)}


def test_top_lists(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbcd"], "k string")
    cells = frequency.tally(df, "k")
    assert {r["k"]: r["n"] for r in frequency.top_and_rest(cells, "k", 2).collect()} == {"a": 3, "b": 2, "OTROS": 2}
    share = frequency.top_share(cells, "k", 2).first()
    assert (share["top_n"], share["total"]) == (5, 7)


def test_histogram_edges_and_constant(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10, 10)], "x double")
    assert {r["bin"]: r["n"] for r in summary.histogram(df, "x", 5).collect()} == {0: 2, 2: 1, 4: 2}
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    only = summary.histogram(flat, "x", 4).first()
    assert (only["bin"], only["n"], only["bin_start"]) == (2, 4, 3.0)


def test_box_stats_without_outliers_in_whiskers(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)] + [("h", 7.0)], "g string, x double")
    got = {r["g"]: r for r in summary.box_stats(df, "g", "x", trim=None).collect()}
    assert (got["g"]["whisker_low"], got["g"]["whisker_high"], got["g"]["q2"]) == (1.0, 4.0, 3.0)
    assert got["h"]["whisker_low"] == got["h"]["whisker_high"] == 7.0


def test_describe_single_row_and_nulls(spark):
    df = spark.createDataFrame([(2.0, None)], "x double, z double")
    got = {r["column"]: r for r in summary.describe(df, ["x", "z"]).collect()}
    assert got["x"]["std"] is None and got["x"]["q50"] == 2.0
    assert got["z"]["count"] == 0 and got["z"]["q50"] is None and got["z"]["nulls"] == 1


def test_trends(spark):
    s = spark.createDataFrame([(2018, 10), (2020, 15), (2021, 0), (2022, 3)], "year int, n int")
    got = [r["change_pct"] for r in trends.change_on_previous(s, "year", "n").orderBy("year").collect()]
    assert got == [None, 50.0, -100.0, None]
    assert trends.first_to_last(s, "year", "n").first()["change_pct"] == -70.0
    assert trends.first_to_last(s.filter("year = 2018"), "year", "n").first()["change_pct"] == 0.0


def _tau(pairs):
    c = d = tx = ty = 0
    for (a, b), (x, y) in itertools.combinations(pairs, 2):
        s = (a - x) * (b - y)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a == x), ty + (b == y)
    n = len(pairs) * (len(pairs) - 1) / 2
    return (c - d) / math.sqrt((n - tx) * (n - ty))


def test_kendall_equals_brute_force(spark, many_slices):
    rng = random.Random(5)
    rows = [(rng.randint(0, 40), rng.random(), rng.choice([1, 1, 1, 2, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, c int")
    got = {(r["left_column"], r["right_column"]): r["corr"] for r in stats.kendall(df, ["a", "b", "c"]).collect()}
    for (i, left), (j, right) in itertools.combinations(enumerate("abc"), 2):
        pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert got[(left, right)] == pytest.approx(_tau(pairs), abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a int, b int")
    assert stats.kendall(df, ["a", "b"]).first()["corr"] is None
    assert stats.spearman(df, ["a", "b"]).first()["corr"] is None


def test_chi2_known_table(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], "r string, c string, n long")
    plain = stats.chi2_independence(cells, "r", "c", correction=False).first()
    assert plain["chi2"] == pytest.approx(18.726, abs=1e-3) and plain["dof"] == 1
    corrected = stats.chi2_independence(cells, "r", "c").first()
    n, (a, b, c, d) = 65, (10, 20, 30, 5)
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert corrected["chi2"] == pytest.approx(want)
    assert corrected["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)))


def test_chi2_agrees_with_the_ml_test(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    rng = random.Random(2)
    rows = [(float(rng.randint(0, 3)), float(rng.randint(0, 2))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    ml = ChiSquareTest.test(VectorAssembler(inputCols=["a"], outputCol="v").transform(df), "v", "b").first()
    got = stats.chi2_independence(frequency.counts(df, "a", "b"), "a", "b").first()
    assert got["chi2"] == pytest.approx(ml["statistics"][0]) and got["p_value"] == pytest.approx(ml["pValues"][0])


def test_group_tests_need_two_groups(spark):
    one = spark.createDataFrame([("g", 1.0), ("g", 2.0)], "g string, x double")
    assert stats.anova(one, "g", "x").count() == 0
    assert stats.kruskal(one, "g", "x").count() == 0


def test_star_keys_are_unique(spark):
    rows = [("a", None), (None, "a"), ("a", "a"), ("a", None)]
    df = spark.createDataFrame(rows, "d string, m string").withColumn("n", F.lit(1))
    fact, dims = star.build_star(df, {"place": ["d", "m"], "only": ["d"]}, ["n"])
    assert fact.count() == 4
    place = dims["place"]
    assert place.count() == place.select("place_key").distinct().count() == 3
    assert dims["only"].count() == 2
    assert fact.join(place, "place_key").count() == 4


@pytest.mark.parametrize("pair", [("", "a"), ("abcd", "dcba"), ("banana", "ananas"), ("medellin", "medelin"), ("ñandú", "nandu"), ("aa", "aaaa")])
def test_letters_bound_the_block_ratio(spark, pair):
    df = spark.createDataFrame([pair], "a string, b string")
    bound = df.select(joins.most_block_ratio(F.col("a"), F.col("b"))).first()[0]
    assert bound >= difflib.SequenceMatcher(None, *pair).ratio() - 1e-12
    both = sum(min(pair[0].count(c), pair[1].count(c)) for c in set(pair[0]))
    assert bound == pytest.approx(2 * both / (len(pair[0]) + len(pair[1])))


def test_doubled_reference_rows_are_refused(spark):
    ref = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "k string, v int")
    assert joins.require_unique(ref, ["k", "v"]).count() == 3
    with pytest.raises(ValueError, match="2 reference rows"):
        joins.require_unique(ref, ["k"])


def test_cube_answers_filters(spark):
    rows = [(k % 3 or None, k % 5, f"p{k % 700}") for k in range(6000)]
    df = spark.createDataFrame(rows, "a int, b int, person string")
    made = cube.filter_cube(df, ["a", "b"], ["person"])
    assert made.count() == 15
    for chosen in (F.lit(True), F.col("a") == 1, F.col("a").isNull() & (F.col("b") > 2), F.col("b") == 9):
        exact = df.filter(chosen).agg(F.count(F.lit(1)), F.count_distinct("person")).first()
        got = cube.answer(made, chosen, ["person"]).first()
        assert got["n"] == exact[0] and abs(got["distinct_person"] - exact[1]) <= 0.03 * exact[1]
    by = {r["b"]: r["n"] for r in cube.answer(made, F.lit(True), ["person"], ["b"]).collect()}
    assert by == {b: 1200 for b in range(5)}


def plain_clusters(points, k):
    near = lambda v, centres: min((round(sum((a - b) ** 2 for a, b in zip(v, c)), clusters.DIGITS), j) for j, c in enumerate(centres))
    names = sorted(points)
    centres = [points[names[0]]]
    while len(centres) < k:
        gap, name = min((-near(points[n], centres)[0], n) for n in names)
        if gap == 0:
            break
        centres.append(points[name])
    for _ in range(clusters.ROUNDS):
        own = {n: near(points[n], centres)[1] for n in names}
        moved = []
        for j, c in enumerate(centres):
            mine = [points[n] for n in names if own[n] == j]
            moved.append([round(sum(x) / len(mine), clusters.DIGITS) for x in zip(*mine)] if mine else c)
        if moved == centres:
            break
        centres = moved
    return {n: near(points[n], centres)[1] for n in names}


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(8)
    cells = [(f"p{p:02d}", f, rng.randint(0, 9) + (30 if f == p % 3 else 0)) for p in range(40) for f in range(4)] + [("zero", 0, 0), (None, 1, 5)]
    frame = spark.createDataFrame(cells, "place string, f int, n long")
    points = clusters.profiles(frame, "place", "f", [0, 1, 2, 3])
    got = [tuple(r) for r in clusters.clusters(points, "place", 3).orderBy("place").collect()]
    vectors = {r["place"]: r["vector"] for r in points.collect()}
    assert {n: c for n, c, _ in got} == plain_clusters(vectors, 3) and len(got) == 40
    assert got == [tuple(r) for r in clusters.clusters(points.repartition(7), "place", 3).orderBy("place").collect()]
    one = points.withColumn("vector", F.array(*[F.lit(0.25)] * 4))
    assert {r["cluster"] for r in clusters.clusters(one, "place", 3).collect()} == {0}
    assert clusters.clusters(points.filter("false"), "place", 3).collect() == []
