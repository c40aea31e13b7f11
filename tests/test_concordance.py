"""Kendall's tau in slices, held against all pairs of rows."""

import math
import random

import pytest

from recordloom.operators import stats


def plain_tau(rows) -> float | None:
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(sign(x[0] - y[0]), sign(x[1] - y[1])) for k, x in enumerate(rows) for y in rows[:k]]
    of_a, of_b = sum(p[0] != 0 for p in pairs), sum(p[1] != 0 for p in pairs)
    return sum(a * b for a, b in pairs) / math.sqrt(of_a) / math.sqrt(of_b) if of_a and of_b else None


@pytest.mark.parametrize("wide", [3, 40, 10_000])
def test_tau_over_many_slices(spark, wide):
    rng = random.Random(wide)
    rows = [(g, float(rng.randrange(wide)), rng.randrange(6)) for g in ("x", "y", "z") for _ in range(150)]
    rows += [("y", 7.5, b) for b in range(60)]  # one value in several slices
    rows += [("one", 1.0, 2), ("same", 1.0, 2), ("same", 1.0, 3), (None, 1.0, 1), ("x", None, 1)]
    frame = spark.createDataFrame(rows, "g string, a double, b int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.corr for r in stats.kendall(frame, ["a", "b"], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("x", "y", "z", "one", "same"):
        want = plain_tau([(a, b) for of, a, b in rows if of == g and a is not None])
        assert got.pop(g) == (want if want is None else pytest.approx(want, abs=1e-12))
    assert not got


def test_cells_meet_once(spark):
    """The work per cell doesn't grow with the number of values."""
    rows = spark.range(20_000).selectExpr("(id * 7919) % 20011 AS a", "(id * 104729) % 997 AS b")
    seen = []
    before = stats.settle
    stats.settle = lambda df: seen.append(before(df)) or seen[-1]
    try:
        stats.kendall(rows, ["a", "b"]).collect()
    finally:
        stats.settle = before
    assert sum(f.count() for f in seen) <= 3 * 20_000
