"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (columns ``a``, ``b``), as ``node`` and ``component``.

    Alternates large-star and small-star steps (Kiveris et al., *Connected
    Components in MapReduce and Beyond*, 2014): the number of rounds grows with
    the logarithm of the longest path.  Neighbours are never gathered in a list;
    a hub is a skewed join key, which adaptive execution splits.  Loops and
    repeated edges do no harm; without edges the result is empty.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(ordered)
    mark = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        now = settle(hung.unionByName(lowest.select("a", F.col("least").alias("b"))).distinct())
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
