"""Place profiles and their clustering, with DataFrame aggregates only.

Places are few beside the records, and a profile is as long as the list of
features; records are counted before the first round, and every round is one
aggregate over the settled profiles.  Results don't depend on the run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import settle

#: Decimals kept of centres, so that the order of additions doesn't show.
DIGITS = 10
ROUNDS = 50


def profiles(cells: DataFrame, place: str, feature: str, features: Sequence, n: str = "n") -> DataFrame:
    """``place`` and ``vector``: the shares of the listed features in the place's total; places without any are left out."""
    sums = [F.coalesce(F.sum(F.when(F.col(feature) == f, F.col(n))), F.lit(0)).cast("double") for f in features]
    summed = cells.filter(F.col(place).isNotNull()).groupBy(place).agg(F.array(*sums).alias("_counts"))
    total = F.aggregate("_counts", F.lit(0.0), lambda a, b: a + b)
    return settle(summed.filter(total > 0).select(place, F.transform("_counts", lambda c: c / total).alias("vector")))


def _distance(vector: Column, centre: Sequence[float]) -> Column:
    """Square of the distance, rounded like the centres."""
    gaps = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b))
    return F.round(F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b), DIGITS)


def _nearest(vector: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Distance to, and number of, the nearest centre; the smaller number of ties."""
    ranked = [F.struct(_distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]
    return F.array_min(F.array(*ranked))


def seeds(points: DataFrame, place: str, k: int) -> list[list[float]]:
    """At most ``k`` points far apart: that of the smallest name first, then always the one farthest from all chosen."""
    first = points.orderBy(place).select("vector").first()
    chosen = [first["vector"]] if first else []
    while chosen and len(chosen) < k:
        order = [F.desc("_gap"), F.col(place)]
        far = points.withColumn("_gap", _nearest(F.col("vector"), chosen)["distance"]).orderBy(*order).first()
        if far["_gap"] == 0:
            break
        chosen.append(far["vector"])
    return chosen


def clusters(points: DataFrame, place: str, k: int, rounds: int = ROUNDS) -> DataFrame:
    """``place``, ``cluster`` (numbered from 0 in the order of the seeds) and the squared ``distance`` to its centre.

    Centres move to the mean of their points until none moves, ``rounds`` times at
    most; a centre that loses all its points stays.  Fewer different points than
    ``k`` give fewer clusters; an empty frame gives an empty result.
    """
    centres = seeds(points, place, k)
    if not centres:
        return points.select(place, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    width = len(centres[0])
    for _ in range(rounds):
        near = points.select("vector", _nearest(F.col("vector"), centres)["cluster"].alias("cluster"))
        means = [F.round(F.avg(F.get("vector", F.lit(i))), DIGITS) for i in range(width)]
        found = {r["cluster"]: r["centre"] for r in near.groupBy("cluster").agg(F.array(*means).alias("centre")).collect()}
        moved = [found.get(j, c) for j, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return points.withColumn("_near", _nearest(F.col("vector"), centres)).select(place, F.col("_near.cluster").alias("cluster"), F.col("_near.distance").alias("distance"))
