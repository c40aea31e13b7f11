"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target, the words the mix takes from it, and a schedule, its
density over training time.  The integral of the schedule is the cumulative token
demand; inverting it at the words a document stands behind in its source gives
the training position.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ranking import running_total
from recordloom.session import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Weights go round over the sources in order.
WEIGHTS = (1, 2, 3)
#: A target ends at so many times the words of its source; so does what is taken of a document.
MOST_REPEATS = 3
#: Density over training time by weight, as (time, density) knots joined by straight lines.
SCHEDULES: Mapping[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}
#: Documents that one task puts in order.
ROWS_PER_SLICE = 20_000


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``place`` and ``target`` from one row of ``source, source_size`` per source.

    Sources go by code point, null last.  A source's target is its weight times
    one common level, at most ``most`` times its size.  With the sources ordered
    by the level at which each is full, the level that shares out all words is
    the largest of those that treat the first so many as full.
    """
    placed = running_total(sizes.withColumn("_one", F.lit(1)), "_one", [F.col("source").isNull(), F.col("source")])
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("cum") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.select("source", "source_size", F.col("cum").alias("place"), cycle.cast("long").alias("weight"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * most).withColumn("_full", F.col("_cap") / F.col("weight"))
    order = [F.col("_full"), F.col("place")]
    by_cap = running_total(weighed, "_cap", order).withColumnsRenamed({"cum": "_caps", "total": "_all_caps"})
    by_weight = running_total(by_cap, "weight", order)
    level = (F.col("_all_caps") / most - (F.col("_caps") - F.col("_cap"))) / (F.col("total") - (F.col("cum") - F.col("weight")))
    settled = settle(by_weight.withColumn("_level", level))
    highest = settled.agg(F.max("_level")).first()[0] or 0.0
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(float(highest)))
    return settled.select("source", "source_size", "place", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def training_position(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a schedule's integral reaches ``share`` of its whole."""
    areas = [(t1 - t0) * (d0 + d1) / 2 for (t0, d0), (t1, d1) in zip(knots, knots[1:])]
    whole, done = sum(areas), 0.0
    out = F.lit(float(knots[-1][0]))
    pieces = []
    for ((t0, d0), (t1, d1)), area in zip(zip(knots, knots[1:]), areas):
        if area <= 0:
            continue
        need = share * whole - done
        slope = (d1 - d0) / (t1 - t0)
        # Smallest root of d0 x + slope x^2 / 2 = need, in the form that doesn't cancel.
        root = F.sqrt(F.greatest(F.lit(d0 * d0) + 2 * slope * need, F.lit(0.0)))
        x = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (d0 + root))
        pieces.append(((done + area) / whole, F.least(F.lit(float(t1)), F.lit(float(t0)) + x)))
        done += area
    for end, at in reversed(pieces):
        out = F.when(share <= end, at).otherwise(out)
    return out


def curriculum(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """One row per document: the ``keep`` columns, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    Within a source documents stand in a fixed random order (a hash of id and
    text), so reruns agree.  The mix goes round the source until its target,
    rounded to words, is met: ``copies`` lists for every turn that reaches the
    document its number, the words taken and the training position in 0 to 1;
    only the turn in which the demand ends takes a part of one document.  Null or
    empty texts have size 0 and no copies; null sources form one source.  Repeated
    rows stand one behind the other.  An empty table gives an empty result.

    Words are counted once and written with the ``keep`` columns; sums read the
    counts alone.  A source of any size is put in order in slices of about
    ``ROWS_PER_SLICE`` rows; one sum per slice says where the next begins.
    """
    hidden = {c: f"_k{i}" for i, c in enumerate(keep)}
    base = settle(
        docs.select(
            *[docs[c].alias(h) for c, h in hidden.items()],
            docs[source].alias("_source"),
            word_count(docs[text]).alias("size"),
            F.xxhash64(docs[keep[0]], docs[text]).alias("_order"),
        )
    )
    narrow = settle(base.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    slices = max(1, -(-(narrow.agg(F.sum("_rows")).first()[0] or 0) // ROWS_PER_SLICE))
    targets = source_targets(narrow.select(F.col("_source").alias("source"), "source_size"), weights, most)
    placed = base.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_slice", F.pmod("_order", F.lit(slices)))
    starts = placed.groupBy("place", "_slice").agg(F.sum("size").alias("_part"))
    earlier = Window.partitionBy("place").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("place", "_slice", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("place", "_slice").orderBy("_order", "size", *list(hidden.values())[:1])
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("_before", before).join(starts, ["place", "_slice"])
    demand = F.round("target").cast("long")
    first = F.col("_start") + F.col("_before")

    def turn(k: int) -> Column:
        begin = F.least(demand, first + k * F.col("source_size"))
        end = F.least(demand, first + k * F.col("source_size") + F.col("size"))
        share = (begin + end) / (2 * demand)
        at = F.lit(None).cast("double")
        for weight in set(weights):
            at = F.when(F.col("weight") == weight, training_position(share, schedules[weight])).otherwise(at)
        return F.struct(F.lit(k).alias("turn"), (end - begin).alias("words"), F.when(end > begin, at).alias("position"))

    copies = F.filter(F.array(*[turn(k) for k in range(most)]), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    done = ranked.withColumn("copies", copies).withColumn("taken", taken)
    return done.select(
        *[F.col(h).alias(c) for c, h in hidden.items()], "size", "source_size", "target", "taken", "copies"
    )


def in_training_order(rows: DataFrame, position: str = "position") -> DataFrame:
    """Rows spread and sorted by range of their position; those without one come first.

    Rows of one position, or of none, are spread by a hash of their first column.
    """
    spread = F.xxhash64(rows[rows.columns[0]])
    return rows.repartitionByRange(rows[position], spread).sortWithinPartitions(rows[position], spread)
