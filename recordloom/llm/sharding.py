"""Sharding by sampled splitters.

A size-weighted sample of the keys gives boundaries that cut the records into
ranges of about equal bytes; ranges that turn out overfull are cut again from a
sample of their own.  Exact sums per range then place every record.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import settle

#: Ranges per shard, sampled keys per range, and the multiple of the mean at which a range is overfull.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32
OVERFULL = 2
_LOW_BITS = 20


def shard_key(text: Column, doc_id: Column) -> Column:
    """A number that keeps equal texts next to each other and tells their documents apart."""
    high = F.shiftleft(F.shiftright(F.xxhash64(text), _LOW_BITS), _LOW_BITS)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("shard")), 64 - _LOW_BITS))


def _group(key: Column) -> Column:
    return F.shiftright(key, _LOW_BITS)


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> list[int]:
    """Keys that cut a weighted sample into ``parts`` of equal weight."""
    order = np.argsort(keys)
    sums = np.cumsum(weights[order])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
    return keys[order][at].tolist()


def _sample(rows: DataFrame, rate: Column, label: str) -> pd.DataFrame:
    """Keys drawn with a chance of size times ``rate``, the same ones in every run, with the bytes each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * rate)
    drawn = F.shiftrightunsigned(F.xxhash64("key", "doc_id", "size", F.lit(label)), 11) / F.lit(float(1 << 53))
    some = rows.withColumn("_chance", chance).filter(drawn < F.col("_chance"))
    found = some.select("key", F.col("size") / F.col("_chance"), *[c for c in ("range",) if c in rows.columns]).collect()
    return pd.DataFrame(found, columns=["key", "weight", "range"][: 3 if "range" in rows.columns else 2])


def _with_range(rows: DataFrame, boundaries: Sequence[int]) -> DataFrame:
    """Number of boundaries at or below the key, by binary search in a constant array."""
    cuts = F.split(F.lit(",".join(map(str, sorted(boundaries)))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(boundaries)).bit_length()))])

    def further(low: Column, step: Column) -> Column:
        return F.when(F.try_element_at(cuts, low + step) <= F.col("key"), low + step).otherwise(low)

    return rows.withColumn("range", F.aggregate(steps, F.lit(0), further) if boundaries else F.lit(0))


def balanced_shards(
    docs: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD,
    samples_per_range: int = SAMPLES_PER_RANGE,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every document, shards of near equal bytes.

    A size is the text's UTF-8 bytes plus 8; null texts have none and a null
    checksum.  Slots of a shard run from 0 without gaps.  Equal texts share a
    shard unless there are so many that they fill more than a range; such a group
    is cut by document, so it may hold any part of all rows.  No two shards differ
    by more than about two ranges, 1/32 of a shard, and the largest document.
    Repeated rows get slots of their own; an empty table gives an empty result.
    The driver sees the sample and one row per range, both bounded by parameters.
    """
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 8
    crc = F.crc32(docs[text].cast("binary")).cast("long")
    rows = settle(
        docs.select(docs[doc_id].alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), shard_key(docs[text], docs[doc_id]).alias("key"))
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n_ranges = shards * ranges_per_shard
    mean = total / n_ranges
    sample = _sample(rows, F.lit(samples_per_range / mean), "first")
    first = _quantiles(sample["key"].to_numpy(), sample["weight"].to_numpy(), n_ranges) if len(sample) else []
    # Boundaries stand before a whole group of equal texts.
    boundaries = {k >> _LOW_BITS << _LOW_BITS for k in first}
    step = 0
    while True:
        ranged = _with_range(rows, list(boundaries))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        sums = pd.DataFrame(sums.collect(), columns=["range", "bytes", "n", "least", "most"]).sort_values("range")
        over = sums[(sums["bytes"] > OVERFULL * mean) & (sums["least"] < sums["most"])]
        step += 1
        new = _subdivide(ranged, over, mean, samples_per_range, f"again {step}") - boundaries if len(over) else set()
        if not new:
            break
        boundaries |= new
    starts = sums.assign(
        _bytes=sums["bytes"].cumsum() - sums["bytes"], _rows=sums["n"].cumsum() - sums["n"]
    )[["range", "_bytes", "_rows"]]
    starts = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in starts.to_numpy()], "range int, _bytes long, _rows long")
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    placed = ranged.withColumn("_at", F.row_number().over(inside) - 1).withColumn("_cum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # A group starts where its first document does; all of it goes to that document's shard.
    placed = placed.withColumn("_cum", F.min("_cum").over(Window.partitionBy("range", _group(F.col("key")))))
    # One row per range, whose number the parameters bound.
    placed = placed.join(F.broadcast(starts), "range")
    shard = F.least(F.lit(shards - 1), F.floor((F.col("_bytes") + F.col("_cum")) * F.lit(shards / total)).cast("int"))
    numbered = settle(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_at")).alias("_row")))
    heads = numbered.groupBy("shard").agg(F.min("_row").alias("_head"))
    return numbered.join(F.broadcast(heads), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_head")).cast("long").alias("slot")
    )


def _subdivide(ranged: DataFrame, over: pd.DataFrame, mean: float, samples: int, label: str) -> set[int]:
    """New boundaries inside overfull ranges; inside one group of equal texts they fall between its documents."""
    inside = ranged.filter(F.col("range").isin([int(r) for r in over["range"]]))
    sample = _sample(inside, F.lit(samples / mean), label)
    new: set[int] = set()
    for number, bytes_, least, most in over[["range", "bytes", "least", "most"]].itertuples(index=False):
        mine = sample[sample["range"] == number]
        if len(mine):
            cuts = _quantiles(mine["key"].to_numpy(), mine["weight"].to_numpy(), 1 + int(bytes_ / mean))
            whole = {k >> _LOW_BITS << _LOW_BITS for k in cuts}
            new |= {k for k in whole if k > least} or {k for k in cuts if least < k <= most}
    return new
