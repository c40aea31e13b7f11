"""Enrichment with reference tables, audits of unmatched keys and name correction.

No join here forces a broadcast.  Reference tables read from files, or settled,
have a size the planner knows; it broadcasts the small ones and shuffles the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recordloom.functions.values import let
from recordloom.operators.ranking import first_per_key
from recordloom.session import settle


def attach(df: DataFrame, reference: DataFrame, on: Mapping[str, str], indicator: str | None = None) -> DataFrame:
    """Left join on differently named keys; ``indicator`` says which rows found a match."""
    other = reference.toDF(*reference.columns)
    same = [df[left] == other[right] for left, right in on.items()]
    joined = df.join(other, same, "left")
    if indicator:
        missing = other[next(iter(on.values()))].isNull()
        joined = joined.withColumn(indicator, F.when(missing, F.lit("left_only")).otherwise(F.lit("both")))
    return joined


def attach_same(df: DataFrame, reference: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join on equally named keys, taking only ``columns`` of the reference."""
    return df.join(reference.select(*on, *columns), list(on), "left")


def require_unique(reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``reference`` itself; raises if a key occurs twice, as a join would then double rows."""
    twice = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['_times']} reference rows for {tuple(twice[k] for k in keys)}")
    return reference


def unmatched_keys(df: DataFrame, reference: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Distinct keys of ``df`` that the reference lacks, sorted."""
    keys = df.select(*on).distinct()
    other = reference.toDF(*reference.columns)
    same = [keys[left] == other[right] for left, right in on.items()]
    return keys.join(other, same, "left_anti").orderBy(*on)


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys found on one side only, with the side named."""
    a, b = left.select(F.col(key)).distinct(), right.select(F.col(key)).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
    return only_a.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def apply_corrections(df: DataFrame, corrections: DataFrame, on: Sequence[str], fixes: Mapping[str, str]) -> DataFrame:
    """Left join corrections and take the corrected value where there is one.

    ``fixes`` maps a column of ``df`` to the correction column that replaces it.
    """
    names = {new: f"_fix_{new}" for new in fixes.values()}
    small = corrections.select(*on, *[F.col(n).alias(alias) for n, alias in names.items()])
    joined = df.join(small, list(on), "left")
    return joined.select(
        *[F.coalesce(F.col(names[fixes[c]]), F.col(c)).alias(c) if c in fixes else F.col(c) for c in df.columns]
    )


def lookup_last(df: DataFrame, reference: DataFrame, key: str, value: str, order_by: Sequence[Column], into: str) -> DataFrame:
    """Replace ``into`` by the reference value of ``key``; of duplicate keys the last one counts."""
    last = first_per_key(reference, [key], order_by).select(key, F.col(value).alias("_value"))
    return apply_corrections(df, last, [key], {into: "_value"})


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


@F.pandas_udf(DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")


def letter_bag(text: Column) -> Column:
    """The characters of a text, each with the number of its occurrence, so that bags meet as sets."""
    letters = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    numbered = lambda own: F.transform(own, lambda c, i: F.concat(c, (i - F.array_position(own, c)).cast("string")))
    return let(letters, numbered)


def most_block_ratio(a: Column, b: Column) -> Column:
    """Upper bound of the matching-block ratio: blocks can't hold more characters than both texts have in common."""
    common = F.size(F.array_intersect(letter_bag(a), letter_bag(b)))
    return 2.0 * common / (F.length(a) + F.length(b))


def _edit_budget(method: str, cutoff: float, a: Column, b: Column) -> Column:
    """Most edits two names of these lengths may differ by and still reach the cutoff."""
    base = F.greatest(a, b) if method == "edit" else a + b
    return F.floor(base * F.lit(1 - cutoff) + F.lit(1e-9)).cast("int")


def _length_range(method: str, cutoff: float, length: Column) -> tuple[Column, Column]:
    reach = cutoff if method == "edit" else cutoff / (2 - cutoff)
    low = F.greatest(F.lit(1), F.ceil(length * reach - 1e-9).cast("int"))
    return low, F.floor(length / reach + 1e-9).cast("int")


def close_names(names: DataFrame, reference: DataFrame, name: str, ref: str, cutoff: float, method: str = "edit") -> DataFrame:
    """For every name the closest reference name with similarity at or above ``cutoff``.

    ``method`` is ``edit`` (edit distance) or ``blocks`` (matching-block ratio).
    A pair within ``k`` edits shares, unchanged and hardly shifted, at least one
    of ``k + 1`` segments of the reference name (Li et al., Pass-Join, VLDB 2011),
    so candidates come from an equi-join on segments and none is missed.  Ties go
    to the alphabetically first reference name.  Names without a match are absent.
    """
    mine = names.select(F.col(name).alias("name")).filter(F.length("name") > 0).distinct()
    theirs = reference.select(F.col(ref).alias("match")).filter(F.length("match") > 0).distinct()

    def with_lengths(df: DataFrame, column: str, own: str, other: str) -> DataFrame:
        low, high = _length_range(method, cutoff, F.length(column))
        wide = df.select(column, F.length(column).alias(own), F.explode(F.sequence(low, high)).alias(other))
        budget = _edit_budget(method, cutoff, F.col(own), F.col(other))
        # A budget as long as the name leaves no segment to share: one empty segment covers that case.
        parts = F.when(budget + 1 > F.col("ref_len"), F.lit(1)).otherwise(budget + 1)
        wide = wide.withColumn("_k", budget).withColumn("_parts", parts)
        whole = F.col("_k") + 1 > F.col("ref_len")
        begin = F.floor(F.col("ref_len") * F.col("part") / F.col("_parts")).cast("int")
        end = F.floor(F.col("ref_len") * (F.col("part") + 1) / F.col("_parts")).cast("int")
        wide = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        return wide.withColumn("_begin", begin).withColumn("_size", F.when(whole, 0).otherwise(end - begin))

    segments = with_lengths(theirs, "match", "ref_len", "name_len").select(
        "match", "ref_len", "name_len", "part",
        F.substring(F.col("match"), F.col("_begin") + 1, F.col("_size")).alias("piece"),
    )
    probes = with_lengths(mine, "name", "name_len", "ref_len")
    first = F.greatest(F.lit(0), F.col("_begin") - F.col("_k"))
    last = F.least(F.col("name_len") - F.col("_size"), F.col("_begin") + F.col("_k"))
    probes = (
        probes.filter(first <= last)
        .withColumn("_at", F.explode(F.when(F.col("_size") == 0, F.array(F.lit(0))).otherwise(F.sequence(first, last))))
        .select(
            "name", "ref_len", "name_len", "part",
            F.substring(F.col("name"), F.col("_at") + 1, F.col("_size")).alias("piece"),
        )
        .distinct()
    )
    # Candidates beyond the budget fall away inside the join, before anything is shuffled again.
    budget = _edit_budget(method, cutoff, F.col("ref_len"), F.col("name_len"))
    near = F.call_function("levenshtein", F.col("name"), F.col("match"), budget) >= 0
    joined = probes.join(segments, ["ref_len", "name_len", "part", "piece"]).filter(near)
    pairs = joined.select("name", "match").distinct()
    if method == "blocks":  # few pairs reach Python
        pairs = pairs.filter(most_block_ratio(F.col("name"), F.col("match")) >= cutoff - 1e-9)
    score = edit_similarity(F.col("name"), F.col("match")) if method == "edit" else _block_ratio("name", "match")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= cutoff)
    best = F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), F.col("match")))
    return scored.groupBy("name").agg(best.alias("_best")).select("name", "_best.match", "_best.score")


def correct_names(df: DataFrame, reference: DataFrame, on: Mapping[str, str], column: str, cutoff: float = 0.85, method: str = "blocks") -> DataFrame:
    """Replace the names that fail to join by their closest reference name, if one is close enough."""
    lost = settle(unmatched_keys(df, reference, on))
    found = close_names(lost, reference, column, on[column], cutoff, method)
    fixes = lost.join(found.select(F.col("name").alias(column), "match"), column)
    return apply_corrections(df, fixes, list(on), {column: "match"})
