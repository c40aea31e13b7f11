"""Counts and distinct counts under any filter, from cells that are made once.

Distinct counts can't be added up, but sketches of them can be merged: each cell
keeps one per column, so that no filter needs the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import settle

#: Size of a sketch as a power of two; its standard error is about 0.8 percent.
PRECISION = 14


def filter_cube(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """One row per combination of the keys that occurs: ``n`` and a mergeable sketch ``_sketch_<column>`` per column.

    Sketches leave nulls out; the keys may be null.  Written once, its size follows
    the combinations and not the rows.
    """
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), precision).alias(f"_sketch_{c}") for c in distinct]
    return settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sketches))


def answer(cube: DataFrame, chosen: Column, distinct: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, the exact ``n`` and about how many distinct values (``distinct_<column>``) the rows under a filter on the keys have."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"_sketch_{c}")).alias(f"distinct_{c}") for c in distinct]
    found = cube.filter(chosen).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *merged)
    return found.withColumns({f"distinct_{c}": F.coalesce(f"distinct_{c}", F.lit(0)) for c in distinct})
