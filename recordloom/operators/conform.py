"""Bringing drifting tables to one schema."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from recordloom.functions.text import column_keys


def rename_exact(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that ``names`` lists; others keep their name."""
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def rename_by_pattern(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Normalise column names, then rename by the first pattern matching the whole name.

    Of several columns that end up with one name, the first is kept.
    """
    kept: dict[str, int] = {}
    for i, key in enumerate(column_keys(df.columns)):
        target = next((t for p, t in patterns.items() if re.fullmatch(p, key)), key)
        kept.setdefault(target, i)
    by_position = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"_{i}").alias(name) for name, i in kept.items()])


def conform_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``: absent ones as typed nulls, unreadable values as null."""
    out = []
    for field in schema:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType == field.dataType:
            out.append(F.col(field.name))
        else:
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def keep_known(df: DataFrame, order: Sequence[str], rest: bool = False) -> DataFrame:
    """Known columns that exist, in standard order; ``rest`` appends the others."""
    known = [c for c in order if c in df.columns]
    others = [c for c in df.columns if c not in known] if rest else []
    return df.select(*known, *others)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Whitespace-only text becomes null in every string column."""
    return on_text(df, lambda c: F.when(F.trim(c) != "", c))


def on_text(df: DataFrame, change) -> DataFrame:
    """Apply a column function to the string columns only."""
    return df.select(
        *[change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema]
    )


def drop_blank_rows(df: DataFrame, columns: Iterable[str] | None = None, how: str = "all") -> DataFrame:
    """Drop rows whose columns are all (or any) null or blank."""
    names = list(columns or df.columns)
    missing = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in names]
    joined = missing[0]
    for m in missing[1:]:
        joined = (joined & m) if how == "all" else (joined | m)
    return df.filter(~joined)


def filled_columns(df: DataFrame) -> list[str]:
    """Names of the columns that hold at least one value, from one aggregate row."""
    seen = df.agg(*[F.max(F.trim(F.col(c).cast("string")) != "").alias(c) for c in df.columns]).first()
    return [c for c in df.columns if seen[c]]


def drop_empty_columns(df: DataFrame, unwanted: str = r"(?i)unnamed_\d+|delitos?", keep: Sequence[str] = ("DELITO",)) -> DataFrame:
    """Drop unwanted names and the columns without a single value."""
    named = df.select(*[c for c in df.columns if c in keep or not re.fullmatch(unwanted, c)])
    return named.select(*filled_columns(named))


def swap_where(df: DataFrame, left: str, right: str, mask: Column) -> DataFrame:
    """Exchange two columns in the rows where ``mask`` holds."""
    wrong = F.coalesce(mask, F.lit(False))
    new = {
        left: F.when(wrong, F.col(right)).otherwise(F.col(left)),
        right: F.when(wrong, F.col(left)).otherwise(F.col(right)),
    }
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def swap_columns(df: DataFrame, left: str, right: str) -> DataFrame:
    """Exchange two columns in every row."""
    return swap_where(df, left, right, F.lit(True))


def set_where(df: DataFrame, column: str, mask: Column, value: Column) -> DataFrame:
    """Overwrite ``column`` where ``mask`` holds."""
    return df.withColumn(column, F.when(mask, value).otherwise(F.col(column)))


def listed_pair(left: Column, right: Column, pairs: Iterable[tuple[str, str, str, str]], names: Sequence[str]) -> Column:
    """The pair of values (a struct with these names) that replaces a listed one; null for others."""
    mark = "\u0001"
    entries = [
        item
        for a, b, c, d in pairs
        for item in (F.lit(a + mark + b), F.struct(F.lit(c).alias(names[0]), F.lit(d).alias(names[1])))
    ]
    return F.create_map(*entries)[F.concat(left, F.lit(mark), right)]


def replace_pairs(df: DataFrame, left: str, right: str, pairs: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Replace listed value pairs of two columns by another pair; homonyms under other keys stay."""
    fix = listed_pair(F.col(left), F.col(right), pairs, ("l", "r"))
    new = {left: F.coalesce(fix["l"], F.col(left)), right: F.coalesce(fix["r"], F.col(right))}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column a frame lacks is null there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked
