"""Raw sheets: title rows, a header somewhere, data, a footer.

A *grid* has one row per sheet line: ``file``, an orderable ``pos`` within the
file and its ``cells``.  ``pos`` need not be dense: comparing positions is enough
to cut, and only the first few lines of a file are ever numbered.  Header and
footer positions are one row per file; they are settled, so the planner sees how
small they are and attaches them to the lines without shuffling the lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.fixed import HEADER_FALLBACKS, HEADER_WORDS, SOURCE_LINE, TOTAL_LINE
from recordloom.functions.text import column_key, first_full_match, header_key, row_text
from recordloom.functions.values import replace_values
from recordloom.operators.ranking import top_per_group
from recordloom.session import settle
from recordloom.sources import landing


def read_grid(
    spark: SparkSession, path: str | list[str], separator: str | None = None, most_lines: int = landing.MOST_LINES
) -> DataFrame:
    """Records of delimited files with their place in the file.

    Every file is read by its own encoding and separator (``separator`` prescribes
    one for all), and a cell in quotes may hold the separator and line breaks.
    Positions and cells are settled once, see :mod:`recordloom.sources.landing`.
    """
    separators = landing.SEPARATORS if separator is None else (separator,)
    lines = landing.raw_lines(spark, path)
    settings = landing.file_settings(lines, separators)
    records = landing.join_records(landing.decoded(lines, settings), most_lines, separators)
    return settle(records.select("file", "pos", landing.cells(separators).alias("cells")))


def preview(grid: DataFrame, rows: int) -> DataFrame:
    """First lines of every file, numbered from zero in ``row_idx``."""
    first = top_per_group(grid, ["file"], rows, [F.col("pos")])
    return first.withColumn("row_idx", F.col("position") - 1).drop("position")


def _one_header(scored: DataFrame, order: Sequence[Column]) -> DataFrame:
    best = F.min_by(F.struct("pos", "row_idx", "cells"), F.struct(*order))
    return settle(scored.groupBy("file").agg(best.alias("_h")).select("file", "_h.*"))


def header_by_words(grid: DataFrame, words: Sequence[str] = HEADER_WORDS, rows: int = 40) -> DataFrame:
    """Per file the first of the lines that contain most of the words."""
    text = row_text(F.col("cells"))
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])
    scored = preview(grid, rows).withColumn("hits", hits)
    best = F.min_by(F.struct("pos", "row_idx", "hits", "cells"), F.struct(-F.col("hits"), F.col("row_idx")))
    return settle(scored.groupBy("file").agg(best.alias("_h")).select("file", "_h.*"))


def _exists(cells: Column, word: str) -> Column:
    return F.exists(cells, lambda c: F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit(word)))


def header_by_targets(
    grid: DataFrame, targets: Sequence[str], least: int = 3, rows: int = 30, fallbacks: Sequence[int] = HEADER_FALLBACKS
) -> DataFrame:
    """Per file the first line naming at least ``least`` targets, else the first fallback line with two cells."""
    hits = reduce(lambda a, b: a + b, [_exists(F.col("cells"), t).cast("int") for t in targets])
    place = F.array_position(F.array(*[F.lit(f) for f in fallbacks]), F.col("row_idx"))
    lines = preview(grid, rows).withColumn("_hits", hits).withColumn("_place", place)
    found = F.col("_hits") >= least
    usable = found | ((F.col("_place") > 0) & (F.size("cells") > 1))
    order = [(~found).cast("int"), F.when(found, F.col("row_idx")).otherwise(F.col("_place"))]
    return _one_header(lines.filter(usable), order)


def header_by_candidates(
    grid: DataFrame,
    candidates: Sequence[int],
    known: Sequence[str],
    renames: Mapping[str, str],
    least: int = 3,
    one_of: Sequence[str] = ("DEPARTAMENTO", "MUNICIPIO"),
) -> DataFrame:
    """Per file the first candidate row, in the order given, that names enough known columns.

    ``one_of`` lists columns of which one must be present; leave it empty to ask for none.
    """
    names = F.transform("cells", lambda c: replace_values(header_key(c), renames))
    lines = preview(grid, max(candidates) + 1).withColumn("_names", names)
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("row_idx"))
    enough = F.size(F.array_intersect("_names", F.array(*[F.lit(k) for k in known]))) >= least
    if one_of:
        enough = enough & F.arrays_overlap("_names", F.array(*[F.lit(c) for c in one_of]))
    return _one_header(lines.withColumn("_place", place).filter((F.col("_place") > 0) & enough), [F.col("_place")])


def header_at(grid: DataFrame, row: int) -> DataFrame:
    """The line with a fixed row number as the header of every file."""
    return settle(preview(grid, row + 1).filter(F.col("row_idx") == row).select("file", "pos", "row_idx", "cells"))


def footer_cut(grid: DataFrame, total: str = TOTAL_LINE, source: str = SOURCE_LINE) -> DataFrame:
    """Per file the position of the first total line, else of the first source line."""
    text = row_text(F.col("cells"))
    marked = grid.select("file", "pos", text.rlike(total).alias("_t"), text.rlike(source).alias("_s")).filter("_t OR _s")
    marks = marked.groupBy("file").agg(
        F.min(F.when(F.col("_t"), F.col("pos"))).alias("_total"),
        F.min(F.when(F.col("_s"), F.col("pos"))).alias("_source"),
    )
    return settle(marks.select("file", F.coalesce("_total", "_source").alias("cut_pos")))


def below(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines after the header of their file; files without a header give none."""
    starts = headers.select("file", F.col("pos").alias("_start"))
    return grid.join(starts, "file").filter(F.col("pos") > F.col("_start")).drop("_start")


def above_cut(grid: DataFrame, cuts: DataFrame) -> DataFrame:
    """Lines before the footer of their file that hold at least one value."""
    kept = grid.join(cuts, "file", "left").filter(F.col("cut_pos").isNull() | (F.col("pos") < F.col("cut_pos")))
    return kept.filter(F.exists("cells", lambda c: F.trim(c) != "")).drop("cut_pos")


def standard_names(cells: Column, patterns: Mapping[str, str]) -> Column:
    """Standard column names of a header's cells."""
    return F.transform(cells, lambda c: first_full_match(column_key(c), patterns))


def _layout(headers: DataFrame, columns: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """Per file the place of every standard column, of repeated names the first."""
    names = standard_names(F.col("cells"), patterns)
    places = [F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)).cast("int").alias(f"_at_{c}") for c in columns]
    return headers.withColumn("_names", names).select("file", F.col("cells").alias("_header"), *places)


def _picked(columns: Sequence[str]) -> list[Column]:
    return [F.nullif(F.trim(F.try_element_at("cells", F.col(f"_at_{c}"))), F.lit("")).alias(c) for c in columns]


def records(grid: DataFrame, headers: DataFrame, columns: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """Data lines of every sheet as ``file`` plus the standard ``columns``.

    Each file has its own layout; of repeated names the first column counts and a
    column the file lacks is null.
    """
    body = below(grid, headers)
    kept = above_cut(body, footer_cut(body))
    return kept.join(_layout(headers, columns, patterns), "file").select("file", *_picked(columns))


def line_kinds(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """The lines with their ``kind``: title, header, data, blank (below the header), footer, or no header."""
    starts = headers.select("file", F.col("pos").alias("_start"))
    cuts = footer_cut(below(grid, headers))
    filled = F.exists("cells", lambda c: F.trim(c) != "")
    kind = (
        F.when(F.col("_start").isNull(), "no header").when(F.col("pos") < F.col("_start"), "title")
        .when(F.col("pos") == F.col("_start"), "header").when(F.col("pos") >= F.col("cut_pos"), "footer")
        .when(filled, "data").otherwise("blank")
    )
    return grid.join(starts, "file", "left").join(cuts, "file", "left").withColumn("kind", kind).drop("_start", "cut_pos")


def raw_records(kinds: DataFrame, headers: DataFrame, columns: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """Data lines as :func:`records` with their ``pos`` and ``cells``, and what may be wrong with them.

    ``_again`` marks lines equal to the header, ``_beyond`` those with a value where
    the header has no name.
    """
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    beyond = F.exists(F.zip_with("cells", "_header", lambda c, h: filled(c) & ~filled(h)), lambda x: x)
    data = kinds.filter(F.col("kind") == "data").join(_layout(headers, columns, patterns), "file")
    return data.select(
        "file", "pos", "cells", *_picked(columns), (F.col("cells") == F.col("_header")).alias("_again"), beyond.alias("_beyond")
    )


def load_report(kinds: DataFrame, bad: DataFrame) -> DataFrame:
    """Per file and outcome (a kind of line, good, or the reason why a row was set aside) the ``lines``: their sum is the file."""
    of_kind = kinds.groupBy("file", F.col("kind").alias("outcome")).agg(F.count(F.lit(1)).alias("lines"))
    aside = settle(bad.groupBy("file", F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("lines")))
    less = aside.select("file", F.lit("data").alias("outcome"), (-F.col("lines")).alias("lines"))
    summed = of_kind.unionByName(aside).unionByName(less).groupBy("file", "outcome").agg(F.sum("lines").alias("lines"))
    return summed.withColumn("outcome", F.when(F.col("outcome") == "data", "good").otherwise(F.col("outcome")))


def load_audit(grid: DataFrame, headers: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per file: lines found, header row and rows loaded; sheets without a header are listed, not fatal."""
    lines = grid.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    rows = loaded.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    joined = lines.join(headers.select("file", "row_idx"), "file", "left").join(rows, "file", "left")
    return joined.select(
        "file", "lines", F.col("row_idx").alias("header_row"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("row_idx").isNull(), F.lit("no header")).otherwise(F.lit("loaded")).alias("status"),
    )
