"""Landed text files: the settings of each file, and records that span several lines.

A folder may hold files of different separators and encodings, and quoted cells
may hold line breaks.  Files are read as lines by many tasks; what a task has to
know of the rest of a file is one small row per file or per split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.session import settle

#: Separators looked for, in this order; the comma comes last, as other files hold decimal commas.
SEPARATORS = ("\t", ";", "|", ",")
#: A quoted cell that is still open after so many lines is taken for a stray quote.
MOST_LINES = 1000
FALLBACK_ENCODING = "ISO-8859-1"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``pos`` and ``value`` of every line below ``path``: start of the split and reading order inside it."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("pos"), "value")


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines, settled.

    Large files are split, so no file has to fit into one task.  Positions depend on
    how a job packs its splits; written once, every later step sees the same ones,
    whatever executors come or go.
    """
    return settle(lines_of(spark, path))


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def file_settings(lines: DataFrame, separators: Sequence[str] = SEPARATORS, fallback: str = FALLBACK_ENCODING) -> DataFrame:
    """One row per file: ``encoding`` and ``separator``, with the evidence: ``lines`` and ``broken_lines``.

    A file is UTF-8 unless one of its lines is not valid.  Its separator is the
    first of the list that stands outside quotes in at least half of the filled
    lines of its first split, else the one that stands in most of them, else the
    last of the list.
    """
    filled = (F.col("pos.block") == 0) & (F.trim("value") != "")
    bare = _outside_quotes(F.col("value"))
    seen = [F.count_if(filled & F.contains(bare, F.lit(s))).alias(f"_has{k}") for k, s in enumerate(separators)]
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.is_valid_utf8("value")).alias("broken_lines"),
        F.count_if(filled).alias("_filled"), *seen,
    )
    most = F.greatest(*[F.col(f"_has{k}") for k in range(len(separators))]) if len(separators) > 1 else F.col("_has0")
    often = [F.when((2 * F.col(f"_has{k}") >= F.col("_filled")) & (F.col(f"_has{k}") > 0), F.lit(s)) for k, s in enumerate(separators)]
    mostly = [F.when((F.col(f"_has{k}") == most) & (most > 0), F.lit(s)) for k, s in enumerate(separators)]
    return settle(
        per_file.select(
            "file", F.when(F.col("broken_lines") == 0, "UTF-8").otherwise(fallback).alias("encoding"),
            F.coalesce(*often, *mostly, F.lit(separators[-1])).alias("separator"), "lines", "broken_lines",
        )
    )


def decoded(lines: DataFrame, settings: DataFrame, fallback: str = FALLBACK_ENCODING) -> DataFrame:
    """The lines with their text in ``value`` by their file's encoding, and its ``separator``; a byte-order mark goes."""
    joined = lines.join(settings.select("file", "encoding", "separator"), "file")
    text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), fallback))
    text = F.when(F.col("pos.block") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    return joined.select("file", "pos", "separator", text.alias("value"))


def by_separator(make: Callable[[str], Column], separators: Sequence[str] = SEPARATORS) -> Column:
    """``make(s)`` where the row's ``separator`` is ``s``; each is compiled once."""
    out = F.lit(None)
    for s in separators:
        out = F.when(F.col("separator") == s, make(s)).otherwise(out)
    return out


def _open_at_end(line: Column, separator: str) -> Column:
    """Whether a quoted cell is open at the end of a line that begins outside quotes.

    Whole quoted cells are taken out from left to right; a cell that still begins
    with a quote is the open one.
    """
    sign = re.escape(separator)
    rest = F.regexp_replace(F.concat(F.lit(separator), line), rf'{sign} *+"(?:[^"]++|"")*+"[^{sign}]*+', separator)
    return F.coalesce(rest.rlike(rf'{sign} *+"'), F.lit(False))


def _still_open(line: Column, separator: str) -> Column:
    """Whether a quoted cell is open at the end of a line that begins inside quotes."""
    closing = r'^(?:[^"]++|"")*+"'
    after = F.concat(F.lit("x"), F.regexp_replace(line, closing, ""))
    return F.when(line.rlike(closing), _open_at_end(after, separator)).otherwise(True)


def _chained(rows: DataFrame, by: Sequence[str], order_by: str) -> DataFrame:
    """``rows`` with ``after0`` and ``after1``: the quote state after each row if the order begins outside, and if inside.

    ``outside`` and ``inside`` of a row tell the state after it by the state before
    it.  Where both agree the row sets the state; where they cross it turns it.
    """
    so_far = Window.partitionBy(*by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.when((F.col("outside") == 1) & (F.col("inside") == 0), 1).otherwise(0)
    rows = rows.withColumn("_turns", F.sum(turn).over(so_far))
    sets = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("state"), F.col("_turns").alias("turns")))
    rows = rows.withColumn("_set", F.last(sets, True).over(so_far))
    known = (F.col("_set.state") + F.col("_turns") - F.col("_set.turns")) % 2
    after = {f"after{s}": F.coalesce(known, (F.lit(s) + F.col("_turns")) % 2).cast("int") for s in (0, 1)}
    return rows.withColumns(after).drop("_turns", "_set")


def join_records(lines: DataFrame, most_lines: int = MOST_LINES, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """``file``, ``pos``, ``separator`` and ``value`` of every record, with the line breaks inside its quoted cells.

    ``lines`` come from :func:`decoded`.  Files in which no line ends inside a
    quoted cell pass as they are.  In the others every line tells the quote state
    after it for either state before it; these are chained inside each split, the
    splits of a file are chained by one row each, and the lines of a record then
    meet by the position of its first line.  A record of more than ``most_lines``
    lines comes from a stray quote: its lines stand alone.
    """
    opens = by_separator(lambda s: _open_at_end(F.col("value"), s), separators)
    open_files = settle(lines.filter(opens).select("file").distinct())
    plain = lines.join(open_files, "file", "left_anti")
    if open_files.isEmpty():
        return plain
    split = ["file", "block"]
    mapped = lines.join(open_files, "file", "left_semi").select(
        "file", F.col("pos.block").alias("block"), F.col("pos.line").alias("line"), "separator", "value",
        opens.cast("int").alias("outside"), by_separator(lambda s: _still_open(F.col("value"), s), separators).cast("int").alias("inside"),
    )
    chained = settle(_chained(mapped, split, "line"))
    last = F.struct(F.col("after0").alias("outside"), F.col("after1").alias("inside"))
    ends = chained.groupBy(*split).agg(F.max_by(last, "line").alias("_end")).select(*split, "_end.*")
    # The state in which a split begins is that in which the one before it ends, from outside at the file's start.
    over_splits = Window.partitionBy("file").orderBy("block")
    begin = F.coalesce(F.lag("after0").over(over_splits), F.lit(0))
    begins = settle(_chained(ends, ["file"], "block").select(*split, begin.alias("_begin")))
    inside = Window.partitionBy(*split).orderBy("line")
    before = {f"before{s}": F.coalesce(F.lag(f"after{s}").over(inside), F.lit(s)) for s in (0, 1)}
    stated = chained.withColumns(before).join(begins, split)
    pick = lambda name: F.when(F.col("_begin") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    stated = stated.withColumns({"_from": pick("before"), "_to": pick("after")})
    start = F.when(F.col("_from") == 0, F.struct("block", "line"))
    here = F.last(start, True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = settle(stated.withColumn("_start", here).select(*split, "line", "separator", "value", "_from", "_to", "_start"))
    # A record that began in an earlier split: the last one that began there.
    lasts = placed.groupBy(*split).agg(F.max("_start").alias("_last"))
    earlier = over_splits.rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(lasts.select(*split, F.last("_last", True).over(earlier).alias("_carried")))
    whole = placed.filter("_from = 0 AND _to = 0").select("file", F.struct("block", "line").alias("pos"), "separator", "value")
    parts = placed.filter("_from = 1 OR _to = 1").join(carried, split).withColumn("pos", F.coalesce("_start", "_carried"))
    stray = settle(parts.groupBy("file", "pos").agg(F.count(F.lit(1)).alias("_lines")).filter(F.col("_lines") > most_lines))
    met = parts.join(stray, ["file", "pos"], "left_anti").groupBy("file", "pos").agg(
        F.first("separator").alias("separator"), F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("_parts")
    )
    joined = met.select("file", "pos", "separator", F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"))
    alone = parts.join(stray, ["file", "pos"], "left_semi").select("file", F.struct("block", "line").alias("pos"), "separator", "value")
    return plain.unionByName(whole).unionByName(joined).unionByName(alone)


def cells(separators: Sequence[str] = SEPARATORS) -> Column:
    """Cells of a record in ``value`` by its ``separator``.

    A cell in quotes may hold the separator and line breaks; cells are taken from
    left to right in one pass.
    """

    def split(separator: str) -> Column:
        sign = re.escape(separator)
        cell = rf'{sign}( *+"(?:[^"]++|"")*+"[^{sign}]*+|[^{sign}]*+)'
        return F.regexp_extract_all(F.concat(F.lit(separator), F.col("value")), F.lit(cell), F.lit(1))

    bare = lambda c: F.replace(F.regexp_replace(c, '^ *"|" *$', ""), F.lit('""'), F.lit('"'))
    return F.transform(by_separator(split, separators), bare)


def landed_name(path: Column) -> Column:
    """Name under which a file was landed: its own, or that of its folder if a Spark job has written it."""
    plain = F.coalesce(F.try_url_decode(path), path)
    own = F.substring_index(plain, "/", -1)
    folder = F.regexp_replace(F.substring_index(F.substring_index(plain, "/", -2), "/", 1), "^[^=/]*=", "")
    return F.when(own.rlike(r"^part-\d{5}"), folder).otherwise(own)
