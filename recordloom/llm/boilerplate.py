"""Line deduplication by site-relative frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import settle

#: A line goes when more than this share of its host's pages hold it, and so many pages at least.
RATIO = 0.1
LEAST_PAGES = 3
#: Copies of a host's list of frequent lines.
COPIES = 16
#: Columns that a page gets.
ADDED = ("_host", "_n_lines", "_n_dropped", "_text")

_UNSEEN = r"(?is)<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|td|table|br|nav|header|footer|article|section|blockquote)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """Visible text of a page with one line per block element."""
    seen = F.regexp_replace(html, _UNSEEN, "")
    return F.regexp_replace(F.regexp_replace(seen, _BLOCK, "\n"), r"<[^>]*>", "")


def url_host(url: Column) -> Column:
    """Host of an address in lower case; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def frequent_lines(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``_frequent``, the hashes of lines on more than ``ratio`` of the host's pages.

    A page counts once for a line.  Lines are counted by a 64-bit hash, summed per
    task before the shuffle.  If pages of a host hold L different lines on
    average, it has fewer than L / ``ratio`` frequent ones, so the list is small.
    """
    present = pages.filter(F.col(host).isNotNull())
    worded = F.filter(lines, lambda line: _has_word(line))
    hashes = F.array_distinct(F.transform(worded, lambda line: F.xxhash64(_bare(line))))
    counts = present.select(host, F.explode(hashes).alias("_line")).groupBy(host, "_line").agg(F.count(F.lit(1)).alias("_pages"))
    totals = present.groupBy(host).agg(F.count(F.lit(1)).alias("_total"))
    often = counts.filter(F.col("_pages") >= least).join(totals, host).filter(F.col("_pages") > F.lit(ratio) * F.col("_total"))
    return often.groupBy(host).agg(F.collect_set("_line").alias("_frequent"))


def drop_frequent_lines(
    pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least: int = LEAST_PAGES
) -> DataFrame:
    """``pages`` with ``_host``, ``_n_lines`` (lines with a word), ``_n_dropped`` and ``_text``, the lines that stay.

    Lines are split at line feeds and compared without white space at their ends;
    blank ones always stay.  A null text stays null with no lines; rows without a
    host keep every line.  Repeated rows count as pages of their own.  Every page
    stays, even if all its lines go; an empty table gives an empty one.  Columns of
    ``pages`` may have any names; one of a name added here gives way.
    """
    hidden = {c: f"_c{k}" for k, c in enumerate(pages.columns) if c not in ADDED}
    split = pages.select(
        *[pages[c].alias(h) for c, h in hidden.items()], host.alias("_host"), F.split(text, "\n", -1).alias("_lines")
    )
    often = frequent_lines(split.select("_host", "_lines"), "_host", "_lines", ratio, least)
    # The list is small and copied, so that the pages of a large host meet it in many tasks.
    copied = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_salt")
    often = settle(often).select(F.col("_host").alias("_of"), "_frequent", copied)
    salted = split.withColumn("_part", F.pmod(F.xxhash64("_lines"), F.lit(COPIES)))
    same = (F.col("_host") == F.col("_of")) & (F.col("_part") == F.col("_salt"))
    joined = salted.join(often, same, "left").drop("_of", "_part", "_salt")
    known = F.coalesce("_frequent", F.array().cast("array<bigint>"))
    gone = lambda line: _has_word(line) & F.array_contains(known, F.xxhash64(_bare(line)))
    stay = F.when(F.size(known) == 0, F.col("_lines")).otherwise(F.filter("_lines", lambda line: ~gone(line)))
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda line: _has_word(line))), F.lit(0))
    out = joined.withColumn("_stay", stay)
    done = (
        out.withColumn("_n_lines", F.when(F.col("_lines").isNull(), 0).otherwise(n_lines).cast("long"))
        .withColumn("_n_dropped", F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size("_stay")).cast("long"))
        .withColumn("_text", F.array_join("_stay", "\n"))
    )
    return done.select(*[F.col(h).alias(c) for c, h in hidden.items()], *ADDED)
