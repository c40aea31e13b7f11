"""Language identification by rank-order profiles.

After Cavnar and Trenkle, *N-Gram-Based Text Categorization* (1994): the most
frequent letter n-grams of a document are compared with those of each language;
the language with the smallest sum of rank differences wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.spans import slices

#: n-grams kept of a language, and compared of a document.
PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
LONGEST = 3
UNKNOWN = "und"
_BITS = 21
BLANK = 32


@dataclass
class Profiles:
    """Languages in order, and for every known n-gram its rank in each (``PROFILE_SIZE`` where absent)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


class _Letters:
    """Which code points are letters; found once per task as they occur."""

    def __init__(self):
        self.known = np.full(0x110000, 2, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        flags = self.known[points]
        if (flags == 2).any():
            for p in np.unique(points[flags == 2]):
                self.known[p] = chr(p).isalpha()
            flags = self.known[points]
        return flags.astype(bool)


def document_grams(texts: Sequence[str | None], letters: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and count for every n-gram of every text.

    Words are runs of letters in lower case with one blank on either side; an
    n-gram of one to three letters packs its code points into one number.
    """
    joined = "".join("\n" + (t or "").lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
    owner = np.cumsum(points == 10, dtype=np.int32) - 1
    letter = letters(points)
    # One blank before every word and one after it; what else stands between words goes.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    points, owner = np.where(letter, points, BLANK)[keep], owner[keep]
    present = np.zeros(0x110000, bool)
    present[points] = present[BLANK] = True
    alphabet = np.flatnonzero(present)
    small = np.zeros(0x110000, np.int32)
    small[alphabet] = np.arange(len(alphabet))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    # Every position opens an n-gram of the greatest length, blanks standing in beyond its text;
    # the shorter ones are the heads of these, so one sort serves all lengths.
    codes = small[points]
    key = owner.astype(np.int64)
    for k in range(LONGEST):
        part = np.full(len(codes), small[BLANK], np.int64)
        part[: len(codes) - k] = np.where(owner[: len(codes) - k] == owner[k:], codes[k:], small[BLANK])
        key = (key << bits) | part
    key.sort()
    keys, counts = _distinct(key, np.ones(len(key), np.int64))
    found = []
    for n in range(LONGEST, 0, -1):
        parts = [alphabet[(keys >> (bits * k)) & ((1 << bits) - 1)] for k in reversed(range(n))]
        blank = [p == BLANK for p in parts]
        # No blank inside, and not blanks alone.
        whole = ~np.logical_or.reduce(blank[1:-1]) if n > 2 else np.ones(len(keys), bool)
        whole &= ~np.logical_and.reduce(blank)
        gram = np.zeros(len(keys), np.int64)
        for p in parts:
            gram = (gram << _BITS) | p
        found.append(((keys >> (bits * n))[whole], gram[whole], counts[whole]))
        keys, counts = _distinct(keys >> bits, counts)
    return tuple(np.concatenate(x) for x in zip(*found))


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted ``keys`` with their summed counts."""
    if not len(keys):
        return keys, counts
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """The most frequent n-grams of every language over all rows with a language.

    Counts are summed per batch before the shuffle.  What reaches the driver is
    ``size`` rows for each language.  Equal counts are ordered by n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        for whole in batches:
            sums: dict[str, list] = {}
            for batch in slices(whole, "_text"):
                names = np.array(batch.column("_lang").to_pylist(), dtype=object)
                owner, gram, n = document_grams(batch.column("_text").to_pylist(), letters)
                for name in set(names):
                    mine = (names == name)[owner]
                    sums.setdefault(name, []).append((gram[mine], n[mine]))
            for name, parts in sums.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["_lang", "gram", "n"]
                )

    labelled = docs.select(docs[text].alias("_text"), docs[lang].alias("_lang")).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = labelled.mapInArrow(count, "_lang string, gram long, n long").groupBy("_lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size)
    rows = top.select("_lang", "gram", "rank").collect()
    languages = sorted({r[0] for r in rows})
    grams = np.unique(np.array([r[1] for r in rows], np.int64))
    ranks = np.full((len(languages), len(grams) + 1), size, np.int64)
    for name, gram, rank in rows:
        ranks[languages.index(name), np.searchsorted(grams, gram)] = rank
    return Profiles(languages, grams, ranks, size)


def out_of_place(texts: Sequence[str | None], profiles: Profiles, letters: _Letters, most: int = DOCUMENT_SIZE) -> np.ndarray:
    """Mean rank distance of every text to every language, as a share of the largest; -1 for texts without letters."""
    owner, gram, n = document_grams(texts, letters)
    order = np.lexsort((gram, -n, owner))
    owner, gram = owner[order], gram[order]
    firsts = np.searchsorted(owner, np.arange(len(texts) + 1))
    rank = np.arange(len(owner)) - firsts[owner]
    top = rank < most
    owner, gram, rank = owner[top], gram[top], rank[top]
    at = np.searchsorted(profiles.grams, gram)
    known = at < len(profiles.grams)
    known[known] = profiles.grams[at[known]] == gram[known]
    at = np.where(known, at, len(profiles.grams))
    totals = np.bincount(owner, minlength=len(texts))
    out = np.full((len(profiles.languages), len(texts)), -1.0)
    for k, ranks in enumerate(profiles.ranks):
        apart = np.where(ranks[at] == profiles.size, profiles.size, np.abs(ranks[at] - rank))
        sums = np.bincount(owner, apart, len(texts))
        out[k, totals > 0] = sums[totals > 0] / (totals[totals > 0] * profiles.size)
    return out


def identify_language(
    docs: DataFrame, profiles: Profiles, text: str = "text", keep: Sequence[str] = ("doc_id",), most: int = DOCUMENT_SIZE
) -> DataFrame:
    """One row per document: the ``keep`` columns, ``lang_pred`` and ``score``.

    The score is one minus the distance to the nearest language over the mean
    distance to all of them, scaled to at most 1; with a single language it is one
    minus the distance.  Null texts, texts without a letter, and all texts when no
    language was learned get ``und`` and score 0.  Equal distances go to the first
    language by name.  Repeated rows are judged one by one; nothing is shuffled.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = batch.column("_text").to_pylist()
                if profiles.languages:
                    apart = out_of_place(texts, profiles, letters, most)
                    best = apart.argmin(axis=0)
                    least = apart.min(axis=0)
                    mean = apart.mean(axis=0) if len(profiles.languages) > 1 else np.ones(len(texts))
                    found = least >= 0
                    score = np.clip(1 - least / np.where(mean > 0, mean, 1), 0, 1)
                else:
                    best, found, score = np.zeros(len(texts), int), np.zeros(len(texts), bool), np.zeros(len(texts))
                names = [profiles.languages[b] if f else UNKNOWN for b, f in zip(best, found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(np.where(found, score, 0.0))],
                    names=[*keep, "lang_pred", "score"],
                )

    narrow = docs.select(*keep, docs[text].alias("_text"))
    return narrow.mapInArrow(judge, f"{fields}, lang_pred string, score double")
