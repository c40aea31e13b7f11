"""Fill-in-the-middle rearrangement with cuts chosen on a roaring set of token borders.

The borders of a text are the offsets at which a token may end.  They are kept as
in Chambi, Lemire and others, *Better bitmap performance with Roaring bitmaps*
(2016): offsets that share their high bits form a container, stored as an array,
a bitmap or runs, whichever is smallest, and cumulative cardinalities lie beside
the containers.  The k-th border is found by searching these for the container and
selecting inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.spans import Texts, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8
#: Positions of the set bits of every byte, lowest first; unused places hold 8.
BITS = np.array([([b for b in range(8) if byte >> b & 1] + [8] * 8)[:8] for byte in range(256)])
POPCOUNT = (BITS < 8).sum(axis=1)


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit for each of 65,536 values, with set bits counted up to every byte."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.bytes = np.packbits(bits, bitorder="little")
        self.counts = np.cumsum(POPCOUNT[self.bytes])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.counts, k, side="right"))
        before = int(self.counts[at - 1]) if at else 0
        return 8 * at + int(BITS[self.bytes[at], k - before])


class RunContainer:
    """Runs of consecutive values: where they start, and the values up to the end of each."""

    def __init__(self, starts: np.ndarray, counts: np.ndarray):
        self.starts, self.counts = starts.astype(np.uint16), counts

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.counts, k, side="right"))
        return int(self.starts[at]) + k - (int(self.counts[at - 1]) if at else 0)


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted values below 65,536; two bytes a value, four a run."""
    first = np.flatnonzero(np.diff(values, prepend=-2) > 1)
    if 4 * len(first) < min(2 * len(values), BITMAP_BYTES):
        return RunContainer(values[first], np.append(first[1:], len(values)))
    return ArrayContainer(values) if 2 * len(values) <= BITMAP_BYTES else BitmapContainer(values)


class RoaringSet:
    """Sorted whole numbers in containers by their high bits."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[first]
        self.counts = np.append(first[1:], len(values))
        self.containers = [container(v & (SPAN - 1)) for v in np.split(values, first[1:])]

    def __len__(self) -> int:
        return int(self.counts[-1])

    def select(self, k: int) -> int:
        """The k-th smallest, from 0."""
        at = int(np.searchsorted(self.counts, k, side="right"))
        before = int(self.counts[at - 1]) if at else 0
        return (int(self.high[at]) << 16) + self.containers[at].select(k - before)


def token_starts(texts: Texts) -> np.ndarray:
    """Byte offsets at which a token begins: a run of A-Z and a-z, or any other code point."""
    lower = texts.bytes | 32
    letter = (lower >= 97) & (lower <= 122)
    begins = (texts.bytes & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]] = True
    return np.flatnonzero(begins)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that follow from the id and the seed alone; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row of ``docs``.

    Two borders between tokens, drawn by the id, cut the text into prefix, middle
    and suffix.  Form ``psm`` is prefix, suffix, middle behind their markers,
    ``spm`` suffix, prefix, middle.  Texts that are null, empty or hold a marker,
    and ``plain_percent`` of the rest, stay as they are, a null one as empty; their
    numbers of code points are null.  Rows that share an id and a text have equal
    results; an empty table gives an empty one.  Work is per row, nothing is
    shuffled, and a task holds little more than one text of any length.
    """
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = Texts(batch.column("_text"))
                starts = token_starts(texts)
                cuts = np.searchsorted(starts, texts.offsets).tolist()
                points = (texts.bytes & 0xC0) != 0x80
                rows: list[tuple] = []
                for k, key in enumerate(batch.column("_id").to_pylist()):
                    begin, end = int(texts.offsets[k]), int(texts.offsets[k + 1])
                    raw, n = texts.bytes[begin:end].tobytes(), cuts[k + 1] - cuts[k]
                    h1, h2, h3, h4 = draws(key, seed)
                    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= 100 - plain_percent:
                        rows.append((n, "plain", None, None, raw))
                        continue
                    borders = RoaringSet(np.append(starts[cuts[k] : cuts[k + 1]] - begin, end - begin))
                    a, b = (borders.select(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    size = [int(np.count_nonzero(points[begin + x : begin + y])) for x, y in ((0, a), (a, b))]
                    if h4 % 100 < spm_percent:
                        rows.append((n, "spm", *size, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))))
                    else:
                        rows.append((n, "psm", *size, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id")]
                    + [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                    + [pa.array(columns[4], pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    narrow = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text"))
    return narrow.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    No part holds a marker, and no marker can overlap another, so cutting at the
    markers gives the parts back.
    """
    first, second, third = (F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k)) for k in (1, 2, 3))
    psm, spm = F.concat(first, third, second), F.concat(second, third, first)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
