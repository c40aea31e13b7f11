r"""Vectorised words, lines and their hashes over Arrow text, for use inside tasks.

Texts of a batch stay in Arrow's buffer; words are the runs of bytes outside
``[\x20\x09-\x0D]`` and never cross from one text into the next.  Hashes are 64 bits
wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (9, 10, 11, 12, 13, 32)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE = 5


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes; one longer text makes a run of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that nearby inputs give unrelated outputs."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """The bytes of several texts, one after another; nulls are empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.n = len(column)
        self.offsets = offsets - offsets[0]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        if lower:
            upper = (self.bytes >= 65) & (self.bytes <= 90)
            self.bytes = self.bytes + (upper * np.uint8(32))
        self._prefix: np.ndarray | None = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes per text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of every run of flagged bytes within one text."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin, end, np.searchsorted(self.offsets, begin, side="right") - 1

    def is_word_byte(self) -> np.ndarray:
        table = np.ones(256, bool)
        table[list(SEPARATORS)] = False
        return table[self.bytes]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(self.is_word_byte())

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``begin`` to ``end``."""
        if self._prefix is None:
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.bytes), BASE)]))
            terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers[:-1]
            self._prefix = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            self._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.bytes), BASE_INVERSE)]))
        return mix((self._prefix[end] - self._prefix[begin]) * self._inverse[begin])


def windows(hashes: np.ndarray, text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """First position and hash of every run of ``size`` words within one text."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(hashes) - size + 1
    h = hashes[:last]
    for k in range(1, size):
        h = mix(h + np.uint64(k)) + hashes[k : last + k]
    at = np.flatnonzero(text[:last] == text[size - 1 :])
    return at, mix(h[at])


def shingle_sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their text numbers, sorted by both.

    A text of fewer words than ``size`` has its whole word sequence as its only
    shingle; one without words has none.
    """
    begin, end, text = texts.words()
    h = texts.hashes(begin, end)
    at, shingles = windows(h, text, size)
    owner = text[at]
    counts = np.bincount(text, minlength=texts.n)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(few), np.uint64)
    for k in range(size - 1):
        more = counts[few] > k
        whole[more] = mix(whole[more] + np.uint64(k + 1)) + h[firsts[few[more]] + k]
    shingles = np.concatenate([shingles, mix(whole + counts[few].astype(np.uint64))])
    owner = np.concatenate([owner, few])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], owner[new]
