"""Quality rules by compression bands.

Text that repeats itself compresses too well, and text without any structure
hardly at all.  Each document is compressed whole and in fixed chunks; every
ratio (bytes over compressed bytes) must lie in the band of its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from recordloom.llm.spans import Texts, slices, windows

#: From so many bytes on: lowest and highest ratio of a whole document.
DOCUMENT_BANDS = ((0, 0.0, 2.5), (256, 1.02, 3.5), (512, 1.1, 4.0), (1024, 1.2, 4.5), (4096, 1.35, 5.0), (32768, 1.5, 6.0))
#: The same for chunks.
CHUNK_BANDS = ((0, 0.0, 2.5), (256, 1.02, 3.0), (512, 1.1, 3.5), (1024, 1.2, 4.0))
CHUNK = 2048
#: A document goes when more than this share of its bytes lies in chunks out of band.
CHUNK_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
    "bad_chunk_share double, base_failed boolean, kept boolean"
)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, repeated lines and words in repeated five-word windows, per text."""
    inside = texts.is_word_byte()
    begin, end, text = texts.runs(inside)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    h = texts.hashes(begin, end)
    at, shingles = windows(h, text)
    covered = np.zeros(len(begin) + 1, np.int64)
    again = at[_repeated(shingles, text[at])]
    np.add.at(covered, again, 1)
    np.subtract.at(covered, again + 5, 1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    line_begin, line_end, line_text = texts.runs(texts.bytes != 10)
    worded = np.searchsorted(begin, line_end) > np.searchsorted(begin, line_begin)
    line_begin, line_end, line_text = line_begin[worded], line_end[worded], line_text[worded]
    keys = np.stack([line_text.astype(np.uint64), texts.hashes(line_begin, line_end)])
    keys = keys[:, np.lexsort(keys[::-1])]
    same = np.flatnonzero((keys[:, 1:] == keys[:, :-1]).all(axis=0))
    return {
        "n_words": np.bincount(text, minlength=texts.n),
        "word_chars": texts.count(inside & ((texts.bytes & 0xC0) != 0x80)),
        "n_symbols": texts.count(symbol[texts.bytes]),
        "n_dup_lines": np.bincount(keys[0][same].astype(np.int64), minlength=texts.n),
        "n_repeat_words": np.bincount(text[in_repeat], minlength=texts.n),
    }


def _repeated(shingles: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Flags the windows whose words occur at least twice in their text."""
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    equal = np.zeros(len(s) + 1, bool)
    equal[1:-1] = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    out = np.zeros(len(s), bool)
    out[order] = equal[1:] | equal[:-1]
    return out


def band(bands: Sequence[tuple[int, float, float]], size: int) -> tuple[float, float]:
    """Lowest and highest ratio for so many bytes."""
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def compression(raw: bytes, pack, chunk: int, document_bands, chunk_bands) -> tuple[float, float, bool]:
    """Whole ratio, share of bytes in chunks out of band, and whether the whole ratio is in band."""
    if not raw:
        return 0.0, 0.0, True
    ratio = len(raw) / len(pack(raw))
    low, high = band(document_bands, len(raw))
    bad = 0
    for k in range(0, len(raw), chunk):
        part = raw[k : k + chunk]
        chunk_low, chunk_high = band(chunk_bands, len(part))
        bad += 0 if chunk_low <= len(part) / len(pack(part)) <= chunk_high else len(part)
    return ratio, bad / len(raw), low <= ratio <= high


def compression_quality(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    chunk: int = CHUNK,
    share: float = CHUNK_SHARE,
    document_bands=DOCUMENT_BANDS,
    chunk_bands=CHUNK_BANDS,
) -> DataFrame:
    """One row per document: the ``keep`` columns, counts, ratios, ``base_failed`` and ``kept``.

    Null and empty texts, and all with fewer than ten words, fail the base rule.
    So does a text with over a fifth of its words in repeated five-word windows.
    Repeated rows are judged one by one; an empty table gives an empty one.  Work
    is per row: nothing is shuffled, and a text of any length is compressed whole.
    """
    fields = [docs.schema[c] for c in keep]
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = Texts(batch.column("_text"))
                counts = base_counts(texts)
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                raw, o = texts.bytes.tobytes(), texts.offsets
                found = [
                    compression(raw[o[k] : o[k + 1]], packer.compress, chunk, document_bands, chunk_bands)
                    for k in range(texts.n)
                ]
                ratio, bad, fine = (np.array(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep]
                    + [pa.array(counts[c].astype(np.int64)) for c in list(counts)]
                    + [pa.array(ratio, pa.float64()), pa.array(bad, pa.float64()), pa.array(failed)]
                    + [pa.array(~failed & fine.astype(bool) & (bad <= share))],
                    names=[*keep, *counts, "ratio", "bad_chunk_share", "base_failed", "kept"],
                )

    narrow = docs.select(*keep, docs[text].alias("_text"))
    return narrow.mapInArrow(judge, f"{kept_schema}, {COLUMNS}")
