"""Token files: frequency-ranked ids in byte-aligned variable-length coding, control bytes kept apart.

Ids are replaced by their rank among all ids of the corpus, so that frequent ones
fit one byte.  A value takes one to four bytes, lowest first; its length stands in
two bits of a separate stream of control bytes, four values to a byte (after
Lemire, Kurz and Rupp, *Stream VByte*, 2018).  A table of the lengths behind each
control byte decodes a whole block at once.

A file folder holds two Parquet tables, so that Spark commits, retries and finds
them wherever it can write:

``dictionary``
    ``rank``, ``id`` and ``n``, how often the id occurs.
``blocks``
    Runs of whole documents in ascending order: ``part`` (order of the file),
    ``block`` (order in the file), ``first`` (ids of the file before the block),
    ``n``, ``doc_ids``, ``ends`` (ids of the block up to each document's end),
    ``control`` and ``data``.
"""

from __future__ import annotations

import functools
import json
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.spans import slices
from recordloom.session import scratch_path, settle

#: Ids of a block, unless one document has more.
BLOCK = 1 << 16
#: Words a worker process remembers twice over, and the length of the longest.
REMEMBERED, LONGEST = 450_000, 64
#: Bytes of a text split at once.
PIECE = 1 << 20
#: Lengths of the four values behind each control byte, and the bits that a value of each length has.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
#: How the 49k file with word ends prepares texts, and the pieces it cuts lower-case words into.
KNOWN_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Printable characters that normalisation leaves alone and that are one character in lower case, none of them white space.
PLAIN_WORD = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
#: Signs that end words; no added token and no contraction consists of these alone.
SIGNS = b".,;:!?#$%&*"
#: The printable stand-ins of bytes in byte-level files: those printable in Latin-1 stand for themselves, the others follow.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SELF)}
SCHEMA = "part int, block long, first long, n long, doc_ids array<long>, ends array<long>, control binary, data binary"


def default_path() -> str:
    """Where the public 49k file with word ends lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = np.ones(-(-len(values) // 4) * 4, np.uint8)
    for limit in MASKS[1:4]:
        size[: len(values)] += values > limit
    codes = (size - np.uint8(1)).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    size = size[: len(values)]
    width = int(size.max(initial=1))
    used = np.arange(width, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    padded = data + b"\0\0\0\0"
    words = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    return words[begin] & MASKS[size]


class Recent(dict):
    """Values found once and remembered; of the ones remembered longest, those used since stay."""

    def __init__(self, find: Callable):
        self.find, self.older = find, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """The ids of each word as bytes, found by the tokenizer when first asked for.

    White space parts words for the tokenizer, and what it makes of a word does not
    depend on its neighbours, so a word has to be encoded once only.  If the file
    prepares texts in the way stated by ``KNOWN_STEPS``, words of plain Latin
    letters and signs are prepared here and go to the tokenizer's model piece by
    piece; all other words go through the whole tokenizer.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.type = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        added = [regex.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(added) or "(?!)").search
        self.known_steps = {k: spec.get(k) for k in KNOWN_STEPS} == KNOWN_STEPS
        self.words = Recent(self._word)
        for blank in " \t\n\v\f\r":
            if self.tokenizer.encode(f"x{blank}x", add_special_tokens=False).ids != 2 * self._ids("x"):
                raise ValueError(f"the tokenizer does not drop the blank {blank!r} between words")

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _word(self, word: bytes) -> bytes:
        if not self.known_steps:
            return self._packed(self._ids(word.decode(errors="replace")))
        core = word.rstrip(SIGNS)
        if core.isalpha():  # ASCII letters and at most one run of signs
            low = core.lower()
            ids = self.words.get(low) or self._packed([t.id for t in self.model.tokenize(low.decode())])
            return ids if len(core) == len(word) else ids + self.words[word[len(core) :]]
        text = word.decode(errors="replace")
        if not PLAIN_WORD.fullmatch(text):
            return self._packed(self._ids(text))
        if text.isalpha():
            return self._piece(text.lower())
        if self.special(text):
            return self._packed(self._ids(text))
        pieces = PIECES.findall(text.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join([self._known_piece(p.encode(), p) for p in pieces])

    def _known_piece(self, raw: bytes, piece: str) -> bytes:
        """The ids of a piece, which may be remembered as a word."""
        ids = self.words.get(raw)
        return self._piece(piece) if ids is None else ids

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.type == "<u2" else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids of a text, split a piece at a time so that a long one needs little memory."""
        find = self.words.__getitem__
        if len(text) <= PIECE:
            return b"".join(map(find, text.split()))
        return b"".join(b"".join(map(find, piece.split())) for piece in _pieces(text))


@functools.lru_cache(maxsize=1)
def words_of(file_text: str, kind: str) -> WordIds:
    """One memory of words for all tasks that a worker process runs."""
    words = WordIds(file_text)
    words.type = kind
    return words


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of about ``PIECE`` bytes, cut at white space only."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[begin:end]
        begin = end


def id_type(size: int) -> str:
    """The narrowest type for ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame, str]:
    """``_id``, ``_row`` and ``_ids`` of every row of ``docs``; ``id`` and ``n``, how often an id occurs; the type of the ids.

    Both come from one pass, written once: each task ends with a row of counts.
    ``_row`` numbers the rows, to tell those that share an id apart.  A null text
    has the end id alone.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        file_text = docs.sparkSession.sparkContext.broadcast(f.read())
    size = max(Tokenizer.from_str(file_text.value).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, seen, names = np.array([end_id], kind).tobytes(), np.zeros(size, np.int64), ["_id", "_ids", "_counts"]
        for whole in batches:
            words = words_of(file_text.value, kind)
            for batch in slices(whole, "_text", PIECE):
                ids = [words.encode(t or b"") + end for t in batch.column("_text").to_pylist()]
                seen += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("_counts").to_pylist():
                n = np.frombuffer(counts, np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["id", "n"])

    narrow = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("binary").alias("_text"))
    done = narrow.mapInArrow(run, "_id long, _ids binary, _counts binary")
    done = settle(done.withColumn("_row", F.monotonically_increasing_id()))
    counts = done.filter(F.col("_counts").isNotNull()).select("_counts").mapInArrow(listed, "id long, n long")
    return done.filter(F.col("_ids").isNotNull()).select("_id", "_row", "_ids"), counts.groupBy("id").agg(F.sum("n").alias("n")), kind


def ranked_ids(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All ids that occur, the most frequent first and the smaller of ties, and how often; no longer than the vocabulary."""
    totals = counts.toPandas()
    ids, n = totals["id"].to_numpy(np.int64), totals["n"].to_numpy(np.int64)
    order = np.lexsort((ids, -n))
    return ids[order], n[order]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one behind the other, and where each row ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return flat, (offsets[1:] - offsets[0]) // np.dtype(kind).itemsize


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, rank_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition: whole documents, as many as fit ``BLOCK`` ids, at least one."""
    from pyspark import TaskContext

    part, block, first = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        doc_ids, (flat, ends) = batch.column("_id"), _flat(batch.column("_ids"), kind)
        begin = 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            n = int(ends[end - 1]) - before
            control, data = pack(rank_of[flat[before : before + n]])
            row = [part, block, first, n, doc_ids[begin:end].to_pylist(), (ends[begin:end] - before).tolist(), control, data]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, row))], BLOCK_SCHEMA)
            begin, block, first = end, block + 1, first + n


BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text of ``docs``, end each with ``end_id``, and write the files of ``path`` in ascending order of the ids.

    Null ids come first; rows that share an id stand one behind the other.  Null
    and empty texts have the end id alone; an empty table gives files without
    blocks.  Documents are dealt by range of (id, row number), so that even one id
    on very many rows is spread; only token ids travel.  The rank list, at most as
    long as the vocabulary, goes through the driver.
    """
    encoded, counts, kind = encode_ids(docs, tokenizer_path, end_id, doc_id, text)
    ids, n = ranked_ids(counts)
    spark = docs.sparkSession
    listed = [(k, int(i), int(c)) for k, (i, c) in enumerate(zip(ids, n))]
    spark.createDataFrame(listed, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/dictionary")
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    ranks = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, kind, ranks.value)

    ordered = encoded.repartitionByRange("_id", "_row").sortWithinPartitions("_id", "_row").select("_id", "_ids")
    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` of every document in the files.

    ``ids`` are little-endian unsigned 32-bit numbers, the end id included.  Files
    are read in parallel; one small row per file tells where the next begins.
    """
    listed = spark.read.schema("rank long, id long").parquet(f"{path}/dictionary").toPandas()
    id_of = np.zeros(len(listed), "<u4")
    id_of[listed["rank"].to_numpy()] = listed["id"].to_numpy()
    vocabulary = spark.sparkContext.broadcast(id_of)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = vocabulary.value[unpack(row["control"], row["data"], row["n"])]
                ends = row["ends"]
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64())]
                    + [pa.array([row["before"] + row["first"] + a for a in starts], pa.int64())]
                    + [pa.array([b - a for a, b in zip(starts, ends)], pa.int64())]
                    + [pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("part").agg(F.sum("n").alias("_n"))
    files = files.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias("before"))
    return blocks.join(files, "part").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """``docs`` written to new files under the shared folder, as ``read_token_files`` gives them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
