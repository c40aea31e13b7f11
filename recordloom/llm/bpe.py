"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word.  A sequence is what merging
would give exactly when every two neighbours are compatible, that is, when
merging their joint bytes leaves the border between them alone.  This is tested
for all distinct pairs of a batch at once; only words with a failing pair are
merged step by step.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.spans import slices

#: Fixed values of byte-level BPE files: the split into words, and the printable stand-ins of bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = 1
KINDS = {SPACE: regex.compile(r"\s"), 2: regex.compile(r"\p{L}"), 3: regex.compile(r"\p{N}"), 4: regex.compile(r"(?s).")}
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Words that a worker process remembers, twice over.
REMEMBERED = 150_000
#: A character that stands for no byte.
APART = "\u0100"
NEVER = np.int64(1 << 60)


def default_path() -> str:
    """Where the public 50k byte-level file lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_text(path: str) -> str:
    """The tokenizer file, read by the driver and sent with the job (a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Codec:
    """Encodes and decodes with one tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        stand_in = {b: chr(b) for b in PRINTABLE}
        others = [b for b in range(256) if b not in stand_in]
        stand_in.update({b: chr(256 + k) for k, b in enumerate(others)})
        byte_of = {c: b for b, c in stand_in.items()}
        raw = {t: bytes(byte_of[c] for c in t) for t in model["vocab"] if all(c in byte_of for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        #: What two tokens merge into, by rank of the merge.
        self.rank = {(self.id_of[raw[a]], self.id_of[raw[b]]): k for k, (a, b) in enumerate(pairs)}
        self.merged = {p: self.id_of[raw[pairs[k][0]] + raw[pairs[k][1]]] for p, k in self.rank.items()}
        self._tables(size)
        self.split = regex.compile(WORD_PATTERN)
        names = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.specials = regex.compile(f"({names})") if names else None
        self.kinds = np.zeros(0x110000, np.uint8)
        #: Tokens of the words met lately; of those met before, the ones used since stay.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.speculated = self.repaired = 0
        reachable = self._reachable()
        missing = [b for b in range(256) if bytes([b]) not in self.id_of]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.matcher = ahocorasick.Automaton()
        for token, i in self.id_of.items():
            if reachable[i]:
                self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()

    def _tables(self, size: int) -> None:
        self.size = size
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array(list(self.rank.values()), np.int64)[order]
        self.product = np.array([self.merged[p] for p in self.rank], np.int64)[order]
        #: The last merge inside a token: its rank and halves; single bytes have none.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), k in self.rank.items():
            token = self.merged[a, b]
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = k, a, b

    def _reachable(self) -> np.ndarray:
        """The tokens that merging their own bytes yields; others can never be proposed."""
        single = np.array([len(t) == 1 for t in self.bytes_of])
        fine = single | (self.made >= 0)
        made = np.flatnonzero(self.made >= 0)
        fine[made] = self.compatible(self.left[made], self.right[made], self.made[made])
        while True:
            both = fine & (single | (fine[self.left] & fine[self.right]))
            if (both == fine).all():
                return fine
            fine = both

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word."""
        return self.merge_all([word])[0]

    def merge_all(self, words: Sequence[bytes]) -> list[list[int]]:
        """Exact merging of many words: the pair of lowest rank first, the leftmost of equals.

        All words take their next merge together, one row each; long words go one by one.
        """
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for k in np.flatnonzero(sizes > 48):
            out[k] = self._merge_long([self.id_of[words[k][j : j + 1]] for j in range(sizes[k])])
        for low, high in ((0, 8), (8, 16), (16, 48)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                for k, ids in zip(some, self._merge_rows([words[k] for k in some], high)):
                    out[k] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[list[int]]:
        single = np.array([self.id_of.get(bytes([b]), 0) for b in range(256)], np.int64)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.array([len(w) for w in words])
        ids = single[raw]
        ids[np.arange(width) >= size[:, None]] = -1
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live, done = np.arange(len(words)), ids.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            more = ranks[rows, at] < NEVER
            if not more.all():
                done[live[~more]] = ids[~more]
                live, ids, ranks, at = live[more], ids[more], ranks[more], at[more]
                rows = np.arange(len(live))
                if not len(live):
                    break
            ids[rows, at] = self.product[self._find(ids[rows, at], ids[rows, at + 1])]
            later = np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            ranks[rows, at] = self._ranks(ids[rows, at], ids[rows, np.minimum(at + 1, width - 1)])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
        return [row[:n] for row, n in zip(done.tolist(), (done >= 0).sum(axis=1).tolist())]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.pair_keys, a * self.size + b), len(self.pair_keys) - 1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; ``NEVER`` where there is none."""
        if not len(self.pair_keys):
            return np.full(a.shape, NEVER)
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NEVER)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for words of any length."""
        from heapq import heapify, heappop, heappush

        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, end = self.rank, len(ids)
        heap = [(rank[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapify(heap)
        while heap:
            _, k, pair = heappop(heap)
            j = after[k] if ids[k] >= 0 else end
            if j >= end or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = self.merged[pair], -1
            after[k] = after[j]
            if after[j] < end:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < end and (p := (ids[a], ids[b])) in rank:
                    heappush(heap, (rank[p], a, p))
        return [i for i in ids if i >= 0]

    def propose(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words: token ids, and the number of each one's word.

        The words are matched in one go, bytes as characters, with a sign between
        them that no token holds; every byte is a token, so none is left out.
        """
        joined = APART.join([w.decode("latin-1") for w in words])
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(joined)), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words])
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joint bytes of each pair leaves the border alone, for many pairs at once.

        The merges inside both tokens are undone from the latest to the earliest.
        In every state the two tokens at the border are looked up; if these would
        merge before the state ends, the border falls.  Of equal ranks the leftmost
        goes first: one on the left before the border's, one on the right after it.
        ``until`` ends the first state; merges of that rank or later don't count.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        left, right = a.copy(), b.copy()
        until = np.full(len(a), NEVER) if until is None else until
        while len(live):
            falls = self._ranks(left, right) < until
            fine[live[falls]] = False
            made_left, made_right = self.made[left], self.made[right]
            go_left = made_left > made_right
            done = falls | ((made_left < 0) & (made_right < 0))
            until = np.where(go_left, made_left, made_right + 1)
            left = np.where(go_left, self.right[left], left)
            right = np.where(go_left, right, self.left[right])
            live, left, right, until = live[~done], left[~done], right[~done], until[~done]
        return fine

    def learn(self, words: Sequence[str]) -> None:
        """Find and remember the tokens of words not seen yet."""
        raws = [w.encode() for w in words]
        flat, owner = self.propose(raws)
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] * self.size + flat[1:])[inner]
        distinct, at = np.unique(keys, return_inverse=True)
        failing = owner[1:][inner][~self.compatible(distinct // self.size, distinct % self.size)[at]]
        failing = np.unique(failing)
        packed = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        self.words.update(zip(words, (packed[a:b] for a, b in zip([0, *ends], ends))))
        for k, ids in zip(failing, self.merge_all([raws[k] for k in failing])):
            self.words[words[k]] = np.array(ids, "<u4").tobytes()
        self.repaired += len(failing)
        self.speculated += len(words)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of every text as little-endian 32-bit numbers."""
        pieces = self._pieces(texts)
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        unknown = set().union(*pieces) - self.words.keys() - self.added.keys()
        known = unknown & self.older.keys()
        self.words.update(zip(known, map(self.older.__getitem__, known)))
        if fresh := list(unknown - known):
            self.learn(fresh)
        known = {**{t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}}
        find = self.words.__getitem__
        if not known:
            return [b"".join(map(find, p)) for p in pieces]
        return [
            b"".join(map(find, p)) if known.keys().isdisjoint(p) else b"".join(known.get(w) or self.words[w] for w in p)
            for p in pieces
        ]

    def _pieces(self, texts: Sequence[str]) -> list[list[str]]:
        """The words of every text; added tokens stand for themselves."""
        out: list[list[str] | None] = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if self.specials is not None and any(t in text for t in self.added):
                parts = self.specials.split(text)
                out[k] = [w for p in parts for w in ([p] if p in self.added else self.split.findall(p))]
            elif "'" in text:
                out[k] = self.split.findall(text)
            else:
                plain.append(k)
        for k, words in zip(plain, self._split_plain([texts[k] for k in plain])):
            out[k] = words
        return out

    def _split_plain(self, texts: Sequence[str]) -> list[list[str]]:
        """``WORD_PATTERN`` for texts without apostrophes, from the kinds of neighbouring characters.

        A run of letters, digits or other signs is a word, with one blank before it
        if there is one; of a run of white space the last character stands apart.
        """
        joined = "".join(texts)
        if not joined:
            return [[] for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self._kinds(points)
        ends = np.cumsum([len(t) for t in texts])
        space = kind == SPACE
        begin = np.ones(len(points), bool)
        begin[1:] = np.where(
            space[1:], ~space[:-1], np.where(space[:-1], points[:-1] != 32, kind[1:] != kind[:-1])
        )
        last_of_run = space[1:-1] & space[:-2] & ~space[2:]
        closed = np.zeros(len(points) + 1, bool)
        closed[ends] = True
        begin[1:-1] |= last_of_run & ~closed[2:-1]
        begin[ends[ends < len(points)]] = True
        at = np.flatnonzero(begin)
        words = [joined[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(joined)])]
        cuts = np.searchsorted(at, ends).tolist()
        return [words[a:b] for a, b in zip([0, *cuts], cuts)]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kind = self.kinds[points]
        if not kind.all():
            for p in np.unique(points[kind == 0]):
                c = chr(p)
                self.kinds[p] = next(k for k, r in KINDS.items() if r.match(c))
            kind = self.kinds[points]
        return kind

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; what isn't UTF-8 is replaced."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@functools.lru_cache(maxsize=1)
def codec_of(file_text: str) -> Codec:
    """One codec, and one memory of words, for all tasks that a worker process runs."""
    return Codec(file_text)


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``keep`` columns, ``n_tokens``, ``ids`` and ``decoded``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers, and
    ``decoded`` the text they give back.  A null text counts as empty: no ids and
    an empty decoded text.  Strings of added tokens in a text become their ids.
    Repeated rows are encoded one by one; an empty table gives an empty one.  Work
    is per row: nothing is shuffled, and each task remembers a bounded number of
    words.  Columns of ``keep`` may have any names; one of a name added here gives way.
    """
    keep = [c for c in keep if c not in ("n_tokens", "ids", "decoded")]
    hidden = {c: f"_k{k}" for k, c in enumerate(keep)}
    fields = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in hidden.items())
    file_text = docs.sparkSession.sparkContext.broadcast(vocabulary_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            codec = codec_of(file_text.value)
            for batch in slices(whole, "_text", 1 << 21):
                texts = [t or "" for t in batch.column("_text").to_pylist()]
                ids = codec.encode(texts)
                decoded = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(h) for h in hidden.values()]
                    + [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                    + [pa.array(decoded, pa.binary()).view(pa.string())],
                    names=[*hidden.values(), "n_tokens", "ids", "decoded"],
                )

    narrow = docs.select(*[docs[c].alias(h) for c, h in hidden.items()], docs[text].alias("_text"))
    done = narrow.mapInArrow(run, f"{fields}, n_tokens long, ids binary, decoded string")
    return done.withColumnsRenamed({h: c for c, h in hidden.items()})


def digests(encoded: DataFrame) -> DataFrame:
    """``ids_sha256`` and ``decoded_sha256`` in place of ids and text."""
    return encoded.withColumns(
        {"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}
    ).drop("ids", "decoded")


