"""Toxic spans by a linear-chain conditional random field.

Labels say which documents are toxic, not where.  Words (and beginnings of words)
that set toxic documents apart from clean ones label the tokens of a bounded sample;
a two-state chain learns from these.  Forward-backward marginals of its states give
the offending words, and together the score of the document.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.spans import Texts, slices

#: Labelled documents to learn from, at most, of either class; and their bytes in all.
SAMPLE_DOCUMENTS = 1000
SAMPLE_BYTES = 8 << 20
#: A token of a toxic document is labelled toxic if its word or beginning occurs there in so many
#: different surroundings (at least that share of the toxic documents), and so many times as often as
#: in clean documents.
LEAST_SURROUNDINGS, SUPPORT, LIFT = 6, 0.015, 20.0
ROUNDS, PENALTY, FALLOFF = 30, 1e-6, 0.9
EDGE_SIGNS = b".,!?;:\"'()[]*#$%&"
_ROW = 256


@dataclass
class Model:
    """Weights by feature, the chain's scores, and the map from marginals to a document's score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -5.0
    start: list[float] = field(default_factory=lambda: [0.0, 0.0])
    step: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    #: Offset and slopes for the log of the summed evidence and the strongest token's log odds.
    score: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.0])


def word_features(word: bytes) -> list[str]:
    """The word without signs at its ends, its beginning, its end and its form."""
    bare = (word.strip(EDGE_SIGNS) or word).decode(errors="replace")
    out = [f"w {bare}", f"f {min(len(bare), 12)}{'d' if any(c.isdigit() for c in bare) else ''}"]
    out += [f"b {bare[:n]}" for n in (4, 5, 6) if len(bare) > n]
    return out + ([f"e {bare[-3:]}"] if len(bare) > 3 else [])


def _tables(e: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Transition weights into every token, shape (from, to, row length, rows); texts follow one another."""
    rows = -(-len(e) // _ROW) or 1
    score, opens = np.zeros(rows * _ROW), np.ones(rows * _ROW, bool)
    score[: len(e)], opens[: len(e)] = np.exp(np.clip(e, -30, 30)), first
    score[len(e) :] = 1.0
    enter, within = np.exp(start), np.exp(step)
    table = np.empty((2, 2, _ROW, rows))
    for a in (0, 1):
        for b in (0, 1):
            weight = np.where(opens, enter[b], within[a, b]) * (score if b else 1.0)
            table[a, b] = weight.reshape(rows, _ROW).T
    return table


def forward_backward(e: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal chance of the toxic state at every token, and the expected transitions.

    All texts form one chain that a text's first token cuts: what enters it doesn't
    depend on the state before.  The chain is folded into rows of equal length,
    which advance side by side; products of whole rows carry the state over.
    """
    table = _tables(e, first, start, step)
    rows = table.shape[3]
    product = np.zeros((2, 2, rows))
    product[0, 0] = product[1, 1] = 1.0
    for j in range(_ROW):
        t = table[:, :, j]
        product = np.stack([product[:, 0] * t[0, b] + product[:, 1] * t[1, b] for b in (0, 1)], axis=1)
        product /= product.sum(axis=(0, 1))
    enter, leave = np.zeros((2, rows)), np.zeros((2, rows))
    state = np.array([0.5, 0.5])
    for r in range(rows):
        enter[:, r] = state
        state = state @ product[:, :, r]
        state = state / state.sum()
    state = np.array([0.5, 0.5])
    for r in reversed(range(rows)):
        leave[:, r] = state
        state = product[:, :, r] @ state
        state = state / state.sum()
    forward, backward = np.empty((_ROW + 1, 2, rows)), np.empty((_ROW, 2, rows))
    forward[0], backward[-1] = enter, leave
    for j in range(_ROW):
        t = table[:, :, j]
        now = forward[j, 0] * t[0] + forward[j, 1] * t[1]
        forward[j + 1] = now / now.sum(axis=0)
    for j in range(_ROW - 1, 0, -1):
        t = table[:, :, j]
        now = t[:, 0] * backward[j, 0] + t[:, 1] * backward[j, 1]
        backward[j - 1] = now / now.sum(axis=0)
    both = forward[1:] * backward
    marginal = (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[: len(e)]
    inner = np.zeros(rows * _ROW, bool)
    inner[: len(e)] = ~first
    inner = inner.reshape(rows, _ROW).T
    pairs = [[forward[:-1, a] * table[a, b] * backward[:, b] for b in (0, 1)] for a in (0, 1)]
    whole = pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1]
    went = [[float((pairs[a][b] / whole)[inner].sum()) for b in (0, 1)] for a in (0, 1)]
    return marginal, np.array(went)


@dataclass
class _Tokens:
    """Words of several texts: number of the distinct word and of the text, the distinct words, opening tokens."""

    word: np.ndarray
    text: np.ndarray
    distinct: list[bytes]
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _tokens(texts: Texts) -> _Tokens:
    begin, end, text = texts.words()
    _, at, word = np.unique(texts.hashes(begin, end), return_index=True, return_inverse=True)
    raw = texts.bytes.tobytes()
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    return _Tokens(word, text, [raw[begin[k] : end[k]] for k in at], first, begin, end)


def _evidence(marginal: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: one, the log of minus the log chance that no token is toxic, and the strongest token's log odds."""
    m = np.clip(marginal, 1e-9, 1 - 1e-9)
    total = np.bincount(text, -np.log1p(-m), n)
    top = np.full(n, 1e-9)
    np.maximum.at(top, text, m)
    return np.stack([np.ones(n), np.log(total + 1e-4), np.log(top) - np.log1p(-top)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, held near zero."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return w


def fit(texts: Sequence[str], toxic: Sequence[int]) -> Model:
    """Learn a model from labelled texts; without both classes the default scores all texts low."""
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model()
    tokens = _tokens(Texts(pa.array(texts, pa.large_string()), lower=True))
    features = [word_features(w) for w in tokens.distinct]
    seen = np.bincount(tokens.word, minlength=len(features)).tolist()
    total: Counter = Counter()
    for fs, n in zip(features, seen):
        for f in fs:
            total[f] += n
    # What occurs a few times teaches nothing.
    names = sorted(f for f, n in total.items() if n >= LEAST_SURROUNDINGS)
    number = {f: k for k, f in enumerate(names)}
    width = max(map(len, features), default=1)
    index = np.full((len(features), width), len(names))
    for k, fs in enumerate(features):
        known = [number[f] for f in fs if f in number]
        index[k, : len(known)] = known
    # Surroundings (word before and after) of a feature by class: copies of one text add none.
    around = np.zeros(len(tokens.word) + 2, np.int64)
    around[1:-1] = tokens.word + 1
    around = (around[:-2] * 1_000_003 + around[2:]) & ((1 << 40) - 1)
    per = []
    for c in (0, 1):
        mine = np.flatnonzero(y[tokens.text] == c)
        pairs = np.unique((index[tokens.word[mine]] << 40) | around[mine, None])
        per.append(np.bincount(pairs >> 40, minlength=len(names) + 1))
    n = [max(1, int((y[tokens.text] == c).sum())) for c in (0, 1)]
    least = max(LEAST_SURROUNDINGS, SUPPORT * (y == 1).sum())
    telling = (per[1] >= least) & (per[1] / n[1] >= LIFT * (per[0] + 0.5) / n[0])
    telling &= np.array([f[0] in "wb" for f in names] + [False])
    label = telling[index].any(axis=1)[tokens.word] & (y[tokens.text] == 1)
    # Every fourth text is kept back to learn the score from.
    apart = np.arange(len(texts)) % 4 == 3
    learn = ~apart[tokens.text]
    word, first, goal = tokens.word[learn], tokens.first[learn], label[learn].astype(float)
    counted = np.bincount(word, minlength=len(features))
    weights = np.zeros(len(names) + 1)
    bias, start, step = -4.0, np.zeros(2), np.zeros((2, 2))
    step_goal = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(step_goal, (goal[inner - 1].astype(int), goal[inner].astype(int)), 1)
    start_goal = np.array([(1 - goal[first]).sum(), goal[first].sum()])
    size = [np.zeros_like(x) for x in (weights, start, step)] + [0.0]
    for k in range(ROUNDS):
        by_word = weights[index].sum(axis=1) + bias
        marginal, went = forward_backward(by_word[word], first, start, step)
        gap = np.bincount(word, goal - marginal, len(features))
        slope = np.bincount(index.ravel(), np.repeat(gap, width), len(names) + 1) - PENALTY * counted.sum() * weights
        slope[-1] = 0
        slopes = [slope, start_goal - [(1 - marginal[first]).sum(), marginal[first].sum()], step_goal - went, gap.sum()]
        size = [FALLOFF * s + (1 - FALLOFF) * g * g for s, g in zip(size, slopes)]
        rate = 0.5 / (1 + k / 15)
        moves = [rate * g / (np.sqrt(s / (1 - FALLOFF ** (k + 1))) + 1e-3) for s, g in zip(size, slopes)]
        weights, start, step, bias = weights + moves[0], start + moves[1], step + moves[2], bias + moves[3]
    kept = {f: round(float(w), 4) for f, w in zip(names, weights) if abs(w) > 0.05}
    model = Model(kept, float(bias), start.tolist(), step.tolist())
    held = apart[tokens.text]
    rows = np.flatnonzero(apart)
    marginal = _marginals(model, tokens)
    evidence = _evidence(marginal[held], tokens.text[held], len(texts))[rows]
    model.score = _logistic(evidence, y[rows]).tolist()
    return model


def _marginals(model: Model, tokens: _Tokens) -> np.ndarray:
    get = model.weights.get
    by_word = np.array([sum(get(f, 0.0) for f in word_features(w)) for w in tokens.distinct] or [0.0]) + model.bias
    if not len(tokens.word):
        return np.zeros(0)
    return forward_backward(by_word[tokens.word], tokens.first, np.array(model.start), np.array(model.step))[0]


def learn_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE_DOCUMENTS`` labelled documents of either class, drawn by a hash of the id.

    Ids labelled twice count as toxic if any label says so.  The sample is picked
    from the labels alone, so no text is shuffled; one task fits the model, within
    ``SAMPLE_BYTES``, and only the model comes to the driver.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    draw = F.xxhash64("_id", F.lit("sample"))
    picked = [known.filter(F.col("_y") == c).orderBy(draw, "_id").limit(SAMPLE_DOCUMENTS) for c in (0, 1)]
    # Both lists are bounded by the parameter above.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text")).filter("_text IS NOT NULL")
    sample = texts.join(ids, "_id").dropDuplicates(["_id"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, total = [], 0
        for batch in batches:
            for one, y in zip(batch.column("_text").to_pylist(), batch.column("_y").to_pylist()):
                if total + len(one) <= SAMPLE_BYTES:
                    total += len(one)
                    taken.append((one, y))
        model = fit([t for t, _ in taken], [y for _, y in taken])
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model.__dict__)])], names=["model"])

    rows = sample.repartition(1).sortWithinPartitions(draw, "_id").select("_text", "_y").mapInArrow(train, "model string").collect()
    return Model(**json.loads(rows[0][0])) if rows else Model()


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """One row per document: the ``keep`` columns, ``score``, ``predicted`` and ``toxic_spans``.

    The score is between 0 and 1; null and empty texts get that of a text without
    evidence.  ``toxic_spans`` lists begin and end, in code points with the end
    outside, of the words whose marginal reaches ``threshold``, neighbours joined.
    Repeated rows are scored one by one; an empty table gives an empty result.
    Work is per row and whole texts are read; nothing is shuffled.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = Texts(batch.column("_text"), lower=True)
                tokens = _tokens(texts)
                marginal = _marginals(model, tokens)
                evidence = _evidence(marginal, tokens.text, texts.n)
                score = 1 / (1 + np.exp(-np.clip(evidence @ np.array(model.score), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep]
                    + [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                    + [pa.array(_spans(texts, tokens, marginal >= threshold), pa.list_(pa.list_(pa.int64())))],
                    names=[*keep, "score", "predicted", "toxic_spans"],
                )

    narrow = docs.select(*keep, docs[text].alias("_text"))
    return narrow.mapInArrow(judge, f"{fields}, score double, predicted int, toxic_spans array<array<long>>")


def _spans(texts: Texts, tokens: _Tokens, flagged: np.ndarray) -> list[list[list[int]]]:
    out: list[list[list[int]]] = [[] for _ in range(texts.n)]
    points = np.concatenate([[0], np.cumsum((texts.bytes & 0xC0) != 0x80)])
    before = -2
    for k in np.flatnonzero(flagged).tolist():
        mine = out[tokens.text[k]]
        offset = points[texts.offsets[tokens.text[k]]]
        begin, end = int(points[tokens.begin[k]] - offset), int(points[tokens.end[k]] - offset)
        if mine and before == k - 1:
            mine[-1][1] = end
        else:
            mine.append([begin, end])
        before = k
    return out

