"""Hard negatives by segment summary filtering.

A vector is cut into segments, and of each only the mean and the deviation are
looked at first.  Over a segment of m components the product of two vectors lies
within m times the product of the means, plus or minus m times the product of the
deviations (Cauchy and Schwarz).  The sums over all segments bound the score; what
the bounds of a few wide segments cannot rule out is bounded again on the narrower
ones inside them, and what is left gets its exact score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import settle

#: Narrowest segments of a vector, and how many of them a wider one holds from one level to the next.
SEGMENTS, FAN = 16, 4
#: A component becomes so many steps, rounded down.
STEPS = 256
#: Most rows of a block of anchors or candidates; least of one that is made for the sake of more tasks.
ANCHOR_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK = 4096, 50_000, 1024
#: Anchors and candidates compared at once, and the share of pairs beyond which they are scored as a whole.
ANCHOR_STRIPE, CANDIDATE_STRIPE, CROWDED = 256, 4096, 0.02
#: Whole numbers that double precision holds exactly.
EXACT = float(1 << 53)
ANY_LOW, ANY_HIGH = -(1 << 63), (1 << 63) - 1
FIELDS = ["id", "label", "width", "codes", "summary"]


def usable(vector: Column) -> Column:
    """Vectors that are not null and whose components are all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def segment_edges(width: int) -> np.ndarray:
    """Starts of the narrowest segments, near equal in length, and the end."""
    return np.linspace(0, width, min(SEGMENTS, width) + 1).astype(np.int64)


def summarise(codes: np.ndarray) -> np.ndarray:
    """Mean and deviation of every segment, rows by segments by 2."""
    edges = segment_edges(codes.shape[1])
    if len(edges) < 2:
        return np.zeros((len(codes), 0, 2), "<f4")
    x, m = codes.astype(np.float64), np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / m
    rest = x - np.repeat(mean, m, axis=1)
    return np.stack([mean, np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / m)], axis=2).astype("<f4")


def levels(summary: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths, means and deviations from the widest segments to the narrowest; wider ones follow from narrower."""
    m, mean, deviation = np.diff(segment_edges(width)).astype(np.float64), *np.moveaxis(summary.astype(np.float64), 2, 0)
    out = [(m, mean, deviation)]
    while len(m) > 1:
        at = np.arange(0, len(m), FAN)
        joint = np.add.reduceat(m, at)
        square = np.add.reduceat(m * (mean * mean + deviation * deviation), at, axis=1) / joint
        mean = np.add.reduceat(m * mean, at, axis=1) / joint
        m, deviation = joint, np.sqrt(np.maximum(square - mean * mean, 0.0))
        out.append((m, mean, deviation))
    return out[::-1]


def unpacked(codes: pa.Array, width: int) -> np.ndarray:
    """Codes of all rows; those of a row are 16 or 32 bits wide."""
    narrow, wide = 2 * width, 4 * width
    raw = [c.as_buffer() for c in codes]
    out = np.zeros((len(raw), width), np.int32)
    for size, kind in ((narrow, "<i2"), (wide, "<i4")):
        at = [k for k, b in enumerate(raw) if b.size == size]
        if at and width:
            out[at] = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(-1, width)
    return out


class Rows:
    """Rows of one width: distinct (label, codes) with the smallest ids of each."""

    def __init__(self, table: pa.Table, most_ids: int | None = None):
        table = table.combine_chunks()
        self.width = table.column("width")[0].as_py()
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.codes = unpacked(table.column("codes").chunk(0), self.width)
        raw = b"".join(c.as_buffer() for c in table.column("summary").chunk(0))
        self.summary = np.frombuffer(raw, "<f4").reshape(len(self.ids), min(SEGMENTS, self.width), 2)
        if most_ids is not None:
            self._distinct(most_ids)

    def _distinct(self, most_ids: int) -> None:
        """One row for equal ones; ``ids`` are then the ids of row k from ``cuts[k]`` to ``cuts[k + 1]``."""
        whole = np.ascontiguousarray(np.concatenate([self.labels[:, None].astype(np.int64).view("<i4"), self.codes], axis=1))
        _, first, which = np.unique(whole.view(f"V{4 * whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((self.ids, which))
        which = which[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        order, which = order[place < most_ids], which[place < most_ids]
        self.ids, self.cuts = self.ids[order], np.searchsorted(which, np.arange(len(first) + 1))
        self.labels, self.codes, self.summary = self.labels[first], self.codes[first], self.summary[first]


def _exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Products of all rows of ``a`` with all of ``b``, none of which is beyond ``most``."""
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _scores(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, possible: int, most: float) -> np.ndarray:
    """Products of the row pairs ``at`` and ``to``; by one matrix product where they are many of ``possible``."""
    if len(at) > CROWDED * possible:
        rows, at = np.unique(at, return_inverse=True)
        columns, to = np.unique(to, return_inverse=True)
        return _exact(a[rows], b[columns], most)[at, to]
    out = np.zeros(len(at), np.int64)
    for k in range(0, len(at), CANDIDATE_STRIPE):
        part = slice(k, k + CANDIDATE_STRIPE)
        out[part] = np.einsum("ij,ij->i", a[at[part]].astype(np.int64), b[to[part]].astype(np.int64))
    return out


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of every (anchor, window) among rows of anchor, window, score, id: highest score, then smallest id."""
    order = np.lexsort((found[3], -found[2], found[1], found[0]))
    found = found[:, order]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    group = np.cumsum(new) - 1
    return found[:, np.arange(len(new)) - np.flatnonzero(new)[group] < k] if len(new) else found


def search_tile(anchors: Rows, low: np.ndarray, high: np.ndarray, rows: Rows, k: int, same_label: bool) -> np.ndarray:
    """For every anchor and window of scores the ``k`` best rows: anchor, window, score, id.

    ``rows`` are distinct, ``low`` and ``high`` anchors by windows, both included.
    """
    a_levels, b_levels = levels(anchors.summary, anchors.width), levels(rows.summary, rows.width)
    length = lambda level: np.sqrt((level[0] * (level[1] ** 2 + level[2] ** 2)).sum(axis=1))
    a_length, b_length = length(a_levels[-1]), length(b_levels[-1])
    most = 1.01 * float(a_length.max(initial=0) * b_length.max(initial=0)) + 1
    done = []
    for start in range(0, len(anchors.ids), ANCHOR_STRIPE):
        some = np.arange(start, min(start + ANCHOR_STRIPE, len(anchors.ids)))
        lows, highs = low[some], high[some]
        best, floor = np.zeros((4, 0), np.int64), lows.copy()
        for begin in range(0, len(rows.codes), CANDIDATE_STRIPE):
            part = np.arange(begin, min(begin + CANDIDATE_STRIPE, len(rows.codes)))
            needed, allowed = floor.min(axis=1).astype(np.float64), highs.max(axis=1).astype(np.float64)
            fits = (anchors.labels[some][:, None] == rows.labels[part]) == same_label
            possible = fits.size
            at, to = np.nonzero(fits)
            #: What single precision summaries and double precision sums may be off.
            slack = 1e-5 * a_length[some][at] * b_length[part][to] + 1e-3
            for (m, mean_a, dev_a), (_, mean_b, dev_b) in zip(a_levels, b_levels):
                if len(at) > CROWDED * possible:
                    middle = ((m * mean_a[some]) @ mean_b[part].T)[at, to]
                    around = ((m * dev_a[some]) @ dev_b[part].T)[at, to] + slack
                else:
                    x, y = some[at], part[to]
                    middle = (m * mean_a[x] * mean_b[y]).sum(axis=1)
                    around = (m * dev_a[x] * dev_b[y]).sum(axis=1) + slack
                stay = (middle + around >= needed[at]) & (middle - around <= allowed[at])
                at, to, slack = at[stay], to[stay], slack[stay]
            score = _scores(anchors.codes[some], rows.codes[part], at, to, possible, most)
            stay = (score >= floor.min(axis=1)[at]) & (score <= highs.max(axis=1)[at])
            at, to, score = at[stay], to[stay], score[stay]
            many = rows.cuts[part[to] + 1] - rows.cuts[part[to]]
            which = np.repeat(np.arange(len(to)), many)
            owned = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            ids = rows.ids[rows.cuts[part[to]][which] + owned]
            at, score = at[which], score[which]
            other = ids != anchors.ids[some][at]
            at, score, ids = at[other], score[other], ids[other]
            fresh = [best]
            for window in range(lows.shape[1]):
                within = (score >= lows[at, window]) & (score <= highs[at, window])
                fresh.append(np.stack([at[within], np.full(within.sum(), window), score[within], ids[within]]))
            best = _best(np.concatenate(fresh, axis=1), k)
            # The k-th best of a window is the least that can still enter it.
            last = np.flatnonzero(np.append((best[:2, 1:] != best[:2, :-1]).any(axis=0), True)) if best.size else []
            full = [p for p in last if p >= k - 1 and (best[:2, p - k + 1] == best[:2, p]).all()]
            floor[best[0, full], best[1, full]] = best[2, full]
        best[0] = some[best[0]]
        done.append(best)
    return np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)


def prepared(rows: DataFrame, vec_id: str, vector: str, label: str, steps: int) -> DataFrame:
    """``id``, ``label``, ``width``, ``codes`` and ``summary`` of the rows that take part, one row per id."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                x = np.floor(steps * x.astype(np.float64))
                part = part.filter(pa.array(fits := (np.abs(x).max(axis=1, initial=0) < 2.0**31) & ((x * x).sum(axis=1) < 2.0**63)))
                x = x[fits].astype("<i4")
                narrow = np.abs(x).max(axis=1, initial=0) < 1 << 15
                codes = [(row.astype("<i2") if short else row).tobytes() for row, short in zip(x, narrow)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("width"), pa.array(codes, pa.binary())], names=FIELDS[:4]
                )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                summary = [row.tobytes() for row in summarise(unpacked(part.column("codes"), int(width)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(summary, pa.binary())], names=FIELDS)

    narrow = rows.select(
        rows[vec_id].cast("long").alias("id"), rows[label].cast("long").alias("label"), rows[vector].cast("array<double>").alias("vector")
    )
    good = narrow.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).withColumn("width", F.size("vector"))
    coded = good.mapInArrow(code, "id long, label long, width int, codes binary")
    one = coded.groupBy("id").agg(F.min(F.struct("label", "width", "codes")).alias("row")).select("id", "row.*")
    return settle(one.mapInArrow(describe, "id long, label long, width int, codes binary, summary binary"))


def _tiles(
    anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], k: int, same_label: bool, percent: tuple[int, int]
) -> DataFrame:
    """``id``, ``window``, ``score`` and ``found`` of the ``k`` best of every pair of blocks; ``anchors`` may hold ``positives``."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides come from one table; new columns on the left keep the two apart in the cogroup.
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("q", block(blocks[0])).withColumn("c", every(blocks[1]))
    right = rows.withColumn("c", block(blocks[1])).withColumn("q", every(blocks[0]))

    def bound(score: int | None, share: int, none: int) -> int:
        """Least whole number not below ``share`` percent of ``score``."""
        return none if score is None else -(-share * score // 100)

    def tile(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found = np.zeros((4, 0), np.int64)
        if asked.num_rows and offered.num_rows:
            some = Rows(asked)
            if same_label:
                low, high = np.full((len(some.ids), 1), ANY_LOW), np.full((len(some.ids), 1), ANY_HIGH)
            else:
                scores = asked.column("positives").to_pylist()
                widest = max(map(len, scores))
                scores = [[*s, *[None] * (widest - len(s))] for s in scores]
                # An empty place is a window that nothing fits.
                low = np.array([[bound(x, percent[0], ANY_HIGH) for x in s] for s in scores], np.int64)
                high = np.array([[bound(x, percent[1], ANY_LOW) for x in s] for s in scores], np.int64)
            found = search_tile(some, low, high, Rows(offered, k + 1), k, same_label)
            found[0] = some.ids[found[0]]
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["id", "window", "score", "found"])

    keys = ["width", "label", "q", "c"] if same_label else ["width", "q", "c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "id long, window long, score long, found long")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    steps: int = STEPS,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    A row's score is its product with the anchor over components ``floor(steps *
    x)``.  The positives of an anchor, a row for whose id ``is_anchor`` holds, are its ``n_positives`` best other rows of its label; the negatives
    of a positive are the ``n_negatives`` best rows of other labels whose scores
    lie between ``low_percent`` and ``high_percent`` of the positive's.  Higher
    scores come first, and of ties the smaller id.  Fewer rows are all returned; an
    anchor without positives, and a positive without negatives, has no row.

    Rows with a null id, label, vector or component or a non-finite component take
    no part, nor do those whose squared length is 2^63 or more, as their scores
    would not fit; rows that repeat an id count once, the one of the least label,
    width and codes.  Vectors of different width never meet; empty vectors have
    scores of 0.  An empty table gives an empty result.

    Rows are dealt into blocks by a hash of the id, so a label or vector that many
    rows share is spread; anchors are copied to every block of candidates.  Blocks
    are bounded, and per anchor a block returns a bounded number of rows.
    """
    table = prepared(rows, vec_id, vector, label, steps)
    chosen = table.filter(is_anchor(F.col("id")))
    n_rows, n_anchors = table.count(), chosen.count()
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    wanted = max(-(-n_rows // CANDIDATE_BLOCK), min(tasks, -(-n_rows // least_block)), 1)
    blocks = (max(1, -(-n_anchors // ANCHOR_BLOCK)), wanted)
    percent = (low_percent, high_percent)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    same = first(_tiles(chosen, table, blocks, n_positives, True, percent), n_positives, "id")
    positives = settle(same.select("id", "rank", "found", "score"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "score")))
    listed = positives.groupBy("id").agg(F.transform(in_order, lambda p: p["score"]).alias("positives"))
    negatives = _tiles(chosen.join(listed, "id"), table, blocks, n_negatives, False, percent)
    ranked = first(negatives, n_negatives, "id", "window")
    names = {"id": "anchor_id", "found": "positive_id", "score": "positive_score"}
    of = positives.withColumn("_window", F.col("rank") - 1).drop("rank").withColumnsRenamed(names)
    return ranked.join(of, (F.col("id") == F.col("anchor_id")) & (F.col("window") == F.col("_window"))).select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
