"""Near-duplicates by an LSH forest over MinHash signatures.

After Bawa, Condie and Ganesan, *LSH Forest* (2005): every tree is one sorted
order of the signatures, and the candidates of a document are the neighbours that
share its longest prefixes.  How deep the prefix reaches follows from the density
of the region: among few documents neighbours meet at the least depth, in a crowd
only at a greater one.  Candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.graph import components
from recordloom.llm.spans import Texts, mix, shingle_sets, slices
from recordloom.session import settle

#: Sorted orders, hash values that neighbours must share at least, and values that an order looks at.
TREES, LEAST_DEPTH, DEPTH = 20, 3, 8
#: Orders of the first wave, in which a row meets only the next one, which has the longest common prefix.
FIRST_TREES = 4
#: Rows of a region that all meet each other at once; larger ones are a crowd.
REGION = 17
#: Rows of a crowd compared in one task, and their shingles; prefixes tried until a region has no more.
CROWD, CROWD_SHINGLES, CROWD_DEPTHS = 4096, 4_000_000, (3, 5, 8)
#: Rows compared at once, values of a sketch.
CROWD_BLOCK, SKETCH = 512, 1024
#: What the similarity of two cut sketches may be below that of the sets: six standard deviations.
CUT_SLACK = 0.08
VALUES = TREES * LEAST_DEPTH
#: Candidates with fewer equal values fall away: a pair at the threshold has 45 on average, and
#: fewer than 28 about once in a million.
LEAST_EQUAL = 28
#: Links need ``100 * intersection >= 75 * union``.
PERCENT = 75


def _signatures(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``VALUES`` minima per text, big-endian so that bytes sort like numbers."""
    out = np.zeros((n, VALUES), ">u4")
    if not len(shingles):
        return out
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)) | np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    present = owner[starts]
    for k in range(VALUES):
        values = ((shingles ^ seeds[2 * k]) * seeds[2 * k + 1] >> np.uint64(32)).astype(np.uint32)
        out[present, k] = np.minimum.reduceat(values, starts)
    return out


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit ``set_key`` equal for equal sets, the ``signature`` and its low bytes, ``brief``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = Texts(batch.column("_text"), lower=True)
                shingles, owner = shingle_sets(texts)
                sizes = np.bincount(owner, minlength=texts.n)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                key = np.zeros((texts.n, 2), np.uint64)
                for k in range(2):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(k * 0x9E3779B9 + 1)), dtype=np.uint64)])
                    key[:, k] = sums[ends[1:]] - sums[ends[:-1]]
                signature = _signatures(shingles, owner, texts.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(sizes.astype(np.int64))]
                    + [pa.array([row.tobytes() for row in table], pa.binary()) for table in (key, signature, signature.astype(np.uint8))],
                    names=["doc_id", "n_shingles", "set_key", "signature", "brief"],
                )

    narrow = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text"))
    return narrow.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, signature binary, brief binary")


#: A sorted row, which also comes out of its task where it lies at a border; what ``extra`` holds depends on the wave.
ROW = pa.schema(
    [("tree", pa.int32()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("rep", pa.int64()), ("group", pa.int64()), ("extra", pa.binary())]
)
PAIR = ["a", "b"]
PAIR_OR_ROW = "a long, b long, tree int, key binary, n_shingles long, rep long, group long, extra binary"


class Sorted:
    """Rows in sorted order, cut into regions: runs of one order that share the least depth."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.tree, self.n, self.rep, self.group = (rows.column(c).to_numpy() for c in ("tree", "n_shingles", "rep", "group"))
        key = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(-1, DEPTH)
        new = np.ones(len(self.tree), bool)
        new[1:] = (key[1:, :LEAST_DEPTH] != key[:-1, :LEAST_DEPTH]).any(axis=1) | (self.tree[1:] != self.tree[:-1])
        self.start = np.flatnonzero(new)
        self.region = np.cumsum(new) - 1
        self.end = np.append(self.start[1:], len(new))[self.region] if len(new) else np.zeros(0, np.int64)

    def others(self, reach: int, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of one region but different groups, up to ``reach`` places apart, the later at index ``fresh`` or beyond."""
        live = np.arange(len(self.tree))
        for k in range(1, reach + 1):
            live = live[self.end[live] > live + k]
            if not len(live):
                return
            at = live[(self.group[live] != self.group[live + k]) & (live + k >= fresh)]
            if len(at):
                yield at, at + k

    def extras(self, kind: str) -> list[np.ndarray]:
        return [np.frombuffer(e.as_buffer(), kind) for c in self.rows.column("extra").chunks for e in c]


def _pairs(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])])


def _alike(rows: Sorted, brief: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes fit and at least ``LEAST_EQUAL`` values of the signatures agree, told by their low bytes."""
    fits = 100 * np.minimum(rows.n[i], rows.n[j]) >= PERCENT * np.maximum(rows.n[i], rows.n[j])
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(fits)
    out[at] = (brief[i[at]] == brief[j[at]]).sum(axis=1) >= LEAST_EQUAL
    return out


def following(rows: Sorted, fresh: int, reach: int, some: np.ndarray | None = None) -> np.ndarray:
    """Promising pairs of rows up to ``reach`` apart; ``some`` marks the regions looked at, row by row."""
    brief = np.array(rows.extras("u1"), np.uint8).reshape(-1, VALUES)
    found = [np.zeros((2, 0), np.int64)]
    for i, j in rows.others(reach, fresh):
        i, j = (i, j) if some is None else (i[some[i]], j[some[i]])
        alike = _alike(rows, brief, i, j)
        found.append(_pairs(rows.rep, i[alike], j[alike]))
    return np.concatenate(found, axis=1)


def next_rows(rows: Sorted, fresh: int) -> np.ndarray:
    return following(rows, fresh, 1)


def region_or_crowd(rows: Sorted, fresh: int) -> np.ndarray:
    """Promising pairs within small regions; nodes of larger ones, unless they are one group, are paired with themselves."""
    if not len(rows.tree):
        return np.zeros((2, 0), np.int64)
    size = rows.end - rows.start[rows.region]
    pairs = following(rows, fresh, REGION - 1, size <= REGION)
    low, high = np.minimum.reduceat(rows.group, rows.start), np.maximum.reduceat(rows.group, rows.start)
    # What lies beyond these rows may be of another group.
    mixed = low != high
    mixed[[0, -1]] = True
    reps = np.unique(rows.rep[(size > REGION) & mixed[rows.region]])
    return np.concatenate([pairs, np.stack([reps, reps])], axis=1)


def _promising(group: np.ndarray, n: np.ndarray, sketch: list[np.ndarray], blocks: list[tuple]) -> Iterator[tuple]:
    """Pairs of rows whose groups differ and whose sketches are similar enough, from some pairs of blocks.

    ``group`` is looked at anew for every pair of blocks, so that rows may be united in between.
    """
    for i, j in blocks:
        names, sizes = np.unique(group[np.union1d(i, j)], return_counts=True)
        # Rows of the largest group needn't be compared with each other.
        large = group == names[sizes.argmax()]
        for left, right in ((i[~large[i]], j), (i[large[i]], j[~large[j]])):
            if len(left) and len(right):
                similar = _similar([sketch[k] for k in left], [sketch[k] for k in right], n[left], n[right])
                p, q = np.nonzero(similar & (group[left][:, None] != group[right]))
                yield left[p], right[q]


def _blocks(places: np.ndarray) -> list[np.ndarray]:
    return np.split(places, range(CROWD_BLOCK, len(places), CROWD_BLOCK))


def _within(places: np.ndarray) -> list[tuple]:
    blocks = _blocks(places)
    return [(i, j) for k, i in enumerate(blocks) for j in blocks[k:]]


def crowd_pairs(crowd: pa.Table) -> pa.Table:
    """All pairs of different groups whose sketches are similar enough, a block against a block at a time."""
    n, rep, group = (crowd.column(c).to_numpy() for c in ("n_shingles", "rep", "group"))
    sketch = [np.frombuffer(e.as_buffer(), "<u4") for c in crowd.column("sketch").chunks for e in c]
    found = [_pairs(rep, i, j) for i, j in _promising(group, n, sketch, _within(np.arange(len(rep))))]
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
    return pa.table([pa.array(c, pa.int64()) for c in pairs], names=PAIR)


def crowd_links(crowd: pa.Table) -> pa.Table:
    """Links, confirmed on full sets, that connect whatever the similar pairs of a crowd connect: fewer than there are rows.

    Rows of one ``part`` all meet each other; rows of two meet those of the other part only.
    Sketches, the smallest values of the sets, tell which pairs are worth a look.
    """
    n, rep, group, part = (crowd.column(c).to_numpy() for c in ("n_shingles", "rep", "group", "part"))
    sets = [s.values.to_numpy().view(np.uint64) for c in crowd.column("shingles").chunks for s in c]
    sketch = [(s[:SKETCH] >> np.uint64(32)).astype("<u4") for s in sets]
    own = np.unique(group, return_inverse=True)[1]
    parts = [np.flatnonzero(part == k) for k in np.unique(part)]
    blocks = _within(parts[0]) if len(parts) == 1 else [(i, j) for i in _blocks(parts[0]) for j in _blocks(parts[1])]
    links = [np.zeros((2, 0), np.int64)]
    for i, j in _promising(own, n, sketch, blocks):
        for a, b in zip(i, j):
            if own[a] != own[b] and _linked(sets[a], sets[b]):
                links.append(_pairs(rep, np.array([a]), np.array([b])))
                own[own == own[b]] = own[a]
    return pa.table([pa.array(c, pa.int64()) for c in np.concatenate(links, axis=1)], names=PAIR)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _in_regions(nodes: DataFrame) -> DataFrame:
    """Nodes in every order, with prefixes ``_p`` of some depths and whether the rows that share them ``_fit`` into a task.

    Rows of small regions have all met and are left out.
    """
    rows = nodes.select("rep", "n_shingles", "group", F.posexplode(_rotations(range(TREES))).alias("tree", "key"))
    for depth in CROWD_DEPTHS:
        rows = rows.withColumn(f"_p{depth}", F.substring("key", 1, 4 * depth))
        same = Window.partitionBy("tree", *[f"_p{d}" for d in CROWD_DEPTHS if d <= depth])
        fits = (F.count(F.lit(1)).over(same) <= CROWD) & (F.sum("n_shingles").over(same) <= CROWD_SHINGLES)
        rows = rows.withColumn(f"_fit{depth}", fits)
    least = Window.partitionBy("tree", f"_p{CROWD_DEPTHS[0]}")
    return rows.withColumn("_n", F.count(F.lit(1)).over(least)).filter(F.col("_n") > REGION).drop("key", "_n")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of regions with more than one group."""
    same = Window.partitionBy("tree", "region")
    several = F.min("group").over(same) != F.max("group").over(same)
    return rows.withColumn("_several", several).filter("_several").drop("_several")


def among_crowds(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of nodes in the crowded regions of all orders, of regions that a task can hold.

    The depth of a region follows its density: the prefix grows until the rows that
    share it are no more than ``CROWD`` with ``CROWD_SHINGLES`` at most, which one task
    compares.  What the deeper prefixes part meets in :func:`in_parts`.
    """
    region = F.coalesce(*[F.when(F.col(f"_fit{d}"), F.col(f"_p{d}")) for d in CROWD_DEPTHS])
    rows = _in_regions(nodes).select("rep", "n_shingles", "group", "tree", region.alias("region")).filter("region IS NOT NULL")
    placed = _mixed(rows).withColumn("part", F.lit(0).cast("long"))
    found = placed.join(sets, "rep").groupBy("tree", "region").applyInArrow(crowd_links, "a long, b long")
    return settle(found.distinct())


def in_parts(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of nodes in regions of the least depth that no task can hold: all rows of different groups meet.

    The rows of a region's largest group are dealt into parts by a hash, and so are
    the others; the others meet both, a pair of parts in a task.  So the work grows
    with the rows where most of them are one group by now, and with the product of
    the parts only where most differ.
    """
    least = CROWD_DEPTHS[0]
    large = _in_regions(nodes).filter(~F.col(f"_fit{least}"))
    rows = settle(_mixed(large.select("rep", "n_shingles", "group", "tree", F.col(f"_p{least}").alias("region"))))
    sizes = rows.groupBy("tree", "region", "group").agg(F.count(F.lit(1)).alias("_rows"), F.sum("n_shingles").alias("_shingles"))
    main = F.max_by(F.struct("group", "_rows", "_shingles"), F.struct("_rows", "group"))
    regions = sizes.groupBy("tree", "region").agg(main.alias("_main"), F.sum("_rows").alias("_rows"), F.sum("_shingles").alias("_shingles"))

    def parts(count: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(2 * count / CROWD), F.ceil(2 * shingles / CROWD_SHINGLES), F.lit(1)).cast("long")

    regions = settle(
        regions.select(
            "tree", "region", F.col("_main.group").alias("_group"), parts(F.col("_main._rows"), F.col("_main._shingles")).alias("_of_main"),
            parts(F.col("_rows") - F.col("_main._rows"), F.col("_shingles") - F.col("_main._shingles")).alias("_of_others"),
        )
    )
    other = F.col("group") != F.col("_group")
    place = F.xxhash64("rep")
    own = F.when(other, F.pmod(place, "_of_others")).otherwise(F.col("_of_others") + F.pmod(place, "_of_main"))
    last = F.col("_of_others") + F.when(other, F.col("_of_main")).otherwise(0) - 1
    met = rows.join(regions, ["tree", "region"]).withColumn("part", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dealt = met.select(
        "rep", "n_shingles", "group", "tree", "region", "part", F.least("part", "_with").alias("_low"), F.greatest("part", "_with").alias("_high")
    )
    found = dealt.join(sets, "rep").groupBy("tree", "region", "_low", "_high").applyInArrow(crowd_links, "a long, b long")
    return settle(found.distinct())


def _presence(sketches: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    flat = np.concatenate(sketches)
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    hit = values[at] == flat
    out = np.zeros((len(sketches), len(values)), np.float32)
    out[owner[hit], at[hit]] = 1
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of ``left`` are similar enough to which of ``right``, told by the smallest values of their sets.

    Whole sets are compared exactly.  Where one is cut, both are looked at up to the
    smaller of their last values.
    """
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(both), 8192):
        common += _presence(left, both[k : k + 8192]) @ _presence(right, both[k : k + 8192]).T

    def cuts(sketches: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.array([len(s) for s in sketches]) == sizes
        return whole, np.where(whole, np.uint32(0xFFFFFFFF), np.array([s[-1] for s in sketches], np.uint32))

    (whole, last), (also, until) = cuts(left, n), cuts(right, m)
    if whole.all() and also.all():
        total = n[:, None] + m
    else:
        total = np.stack([np.searchsorted(s, np.minimum(until, c), side="right") for s, c in zip(left, last)])
        total = total + np.stack([np.searchsorted(s, np.minimum(last, c), side="right") for s, c in zip(right, until)], axis=1)
    slack = np.where(whole[:, None] & also, 1e-4, CUT_SLACK)
    return common >= (PERCENT / 100 - slack) * (total - common)


def _matched(batches: Iterator[pa.RecordBatch], match: Callable[[Sorted, int], np.ndarray], reach: int) -> Iterator[pa.RecordBatch]:
    """Matches within a sorted partition; rows of its first and last region come out too, for those across its borders."""
    held, first, opening = ROW.empty_table(), ROW.empty_table(), True
    for whole in batches:
        for k in range(0, whole.num_rows, 4096):
            batch = pa.Table.from_batches([whole.slice(k, 4096)]).cast(ROW)
            fresh = held.num_rows
            rows = Sorted(pa.concat_tables([held, batch]).combine_chunks())
            pairs = match(rows, fresh)
            nothing = [pa.nulls(pairs.shape[1], field.type) for field in ROW]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs] + nothing, names=PAIR + ROW.names)
            if opening:  # all rows so far belong to one region
                end = int(rows.end[0])
                first = pa.concat_tables([first, rows.rows.slice(fresh, end - fresh)]).slice(0, reach)
                opening = end == rows.rows.num_rows and first.num_rows < reach
            last = max(int(rows.start[-1]), rows.rows.num_rows - reach)
            held = rows.rows.slice(last)
    border = pa.concat_tables([first, held])
    for rows in border.combine_chunks().to_batches():
        nothing = [pa.nulls(rows.num_rows, pa.int64())] * len(PAIR)
        yield pa.RecordBatch.from_arrays(nothing + rows.columns, names=PAIR + ROW.names)


def _rotations(trees: range) -> Column:
    """The prefix of the signature in every order."""
    return F.transform(
        F.array(*[F.lit(t) for t in trees]),
        lambda t: F.substring(F.concat("signature", "signature"), t * (4 * LEAST_DEPTH) + 1, F.lit(4 * DEPTH)),
    )


def in_orders(
    nodes: DataFrame, trees: range, extra: Column, match: Callable[[Sorted, int], np.ndarray], reach: int
) -> DataFrame:
    """What ``match`` finds among rows near each other in some orders: distinct pairs ``a < b``, and single nodes as ``a = b``.

    ``nodes`` have ``rep``, ``n_shingles``, ``signature``, ``group`` and what
    ``extra`` is made of.  Rows are spread by range over (order, prefix, id), so
    that no region has to fit into a task, and each task looks at neighbours only:
    the work grows with the rows, not with the square of a region.  Up to ``reach``
    rows of the regions at the borders of each range are matched afterwards, again
    by range until one task holds what is left.
    """
    rotated = F.posexplode(_rotations(trees)).alias("tree", "key")
    rows = nodes.select("rep", "n_shingles", "group", extra.alias("extra"), rotated).select(*ROW.names)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matched(batches, match, reach)

    order, found, parts, before = ["tree", "key", "rep"], None, 0, 0
    spread = rows.repartitionByRange(*order)
    while True:
        done = settle(spread.sortWithinPartitions(*order).mapInArrow(matched, PAIR_OR_ROW))
        pairs = done.filter("a IS NOT NULL").select(*PAIR)
        found = pairs if found is None else found.unionByName(pairs)
        border = done.filter("rep IS NOT NULL").select(*ROW.names).dropDuplicates(["tree", "rep"])
        left = border.count() if parts != 1 else 0
        if not left:
            break
        # A range holds many times its border rows, so these shrink from round to round.
        parts = max(1, left // (20 * reach + 10_000)) if not before or 2 * left < before else 1
        spread, before = border.repartitionByRange(parts, *order) if parts > 1 else border.repartition(1), left
    return settle(found.distinct())


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep`` and ``_text`` of some documents.

    Both sides are sorted by id whatever their size, so that a list of ids that has
    outgrown a broadcast changes nothing.
    """
    texts = docs.select(F.col("_id").alias("rep"), "_text").join(reps.hint("merge"), "rep", "left_semi")
    return texts.dropDuplicates(["rep"])


def shingle_table(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full shingle sets of the documents in ``pairs``: ``rep`` and ``shingles``, 64-bit numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = Texts(batch.column("_text"), lower=True)
                shingles, owner = shingle_sets(texts)
                cuts = np.searchsorted(owner, np.arange(texts.n + 1))
                packed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), packed], names=["rep", "shingles"])

    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    return _texts_of(docs, ends).mapInArrow(sets, "rep long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.filter(100 * common >= PERCENT * (F.size("_x") + F.size("_y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents link when ``100 * intersection >= 75 * union`` of their distinct
    five-word shingles (A-Z in lower case; the whole sequence where there are
    fewer words).  ``component_id`` is the smallest id reachable over links, and
    ``kept`` says that it is the document's own.  Null texts and texts without
    words have no shingles and link with nothing.  Rows without an id link with
    nothing either; their component is null and they are kept.  Rows that share an
    id count as one document.  An empty table gives an empty result.

    Equal sets are one node from the start, so copies cost nothing further.  First
    documents meet the next one in a few orders, which gathers most near copies; rows
    of one group pass each other by from then on.  Then all rows of a small region of
    any order meet.  Rows of larger regions are a crowd, such as pages of one template
    that differ too much to link: deeper prefixes part them, and in each part they
    are compared on their shingles in the task, which gives a forest of links.  What
    still differs in a region that was parted meets part by part, so no pair of a
    region is left out.
    """
    narrow = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text"))
    sketched = settle(sketches(narrow, "_id", "_text"))
    able = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "signature", "brief")]
    nodes = settle(able.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *firsts))
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    groups = links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def united(found: DataFrame) -> None:
        nonlocal links, groups
        if not found.isEmpty():
            links = links.unionByName(found)
            groups = settle(components(links))

    def linked(pairs: DataFrame) -> None:
        united(settle(confirm(pairs, settle(shingle_table(narrow, pairs)))))

    def grouped(reps: DataFrame | None = None) -> DataFrame:
        some = nodes if reps is None else nodes.join(reps, "rep", "left_semi")
        return some.join(groups, F.col("rep") == F.col("node"), "left").withColumn("group", F.coalesce("component", "rep"))

    linked(in_orders(grouped(), range(FIRST_TREES), F.col("brief"), next_rows, 1))
    met = in_orders(grouped(), range(TREES), F.col("brief"), region_or_crowd, REGION)
    linked(met.filter("a < b"))
    crowded = met.filter("a = b")
    if not crowded.isEmpty():
        sets = shingle_table(narrow, crowded)
        reps = crowded.select(F.col("a").alias("rep"))
        united(among_crowds(grouped(reps), sets))
        parted = settle(_in_regions(grouped(reps)).filter(~F.col(f"_fit{CROWD_DEPTHS[0]}")).select("rep").distinct())
        if not parted.isEmpty():
            united(in_parts(grouped(parted), sets))
    of_set = nodes.select("set_key", "rep").join(groups, F.col("rep") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "rep").alias("_component")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(of_set, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )

