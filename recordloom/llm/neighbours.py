"""Nearest neighbours by a block matrix join over int8 codes.

Queries and candidates are dealt into blocks, and every pair of blocks is one
tile.  In a tile the product of the codes gives each cosine up to an error bound;
what the bound cannot rule out is computed again from the original vectors, in
double precision, and heaps keep the best.  No neighbour is lost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query block and of a candidate block, and candidates multiplied at once.
QUERY_BLOCK, CANDIDATE_BLOCK, STRIPE = 2048, 20_000, 4096


def usable(vector: Column) -> Column:
    """Vectors with a direction: not null, not empty, all components finite, not all zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arrays), -1)


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, the lengths of the coded vectors, and of the rest."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    rest = x - coded
    return code, scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, components summed from first to last."""
    dot, p, q = (np.cumsum(v, axis=1)[:, -1] for v in (a * b, a * a, b * b))
    return dot / np.sqrt(p * q)


def _search_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """The ``k`` best of the candidates for every query, as (query, id, score)."""
    # Equal vectors have equal scores, and of those only the smallest ids can be among the k best others.
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, which = np.unique(vectors.view(f"V{8 * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by_vector = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[by_vector], np.arange(len(first) + 1))
    owners = [np.unique(ids[by_vector[a:b]])[: k + 1] for a, b in zip(cuts, cuts[1:])]
    distinct = vectors[first]
    code, scale, length, rest = _codes(distinct)
    q_code, q_scale, q_length, q_rest = _codes(queries)
    q_code = q_code.astype(np.float32)
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    # One place more than wanted, as the query's own vector may take one.
    floor = np.full((len(queries), k + 1), -np.inf)
    for at in range(0, len(distinct), STRIPE):
        part = slice(at, at + STRIPE)
        # Sums of products of int8 codes are whole numbers that single precision holds exactly up to 1,040 components.
        wide = np.float32 if queries.shape[1] <= 1040 else np.float64
        product = q_code.astype(wide) @ code[part].astype(wide).T
        near = product * q_scale[:, None] * scale[None, part]
        error = q_length[:, None] * rest[None, part] + q_rest[:, None] * (length + rest)[None, part] + 1e-6
        low = np.concatenate([floor, near - error], axis=1)
        floor = -np.partition(-low, k, axis=1)[:, : k + 1]
        rows, columns = np.nonzero(near + error >= floor.min(axis=1)[:, None])
        exact = cosine(queries[rows], distinct[part][columns])
        for row, column, score in zip(rows.tolist(), columns.tolist(), exact.tolist()):
            heap = heaps[row]
            for other in owners[at + column].tolist():
                if other != query_ids[row]:
                    entry = (score, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
    return [(int(q), -i, s) for q, heap in zip(query_ids, heaps) for s, i in heap]


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest candidates of every query by cosine.

    Ties go to the smaller id; a candidate with the query's own id is left out,
    and rows that repeat an id count once.  Vectors that are null, empty or zero or
    hold null or non-finite components take no part, nor do rows without an id;
    vectors of different length never meet.  Fewer candidates than ``k`` are all
    returned; empty tables give an empty result.

    A query is copied once per block of candidates and the reverse, so what is
    shuffled grows with rows times blocks and no task holds more than two blocks.
    """
    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(df[vec_id].cast("long").alias("id"), df[vector].alias("vector"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("width", F.size("vector"))

    asked, offered = prepared(queries).dropDuplicates(["id"]), prepared(candidates)
    q_blocks = max(1, -(-asked.count() // query_block))
    c_blocks = max(1, -(-offered.count() // candidate_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.withColumn("q", block(q_blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = offered.withColumn("c", block(c_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def tile(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and offered.num_rows:
            found = _search_tile(
                asked.column("id").to_numpy(), _matrix(asked.column("vector")),
                offered.column("id").to_numpy(), _matrix(offered.column("vector")), k,
            )
        columns = list(zip(*found)) or [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    keys = ["width", "q", "c"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
