"""Crowds larger than a task: no pair of a region is left out, and links are a forest."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_crowd import judge, template_pages

from recordloom.llm import neardup


def chain(n: int) -> list[tuple[int, str]]:
    """Texts that are similar to their neighbours only."""
    words = [f"w{k}" for k in range(n * 5 + 100)]
    return [(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(n)]


def components(pairs: set[tuple[int, int]], n: int) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def test_parts_of_one_region_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 24)
    docs = spark.createDataFrame(chain(120), "_id long, _text string")
    # One signature for all: no prefix parts the region.
    nodes = docs.select(
        F.col("_id").alias("rep"), F.lit(56).cast("long").alias("n_shingles"), F.lit(bytes(4 * neardup.VALUES)).alias("signature"), F.col("_id").alias("group")
    )
    reps = nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = neardup.shingle_table(docs, reps)
    assert neardup.among_crowds(nodes, sets).count() == 0
    # Half of them are one group already: of these only the last has to meet the others.
    for united in (0, 60):
        some = nodes.withColumn("group", F.when(F.col("group") < united, 0).otherwise(F.col("group")))
        found = {(r.a, r.b) for r in neardup.in_parts(some, sets).collect()}
        assert {(k, k + 1) for k in range(max(united - 1, 0), 119)} == found


def test_crowds_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 48)
    assert judge(spark, template_pages(300, 5)) > 20


def test_heavy_texts_are_parted_too(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD_SHINGLES", 20_000)
    assert judge(spark, template_pages(80, 6, words=1500, most=0.03)) > 20


def test_links_of_a_crowd_are_a_forest():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate([rng.choice(base, len(base) - 4, False), rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for _ in range(700)]
    sets += [np.sort(rng.integers(0, 1 << 63, 59, dtype=np.uint64)) for _ in range(50)]
    n = len(sets)
    table = pa.table(
        {
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "rep": pa.array(np.arange(n)), "group": pa.array(np.arange(n)),
            "part": pa.array(np.zeros(n, np.int64)), "shingles": pa.array([s.view(np.int64) for s in sets]),
            "sketch": pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
        }
    )
    pairs = {tuple(r.values()) for r in neardup.crowd_pairs(table).to_pylist()}
    links = {tuple(r.values()) for r in neardup.crowd_links(table).to_pylist()}
    assert len(pairs) > 100_000 and links <= pairs and len(links) == 699
    assert components(links, n) == [0] * 700 + list(range(700, n))
