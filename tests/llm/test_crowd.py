"""Near-duplicates in crowds: pages of one template that mostly differ too much to link."""

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import neardup


def template_pages(n: int, seed: int, words: int = 300, most: float = 0.04) -> list[tuple[int, str]]:
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 4000, words)]
    rows = []
    for k in range(n):
        page = list(base)
        for at in np.flatnonzero(rng.random(words) < rng.uniform(0.004, most)):
            page[at] = f"own{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(page)))
    return rows


def true_groups(rows: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """Smallest id of every document's group, and the number of links."""
    sets = []
    for _, text in rows:
        words = text.split()
        sets.append({tuple(words[j : j + 5]) for j in range(len(words) - 4)})
    number: dict = {}
    of = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    often = np.bincount(np.concatenate(of)) > 1
    place = np.cumsum(often) - 1
    present = np.zeros((len(rows), int(often.sum())), np.float32)
    for k, s in enumerate(of):
        present[k, [place[x] for x in s if often[x]]] = 1
    size = np.array([len(s) for s in sets])
    common = present @ present.T
    linked = 100 * common >= 75 * (size[:, None] + size - common)
    np.fill_diagonal(linked, True)
    group = np.arange(len(rows))
    while True:
        least = np.where(linked, group[None, :], len(rows)).min(axis=1)
        if (least == group).all():
            break
        group = least
    return {rows[k][0]: rows[g][0] for k, g in enumerate(group)}, int(np.triu(linked, 1).sum())


def judge(spark, rows):
    want, links = true_groups(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = sum(got[i] != g for i, g in want.items())
    assert wrong == 0, f"{wrong} of {len(rows)} rows wrong, {links} links"
    return links


def test_crowd_of_a_template(spark):
    assert judge(spark, template_pages(600, 1)) > 100


def test_two_crowds_and_copies(spark):
    rows = template_pages(200, 2) + [(1000 + k, t) for k, t in template_pages(150, 3, words=2500, most=0.02)]
    rows += [(5000 + k, t + f" {k}") for k, (_, t) in enumerate(rows[:60])]
    assert judge(spark, rows) > 60


def sorted_rows(rng, n: int, width: int = 10) -> pa.Table:
    """Rows of few prefixes, so that regions are long, with a group and a set each."""
    tree = np.sort(rng.integers(0, 2, n))
    key = np.zeros((n, neardup.DEPTH), ">u4")
    key[:, 0] = rng.integers(0, 3, n)
    order = np.lexsort((key[:, 0], tree))
    sets = [np.unique(rng.integers(0, 14, width)).astype("<u4") for _ in range(n)]
    return pa.table(
        [
            pa.array(tree[order], pa.int32()), pa.array([k.tobytes() for k in key[order]], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array(np.arange(n)), pa.array(rng.integers(0, n // 3, n)), pa.array([s.tobytes() for s in sets], pa.binary()),
        ],
        schema=neardup.ROW,
    )


@pytest.mark.parametrize("batch", [1, 7, 64, 1000])
def test_neighbours_do_not_depend_on_batches(batch):
    rng = np.random.default_rng(batch)
    rows = sorted_rows(rng, 300)
    sets = [set(np.frombuffer(e, "<u4").tolist()) for e in rows.column("extra").to_pylist()]
    tree, key, group = (rows.column(c).to_pylist() for c in ("tree", "key", "group"))
    want = {
        (i, j)
        for i in range(300) for j in range(i + 1, 300)
        if tree[i] == tree[j] and key[i] == key[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    got, border = set(), set()

    def similar(rows: neardup.Sorted, fresh: int) -> np.ndarray:
        pairs = [(int(a), int(b)) for i, j in rows.others(300, fresh) for a, b in zip(rows.rep[i], rows.rep[j])]
        kept = [p for p in pairs if 100 * len(sets[p[0]] & sets[p[1]]) >= 75 * len(sets[p[0]] | sets[p[1]])]
        return np.array(kept, np.int64).reshape(-1, 2).T

    for out in neardup._matched(iter(rows.to_batches(batch)), similar, 300):
        for row in out.to_pylist():
            if row["a"] is None:
                border.add(row["rep"])
            else:
                got.add((row["a"], row["b"]))
    assert got == want
    ends = [k for k in range(300) if (tree[k], key[k]) in ((tree[0], key[0]), (tree[-1], key[-1]))]
    assert border == set(ends)


def test_crowd_pairs_are_all_similar_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 18, 12)).astype("<u4") for _ in range(1300)]
    group = np.where(rng.random(1300) < 0.6, 5000, rng.integers(0, 400, 1300))
    table = pa.table(
        [pa.array([len(s) for s in sets], pa.int64()), pa.array(np.arange(1300)), pa.array(group), pa.array([s.tobytes() for s in sets], pa.binary())],
        names=["n_shingles", "rep", "group", "sketch"],
    )
    got = {tuple(r.values()) for r in neardup.crowd_pairs(table).to_pylist()}
    present = np.zeros((1300, 18), int)
    for k, s in enumerate(sets):
        present[k, s] = 1
    common, size = present @ present.T, present.sum(axis=1)
    similar = (100 * common >= 75 * (size[:, None] + size - common)) & (group[:, None] != group)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(similar, 1)))} and len(got) > 100


def test_cut_sketches_tell_similarity_within_the_slack():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.75, 0.9, 1.0):
        both = rng.integers(0, 1 << 63, int(20_000 * share), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, 20_000 - len(both), dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(neardup.mix(np.concatenate([both, o]))) for o in own]
        similarity = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        cut = [(s[: neardup.SKETCH] >> np.uint64(32)).astype("<u4") for s in sets]
        sizes = [np.array([len(s)]) for s in sets]
        told = bool(neardup._similar(cut[:1], cut[1:], *sizes)[0, 0])
        if similarity >= 0.75 or similarity < 0.75 - 2 * neardup.CUT_SLACK:
            assert told == (similarity >= 0.75)
