"""Token files, fill-in-the-middle and hard negatives against plain versions, on a given table and on awkward rows."""

import hashlib
import os
import re
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom.llm import hardneg, infill, queries, tokenfile  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{k * 7919 % 3001}\n" for k in range(180_000))
ROWS = [
    (1, "The quick brown fox, it's 42 don't"),
    (2, None),
    (3, ""),
    (4, " \t\n \r\f\v"),
    (5, "é́   ǅ ΑΣ Σ ﬁ 🙂🙂 \u0085x\x1cy z"),
    (5, "é́   ǅ ΑΣ Σ ﬁ 🙂🙂 \u0085x\x1cy z"),
    (5, "another text of the same id"),
    (6, "a <P> marker <|endoftext|> and x<|startoftext|>y"),
    (7, LONG),
    (8, "x" * 3000),
    (9, "1234567890" * 20_000),
    (None, "no id"),
    (None, None),
    (-3, "negative id < P> <S <M"),
]
CLASHES = ("_id", "_text", "_row", "_ids", "n", "form", "output", "start", "part", "id", "width", "codes", "q", "c", "rank")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def served(monkeypatch, **tables):
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def plain_tokens(rows):
    """doc_id, ids in file order, as far as that is defined: rows of one id come in any order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfile.default_path())
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


def judge_tokens(got, rows):
    got = sorted(map(tuple, got), key=lambda r: r[1])
    ends = np.cumsum([r[2] for r in got]).tolist()
    assert [r[1] for r in got] == [0, *ends][: len(got)]
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = [(i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for i, ids in plain_tokens(rows)]
    assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, want))


def test_token_files(spark, awkward, monkeypatch):
    judge_tokens(queries.op11_ranked_token_files(spark, FOLDER).collect(), given(spark))
    served(monkeypatch, documents=awkward)
    judge_tokens(queries.op11_ranked_token_files(spark, FOLDER).collect(), ROWS)
    served(monkeypatch, documents=awkward.limit(0))
    assert queries.op11_ranked_token_files(spark, FOLDER).collect() == []


def test_token_files_of_many_rows_of_one_id(spark, tmp_path):
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("doc "), F.col("id")).alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_token_files(docs.repartition(7), str(tmp_path), tokenfile.default_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = tokenfile.read_token_files(spark, str(tmp_path))
    rows = read.orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert spark.read.parquet(f"{tmp_path}/blocks").select("part").distinct().count() > 1
    listed = spark.read.parquet(f"{tmp_path}/dictionary").orderBy("rank").collect()
    assert [(r.n, -r.id) for r in listed] == sorted(((r.n, -r.id) for r in listed), reverse=True)
    assert sum(r.n for r in listed) == sum(r.n_tokens for r in rows)


def test_packing_keeps_values_of_every_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)
        values = np.concatenate([values, [0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]]).astype(np.uint32)
        control, data = tokenfile.pack(values)
        assert len(control) == -(-len(values) // 4)
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
        assert (tokenfile.unpack(control, data, len(values)) == values).all()
    assert len(tokenfile.unpack(*tokenfile.pack(np.zeros(0, np.uint32)), 0)) == 0


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 50)
    monkeypatch.setattr(tokenfile, "PIECE", 64)
    with open(tokenfile.default_path(), encoding="utf-8") as f:
        words = tokenfile.WordIds(f.read())
    text = LONG[:20_000] + "y" * 200 + "\x0b" + "z" * 70
    got = np.frombuffer(words.encode(text.encode()), words.type).tolist()
    assert len(words.words) <= 50 and words.known_steps
    assert [*got, 1] == plain_tokens([(0, text)])[0][1]


def test_words_prepared_here_are_as_the_tokenizer_has_them():
    with open(tokenfile.default_path(), encoding="utf-8") as f:
        text = f.read()
    words = tokenfile.WordIds(text)
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in [*range(1, 0x250), 0x300, 0x301, 0x307, 0x3A3, 0x1F600, 0x2126, 0xFB01, 0x2002]] + ["'s", "'LL", "don't", "<|endoftext|>"] * 4
    texts = ["".join(rng.choice(signs, rng.integers(1, 12))) for _ in range(6000)] + signs + ["x" + s + "y" for s in signs]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(words.encode(t.encode()), words.type).tolist() for t in texts] == want
    other = tokenfile.WordIds(text.replace('"Lowercase"', '"NFKC"'))
    assert not other.known_steps and other._word(b"ABC") == np.array(other._ids("ABC"), other.type).tobytes()


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, sizes, output = "plain", (None, None), text
    else:
        sizes = (len(prefix), len(middle))
        form, output = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 20 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *sizes, sha(output), sha(text))


def test_infill(spark, awkward, monkeypatch):
    got = sorted(map(str, map(tuple, queries.op12_roaring_infill(spark, FOLDER).collect())))
    assert got == sorted(str(plain_infill(*row)) for row in given(spark))
    # Awkward texts under many ids, so that every form and place of the cuts comes up.
    many = [(None if i is None else i + 100 * k, t) for i, t in ROWS for k in range(1 if t and len(t) > 100_000 else 40)]
    rows = spark.createDataFrame(many, "doc_id long, text string").crossJoin(F.broadcast(awkward.drop("doc_id", "text").limit(1)))
    served(monkeypatch, documents=rows)
    got = sorted(map(str, map(tuple, queries.op12_roaring_infill(spark, FOLDER).collect())))
    assert got == sorted(str(plain_infill(*row)) for row in many)
    served(monkeypatch, documents=awkward.limit(0))
    assert queries.op12_roaring_infill(spark, FOLDER).collect() == []


def test_every_container_selects():
    rng = np.random.default_rng(1)
    cases = {
        "ArrayContainer": np.flatnonzero(rng.random(65_536) < 0.02),
        "BitmapContainer": np.flatnonzero(rng.random(65_536) < 0.4),
        "RunContainer": np.concatenate([np.arange(10, 9000), np.arange(20_000, 65_536)]),
    }
    for name, values in cases.items():
        made = infill.container(values)
        assert type(made).__name__ == name
        assert [made.select(k) for k in range(len(values))] == values.tolist()
    values = np.concatenate([v + (k << 16) for k, v in zip((0, 1, 4), cases.values())])
    whole = infill.RoaringSet(values)
    assert len(whole) == len(values)
    some = [0, len(values) - 1, *rng.integers(0, len(values), 500).tolist()]
    assert [whole.select(k) for k in some] == values[some].tolist()


def plain_negatives(rows):
    """Rows of one id must be equal but for the label, and components small."""
    valid = {}
    for i, v, y in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0)):
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            y = (y + 1) % 10 if i % 7 == 0 else y
            valid[i] = min(valid.get(i, (y,)), (y, *[int(np.floor(256 * float(np.float32(x)))) for x in v]), key=lambda t: t[0])
    out = []
    for a, (label, *codes) in valid.items():
        if a % 100:
            continue
        scores = [(sum(x * y for x, y in zip(codes, c)), i, y) for i, (y, *c) in valid.items() if i != a and len(c) == len(codes)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            found = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a, i, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def awkward_vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 20))
    rows = [(k, (centre[k % 6] * 0.1 + 0.05 * rng.normal(size=20)).tolist(), k % 3) for k in range(1200)]
    rows += [(2000 + k, rows[100][1], k % 4) for k in range(700)]  # one vector on a third of the rows, of several labels
    rows += [(1, rows[1][1], 1), (1, rows[1][1], 2), (2000, rows[100][1], 3)]  # repeated ids
    rows += [(3000, None, 1), (3100, [0.1] * 19 + [None], 1), (3200, [float("nan")] * 20, 1), (3300, [float("inf")] + [0.1] * 19, 2)]
    rows += [(3400, [0.1] * 20, None), (None, [0.1] * 20, 1), (3500, [], 1), (3501, [], 1), (3502, [], 2), (3600, [0.0] * 20, 1)]
    rows += [(3700, [0.5, 0.25, 0.125], 1), (3701, [0.5, 0.25, 0.125], 1), (3702, [0.5, 0.25, 0.12], 2), (3800, [-0.2] * 20, 5)]
    return rows + [(-100, rows[7][1], -4), (-105, rows[7][1], -4), (-107, rows[7][1], 4)]


def test_hard_negatives(spark, monkeypatch):
    given_rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op13_segment_summaries(spark, FOLDER).collect())) == plain_negatives(given_rows)
    rows = awkward_vectors()
    served(monkeypatch, embeddings=vectors(spark, rows))
    want = plain_negatives(rows)
    assert sorted(map(tuple, queries.op13_segment_summaries(spark, FOLDER).collect())) == want
    served(monkeypatch, embeddings=vectors(spark, rows).limit(0))
    assert queries.op13_segment_summaries(spark, FOLDER).collect() == []


def test_hard_negatives_in_small_blocks(spark):
    rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in awkward_vectors() if i is not None and y is not None]
    got = hardneg.hard_negatives(vectors(spark, rows), lambda i: i % 100 == 0, least_block=60).collect()
    assert sorted(map(tuple, got)) == plain_negatives(awkward_vectors())


def test_scores_too_large_for_a_long_take_no_part(spark):
    rows = [(100, [1e30, 1.0], 1), (101, [0.5, 0.5], 1), (200, [1000.0, 5e5], 1), (201, [1001.0, 5e5], 1), (202, [1000.0, 4.9e5], 2)]
    got = hardneg.hard_negatives(vectors(spark, rows), lambda i: i % 100 == 0).collect()
    codes = {i: [int(256 * x) for x in v] for i, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(codes[a], codes[b]))
    assert [tuple(r) for r in got] == [(200, 201, 1, 202, dot(200, 201), dot(200, 202))]


@pytest.mark.parametrize("width", [1, 3, 16, 37, 64])
def test_bounds_hold_at_every_level(width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-200, 200, (30, width)) for _ in range(2))
    exact = a @ b.T
    last = None
    for (m, mean_a, dev_a), (_, mean_b, dev_b) in zip(*[hardneg.levels(hardneg.summarise(x), width) for x in (a, b)]):
        middle, around = (m * mean_a) @ mean_b.T, (m * dev_a) @ dev_b.T + 1.0
        assert (exact <= middle + around).all() and (exact >= middle - around).all()
        assert last is None or (around <= last + 1.0).mean() > 0.5
        last = around
    assert m.sum() == width
