"""Corpus operators against plain versions, on a given table and on awkward rows."""

import os
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from recordloom.llm import boilerplate, bpe, graph, language, mixing, neardup, neighbours, pii, quality, queries, sharding, toxicity  # noqa: E402
from recordloom.llm.spans import Texts  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{k * 7919 % 3001}" for k in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n \r\f\v", "en", None),
    (6, "Mail joe@x.org or +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.1 🙂 é", "fr", "b"),
    (7, LONG, "en", "c"),
    (8, "spam ham " * 40, "de", "c"),
    (9, "one\ntwo\none\n\n two \none", "de", "b"),
    (None, "no id here but words enough to count as a text of ten", "en", "a"),
    (10, "1 2 3 !? <|endoftext|> don't   stop \u0085x", "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("kept", "score", "_text", "_id", "component_id", "size", "n_words", "_host", "copies", "a", "rep", "key", "range", "word")


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def served(monkeypatch, **tables):
    """Let the queries read these frames."""
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])


def judge_quality(rows, source):
    got = sorted(map(str, ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)))
    want = []
    for _, text, *_ in source:
        base = plain.base_counts(text)
        good = not base[-1] and plain.in_bands(text, quality.CHUNK, quality.CHUNK_SHARE, quality.DOCUMENT_BANDS, quality.CHUNK_BANDS)
        want.append(str((*base, good)))
    assert got == sorted(want)


def test_quality(spark, documents, awkward, empty, monkeypatch):
    judge_quality(queries.op1_compression_bands(spark, FOLDER).collect(), documents)
    served(monkeypatch, documents=awkward)
    judge_quality(queries.op1_compression_bands(spark, FOLDER).collect(), ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op1_compression_bands(spark, FOLDER).collect() == []


def test_bands_reject_noise_and_repetition(spark):
    rng = np.random.default_rng(3)
    noise = " ".join("".join(map(chr, rng.integers(0x100, 0x3000, 12))) for _ in range(300))
    repeat = " ".join(f"alpha{k % 7} beta gamma{k} delta" for k in range(900))
    rows = spark.createDataFrame([(1, noise), (2, repeat), (3, ROWS[0][1])], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.compression_quality(rows).collect()}
    assert kept == {1: kept[1], 2: False, 3: True}


def test_chain_against_all_labellings():
    rng = np.random.default_rng(0)
    e, first, start, step = rng.normal(size=9) * 2, np.zeros(9, bool), rng.normal(size=2), rng.normal(size=(2, 2))
    first[[0, 4, 5]] = True
    total, marginal, went = 0.0, np.zeros(9), np.zeros((2, 2))
    for code in range(512):
        y = [(code >> t) & 1 for t in range(9)]
        w = np.exp(sum(e[t] * y[t] + (start[y[t]] if first[t] else step[y[t - 1], y[t]]) for t in range(9)))
        total += w
        marginal += w * np.array(y)
        for t in range(9):
            if not first[t]:
                went[y[t - 1], y[t]] += w
    got, got_went = toxicity.forward_backward(e, first, start, step)
    assert np.allclose(got, marginal / total) and np.allclose(got_went, went / total)


def test_chain_over_rows_longer_than_one():
    rng = np.random.default_rng(1)
    e, first = rng.normal(size=2000), rng.random(2000) < 0.002
    first[0] = True
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    whole, _ = toxicity.forward_backward(e, first, start, step)
    cuts = [*np.flatnonzero(first), 2000]
    parts = [toxicity.forward_backward(e[a:b], np.arange(b - a) == 0, start, step)[0] for a, b in zip(cuts, cuts[1:])]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity(spark, awkward, empty, monkeypatch):
    """Held-out documents of the larger given table are told apart; awkward rows get scores."""
    larger = FOLDER.replace("sf0.001", "sf0.01")
    rows = queries.op2_chain_field(spark, larger).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95
    few = spark.createDataFrame([(1, 0), (1, 1), (2, None), (6, 0)], "doc_id long, toxic int")
    for docs, n in ((awkward, len(ROWS)), (empty, 0)):
        served(monkeypatch, documents=docs, labels=few)
        rows = queries.op2_chain_field(spark, FOLDER).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxic_spans_are_code_points():
    model = toxicity.Model({"w vile": 12.0}, -6.0, score=[-3.0, 1.0, 1.0])
    import pyarrow as pa

    texts = Texts(pa.array(["é 🙂 vile VILE! fine", None, "vile"]), lower=True)
    tokens = toxicity._tokens(texts)
    assert toxicity._spans(texts, tokens, toxicity._marginals(model, tokens) > 0.5) == [[[4, 14]], [], [[0, 4]]]


def judge_components(rows, source):
    texts = {i: t for i, t, *_ in source if i is not None}
    component, size = plain.components(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], size[r.doc_id], component[r.doc_id] == r.doc_id)
    assert len(rows) == len(source)


def test_near_duplicates(spark, documents, awkward, empty, monkeypatch):
    judge_components(queries.op3_lsh_forest(spark, FOLDER).collect(), documents)
    served(monkeypatch, documents=awkward)
    judge_components(queries.op3_lsh_forest(spark, FOLDER).collect(), ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op3_lsh_forest(spark, FOLDER).collect() == []


def test_near_duplicates_in_crowds(spark):
    """A large group of near copies, a chain of edits, and links at the very threshold."""
    rng = np.random.default_rng(5)
    text = [f"w{k}" for k in range(60)]
    rows, at = [], 0
    for _ in range(400):
        copy = list(text)
        copy[rng.integers(60)] = f"x{rng.integers(10**6)}"
        rows.append((at, " ".join(copy)))
        at += 1
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        chain[k * 8] = f"e{k}"
        rows.append((at, " ".join(chain)))
        at += 1
    for n in range(60):  # 39 shingles of one end in a union of 52: exactly three quarters
        body = [f"t{n}_{k}" for k in range(56)]
        rows += [(at, " ".join(body)), (at + 1, " ".join(body[:43]))]
        at += 2
    judge_components(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1064)] + [(2000, 2000 + k) for k in range(200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def judge_shards(rows, source, shards=24):
    slots, bytes_ = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((str(r.doc_id), r.size, str(r.text_crc32)) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, str(None if t is None else zlib.crc32(t.encode()))) for i, t, *_ in source
    )
    mean = sum(bytes_.values()) / shards
    largest = max((r.size for r in rows), default=0)
    assert all(abs(b - mean) <= largest + mean / 16 for b in bytes_.values())


def test_shards(spark, documents, awkward, empty, monkeypatch):
    judge_shards(queries.op4_sampled_splitters(spark, FOLDER).collect(), documents)
    served(monkeypatch, documents=awkward)
    assert len(queries.op4_sampled_splitters(spark, FOLDER).collect()) == len(ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op4_sampled_splitters(spark, FOLDER).collect() == []


def test_shards_with_a_third_of_copies(spark):
    rows = [(k, "the same text over and over" if k % 3 == 0 else f"text {k} " * (k % 9 + 1)) for k in range(9000)]
    judge_shards(sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect(), rows)


def test_language(spark, awkward, empty, monkeypatch):
    larger = FOLDER.replace("sf0.001", "sf0.01")
    rows = queries.op5_rank_order_profiles(spark, larger).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) >= 0.98
    served(monkeypatch, documents=awkward)
    got = [(r.doc_id, r.lang_pred) for r in queries.op5_rank_order_profiles(spark, FOLDER).collect()]
    assert len(got) == len(ROWS) and all(p == "und" for i, p in got if i in (3, 4, 5))
    served(monkeypatch, documents=empty)
    assert queries.op5_rank_order_profiles(spark, FOLDER).collect() == []


def test_grams_against_counting():
    texts = ["Zu und die", None, "", "a", "été à l'île 42", "x y\nz"]
    owner, gram, n = language.document_grams(texts, language._Letters())
    for k, text in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        want = Counter(
            g for w in words for size in (1, 2, 3) for g in (f" {w} "[j : j + size] for j in range(len(w) + 3 - size))
            if g.strip() and " " not in g[1:-1]
        )
        codes = {sum(ord(c) << (21 * j) for j, c in enumerate(reversed(g))): v for g, v in want.items()}
        assert dict(zip(gram[owner == k].tolist(), n[owner == k].tolist())) == codes


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(bpe.default_path())
    made.no_truncation()
    made.no_padding()
    return made


def judge_tokens(rows, source):
    made, want = tokenizer(), []
    for i, text, *_ in source:
        ids = made.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((str(i), len(ids), bpe_sha(packed), plain.sha256(made.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def bpe_sha(data):
    import hashlib

    return hashlib.sha256(data).hexdigest()


def test_tokens(spark, documents, awkward, empty, monkeypatch):
    judge_tokens(queries.op6_speculate_and_verify(spark, FOLDER).collect(), documents)
    served(monkeypatch, documents=awkward)
    judge_tokens(queries.op6_speculate_and_verify(spark, FOLDER).collect(), ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op6_speculate_and_verify(spark, FOLDER).collect() == []


def test_tokens_of_random_text():
    rng = np.random.default_rng(4)
    letters = list("aabbcdeeethhiinn  \n\t'sldmré ñ日本🙂0123!!??...---===____\u0085\x1c")
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 777 + "x", "ab" * 900, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y'll"]
    codec, made = bpe.Codec(bpe.vocabulary_text(bpe.default_path())), tokenizer()
    ids = codec.encode(texts)
    for text, got in zip(texts, ids):
        want = made.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text[:50]
        assert codec.decode(got).decode() == made.decode(want, skip_special_tokens=False)
    assert 0 < codec.repaired < codec.speculated


def judge_mix(rows, source):
    size = lambda t: len(plain.WORD.findall(t or ""))
    sizes = Counter()
    for _, text, _, src in source:
        sizes[src] += size(text)
    goal = plain.targets(sizes)
    by_goal, want = defaultdict(int), Counter((str(i), size(t), sizes[s]) for i, t, _, s in source)
    assert Counter((str(r.doc_id), r.size, r.source_size) for r in rows) == want
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by_goal[r.source_size, round(r.target, 6)] += r.taken
    expected = defaultdict(float)
    for s in sizes:
        expected[sizes[s], round(goal[s], 6)] += goal[s]
    assert by_goal.keys() == expected.keys() and all(abs(by_goal[k] - expected[k]) <= len(sizes) for k in by_goal)


def test_mix(spark, documents, awkward, empty, monkeypatch):
    rows = queries.op7_curriculum_mix(spark, FOLDER).collect()
    judge_mix(rows, documents)
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and rows == queries.op7_curriculum_mix(spark, FOLDER).collect()
    served(monkeypatch, documents=awkward)
    judge_mix(queries.op7_curriculum_mix(spark, FOLDER).collect(), ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op7_curriculum_mix(spark, FOLDER).collect() == []


def test_training_positions_invert_the_schedule(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))
    shares = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.training_position(F.col("s"), knots).alias("t"))
    areas = np.cumsum([0.0] + [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])])
    for s, t in df.collect():
        k = max(j for j in range(4) if knots[j][0] <= t)
        (t0, d0), (t1, d1) = knots[k], knots[k + 1]
        x = t - t0
        assert abs((areas[k] + d0 * x + (d1 - d0) / (t1 - t0) * x * x / 2) / areas[-1] - s) < 1e-9


def test_lines(spark, awkward, empty):
    rows = [(f"h{k % 3}", "\n".join(["menu", f"text {k}", "", "  menu ", f"half {k % 2}"])) for k in range(30)] + [(None, "menu\nx"), ("h0", None), ("h9", "menu")]
    df = spark.createDataFrame(rows, "host string, text string")
    got = boilerplate.drop_frequent_lines(df, F.col("host"), F.col("text"), 0.4, 3).collect()
    want = plain.without_frequent_lines(rows, 0.4, 3)
    assert sorted((str(r.host), str(r.text), str(r._text)) for r in got) == sorted((str(h), str(t), str(w)) for (h, t), w in zip(rows, want))
    hidden = awkward.drop("_text", "_host")
    assert boilerplate.drop_frequent_lines(hidden, F.col("source"), F.col("text")).count() == len(ROWS)
    assert boilerplate.drop_frequent_lines(empty.drop("_text", "_host"), F.col("source"), F.col("text")).count() == 0


def test_html_lines(spark):
    page = "<head><title>t</title></head><nav><ul><li>A</li><li>B</li></ul></nav><script>var p='</p>';</script><p>x <b>y</b><br>z<!-- c -->"
    df = spark.createDataFrame([(page, "HTTPS://www.A.org:80/x"), (None, "nothing")], "html string, url string")
    got = df.select(boilerplate.html_lines(F.col("html")).alias("t"), boilerplate.url_host(F.col("url")).alias("h")).collect()
    assert [x for x in got[0].t.split("\n") if x] == ["A", "B", "x y", "z"]
    assert got[0].h == "www.a.org" and got[1].t is None and got[1].h is None


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)]
    vectors += [(1000 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(150)] + [(3000 + 50 * k, vectors[k][1]) for k in range(5)]
    vectors += [(5000, None), (5050, [0.0] * 6), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5150, [float("nan")] * 6), (5200, [float("inf")] * 6), (5250, []), (None, [1.0] * 6), (5300, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + [vectors[0]], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df.filter("vec_id % 50 = 0"), df, query_block=4, candidate_block=60).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors[:455]}
    want = []
    for q, x in good.items():
        if q % 50 == 0:
            scored = [(float(neighbours.cosine(x[None], y[None])[0]), i) for i, y in good.items() if i != q]
            want += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scored, key=lambda p: (-p[0], p[1]))[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert neighbours.nearest(df.limit(0), df).collect() == [] and neighbours.nearest(df.filter("vec_id = 0"), df.limit(0)).collect() == []


HARD = [
    "🙂 a@b.co, 1.2.3.4.5.6.7.8 +1 (555) 123-4567 🙂 256.1.1.1", "a@b.c+d@e.f", "@@ a@b a@b.", "1-2-3 4 5--6 7", "++1 222 333 4444",
    "ab" * 3000, "1" * 3000, "9 " * 2000, "a." * 2000 + "@x.y", "é@x.com x@é.com a@b.c.d..e 00.1.2.03", "1.2.3 1.2.3.4",
    "5500005555555559 5500005555555559 ", "4111-1111-1111-1111-", "+1.-.-.-2 123456789 3", "x4111111111111111y", "1234567.1.1.1 1.1.1.0000255",
]


def test_personal_data(spark, documents, awkward, empty, monkeypatch):
    rows = documents + [(10**6 + k, t, None, None) for k, t in enumerate(HARD)] + [r for r in ROWS if r[0] is not None]
    more = spark.createDataFrame(rows, SCHEMA)
    served(monkeypatch, documents=more)
    texts = {r[0]: r[1] for r in rows if r[0] < 100 or r[0] >= 10**6} | {r[0]: r[1] for r in documents if r[0] >= 100}
    for r in queries.op10_weak_supervision(spark, FOLDER).collect():
        options = {plain.base_spans(t) for i, t, *_ in rows if i == r.doc_id}
        spans = next((s for s in options if plain.sha256(s) == r.base_sha256), None)
        assert spans is not None, (r, texts.get(r.doc_id))
        kinds = Counter(s.split(":")[0] for s in spans.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))
    served(monkeypatch, documents=awkward)
    assert queries.op10_weak_supervision(spark, FOLDER).count() == len(ROWS)
    served(monkeypatch, documents=empty)
    assert queries.op10_weak_supervision(spark, FOLDER).collect() == []


def test_personal_data_added_by_the_method(spark):
    rows = [(k, f"write to joe{k}@mail.com or call +1 (555) 123-{4000 + k}") for k in range(40)]
    rows += [(100, "call (555) 555-1234 now or mail bob [at] example [dot] com"), (101, "order 555.123.4567=x")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.as_text("base").alias("base"), pii.as_text("spans").alias("spans")).collect()}
    assert got[100].base == "" and got[100].spans == "phone:5:19,email:32:58"


def test_labelers_are_weighed():
    soft = pii.estimate([((1, 1, 1), 500), ((1, 1, -1), 40), ((-1, -1, 1), 60), ((-1, -1, -1), 400), ((1, -1, 0), 3)])
    assert soft[1, 1, 1] > 0.99 and soft[1, 1, -1] > 0.9 and soft[-1, -1, 1] < 0.1 and soft[-1, -1, -1] < 0.01
    assert pii.estimate([]) == {}


def run_pipeline_plainly(spark, docs):
    """The pipeline over (doc_id, text, source) rows; the mix's order comes from the same hash."""
    rows = []
    for i, text, _, source in docs:
        if not plain.base_counts(text)[-1] and plain.in_bands(text, quality.CHUNK, quality.CHUNK_SHARE, quality.DOCUMENT_BANDS, quality.CHUNK_BANDS):
            rows.append((i, text, source))
    lines = plain.without_frequent_lines([(s, t) for _, t, s in rows], boilerplate.RATIO, boilerplate.LEAST_PAGES)
    rows = [(i, t, s) for (i, _, s), t in zip(rows, lines)]
    component, _ = plain.components({i: t for i, t, _ in rows if i is not None})
    rows = list({(i, t, s): None for i, t, s in rows if i is None or component[i] == i})
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain.WORD.findall(t))
    goal = plain.targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.xxhash64("doc_id", "text"))
    number = -(-len(rows) // mixing.ROWS_PER_SLICE)
    place, out = Counter(), []
    for r in sorted(df.collect(), key=lambda r: (r.h % number, r.h)):
        n = len(plain.WORD.findall(r.text))
        out += [r.doc_id] * sum(n > 0 and k * sizes[r.source] + place[r.source] < int(goal[r.source] + 0.5) for k in range(3))
        place[r.source] += n
    return Counter(out)


def test_pipeline(spark, documents, awkward):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r.doc_id for r in rows) == run_pipeline_plainly(spark, documents)
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in rows)
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.schema.simpleString() == awkward.schema.simpleString(), name
    left = corpus_pipeline.token_stage(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in left} <= {1, 6, 7, 9, 10, None} and all(r.round_trip for r in left)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, awkward, empty, stage):
    assert stage(spark, awkward, FOLDER).count() > 0
    assert stage(spark, empty, FOLDER).count() == 0
