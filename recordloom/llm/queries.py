"""The corpus queries, each beside the SQL it is checked with where SQL can state it."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    boilerplate, bpe, hardneg, infill, language, mixing, neardup, neighbours, pii, quality, sharding, tokenfile, toxicity,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register a function under its own name."""
    if fn is None:
        return functools.partial(query, sql=sql)
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder that sets documents aside for testing; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@query
def op1_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and compression verdict of every document."""
    judged = quality.compression_quality(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "ratio", "bad_chunk_share",
    )


@query
def op2_chain_field(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; a fifth of the documents is held out of learning."""
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = table(spark, folder, "documents").withColumn("held_out", held_out)
    labels = table(spark, folder, "labels").filter(~held_out)
    model = toxicity.learn_model(docs.filter(~F.col("held_out")), labels)
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id", "held_out"])
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s[0], s[1])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", spans.alias("toxic_spans"))


@query
def op3_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op4_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, 24 shards of near equal bytes."""
    placed = sharding.balanced_shards(table(spark, folder, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op5_rank_order_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a fourth of the documents is held out of learning."""
    docs = table(spark, folder, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    profiles = language.learn_profiles(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language.identify_language(docs, profiles, keep=["doc_id", "held_out"])


@query
def op6_speculate_and_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return bpe.digests(bpe.encode_decode(table(spark, folder, "documents"), bpe.default_path()))


@query
def op7_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document, in order of first training position."""
    mixed = mixing.curriculum(table(spark, folder, "documents"))
    first = F.try_element_at(F.col("copies")["position"], F.lit(1))
    return mixing.in_training_order(mixed.withColumn("position", first)).select("doc_id", "size", "source_size", "target", "taken", "position")


LINE_SQL = r"""
WITH seen AS (
    SELECT page_id, html,
           nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
           regexp_replace(regexp_replace(regexp_replace(html,
               '<script.*?</script>|<style.*?</style>|<head.*?</head>|<!--.*?-->', '', 'gis'),
               '</?(p|div|li|ul|ol|h[1-6]|tr|td|table|br|nav|header|footer|article|section|blockquote)\b[^>]*>', chr(10), 'gi'),
               '<[^>]*>', '', 'g') AS body
    FROM pages
), split AS (
    SELECT page_id, host, row_number() OVER () AS id, string_split(body, chr(10)) AS lines FROM seen
), line AS (
    SELECT page_id, host, id, lines IS NULL AS absent, unnest(coalesce(lines, [NULL])) AS line,
           generate_subscripts(coalesce(lines, [NULL]), 1) AS n FROM split
), bare AS (
    SELECT *, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS key FROM line
), often AS (
    SELECT host, key FROM bare WHERE key <> '' AND host IS NOT NULL GROUP BY host, key
    HAVING count(DISTINCT id) >= 3
       AND count(DISTINCT id) > 0.1 * (SELECT count(*) FROM split s WHERE s.host = bare.host)
), marked AS (
    SELECT b.*, o.key IS NOT NULL AS gone FROM bare b LEFT JOIN often o ON b.host = o.host AND b.key = o.key
)
SELECT page_id, any_value(host) AS host, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
       CASE WHEN NOT bool_or(absent) THEN md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) END AS kept_md5
FROM marked GROUP BY id, page_id
"""


@query(sql=LINE_SQL)
def op8_site_relative_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every page without the lines that are boilerplate on its host."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    kept = boilerplate.drop_frequent_lines(pages, boilerplate.url_host(F.col("url")), boilerplate.html_lines(F.col("html")))
    return kept.select(
        "page_id", F.col("_host").alias("host"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.md5(F.col("_text").cast("binary")).alias("kept_md5"),
    )


NEAREST_SQL = """
WITH valid AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM valid q JOIN valid c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5
"""


@query(sql=NEAREST_SQL)
def op9_block_matrix_join(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors)


@query
def op10_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[pii.n_of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.as_text("base").cast("binary"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"),
    )


@query
def op11_ranked_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from token files."""
    read = tokenfile.round_trip(table(spark, folder, "documents"), tokenfile.default_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


INFILL_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
    FROM documents
), drawn AS (
    SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM cut
), parted AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), pieces AS (
    SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
           array_to_string(tokens[b + 1:], '') AS suffix
    FROM parted
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""


@query(sql=INFILL_SQL)
def op12_roaring_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it."""
    made = infill.fill_in_middle(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


NEGATIVE_SQL = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM valid a JOIN valid c ON c.vec_id <> a.vec_id
    WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query(sql=NEGATIVE_SQL)
def op13_segment_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the five positives of every hundredth vector; a seventh of the labels is shifted first."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", shifted)
    return hardneg.hard_negatives(rows, lambda vec_id: vec_id % 100 == 0)
