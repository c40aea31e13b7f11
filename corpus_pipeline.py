"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and token encoding, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``docs`` as they are, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import boilerplate, bpe, mixing, neardup, quality
from recordloom.session import settle


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the hidden name of every column."""
    names = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(h).alias(c) for c, h in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands; null and empty texts go."""
    hidden, names = _hidden(docs)
    judged = quality.compression_quality(hidden, names["text"], list(names.values()))
    return _shown(judged.filter("kept"), names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate in their source; ``n_chars`` follows the text."""
    hidden, names = _hidden(docs)
    kept = boilerplate.drop_frequent_lines(hidden, F.col(names["source"]), F.col(names["text"]))
    kept = kept.withColumn(names["text"], F.col("_text"))
    if "n_chars" in names:
        changed = F.when(F.col("_n_dropped") > 0, F.length("_text")).otherwise(F.col(names["n_chars"]))
        kept = kept.withColumn(names["n_chars"], changed.cast(docs.schema["n_chars"].dataType))
    return _shown(kept, names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows without an id stay."""
    groups = settle(neardup.near_duplicates(docs).select(F.col("doc_id").alias("_id"), "kept"))
    # Rows that repeat an id are copies of one document, and one of them stays.
    often = settle(groups.filter("kept AND _id IS NOT NULL").groupBy("_id").count().filter("count > 1").select("_id"))
    gone = groups.filter("NOT kept").select("_id").unionByName(often).distinct()
    single = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    return single.unionByName(docs.join(often, docs["doc_id"] == often["_id"], "left_semi").dropDuplicates(["doc_id"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every turn in which the mix takes a document, in training order; unused documents go.

    The document in which a source's demand ends comes out whole.
    """
    hidden, names = _hidden(docs)
    order = [names["doc_id"], *[h for c, h in names.items() if c != "doc_id"]]
    mixed = mixing.curriculum(hidden, order, names["source"], names["text"])
    rows = mixed.select(*names.values(), F.explode("copies").alias("_copy")).withColumn("_position", F.col("_copy.position"))
    return _shown(mixing.in_training_order(rows, "_position"), names)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``round_trip``: whether decoding gives the text back."""
    digest = lambda text: F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    narrow = docs.select("doc_id", "text", digest("text").alias("_digest"))
    encoded = bpe.encode_decode(narrow, bpe.default_path(), keep=["doc_id", "_digest"])
    same = digest("decoded") == F.col("_digest")
    return encoded.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]
#: Compression and merging have no SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents that the stages keep, as often as the mix takes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
