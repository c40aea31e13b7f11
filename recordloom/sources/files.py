"""Delimited, JSON and Parquet scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.operators.conform import stack_by_name
from recordloom.sources import landing

# Declared schemas: reading needs no inference job per file.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    separator: str | None = None,
    encoding: str | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """Delimited files with a header line and a declared schema.

    Separator and encoding that are not given are told for every file by itself, so
    one folder may hold files of several kinds; files of one kind are read together.
    Fields that do not fit the schema become null rather than failing the load;
    ``corrupt`` names a column that then holds the whole line.
    """
    wide = schema if corrupt is None else StructType(list(schema.fields)).add(corrupt, "string")
    options = {"header": True, "mode": "PERMISSIVE", "schema": wide}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    if separator and encoding:
        return spark.read.csv(path, sep=separator, encoding=encoding, **options)
    known = landing.file_settings(landing.lines_of(spark, path), (separator,) if separator else landing.SEPARATORS)
    kinds = known.groupBy("separator", "encoding").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("separator", "encoding")
    found = [(k.separator, encoding or k.encoding, k.files) for k in kinds.collect()] or [(separator or ",", encoding or "UTF-8", path)]
    return stack_by_name([spark.read.csv(of, sep=sep, encoding=enc, **options) for sep, enc, of in found])


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON-lines files with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", encoding: str = "UTF-8", mark: bool = False) -> str:
    """Delimited files with a header line; ``mark`` puts the byte-order mark before it that office programs expect."""
    marked = df.toDF("\ufeff" + df.columns[0], *df.columns[1:]) if mark else df
    marked.write.csv(path, header=True, sep=separator, encoding=encoding, mode="overwrite")
    return path


def write_by(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """Parquet partitioned by ``by``; only the partitions present in ``df`` are replaced.

    The rebalance hint gathers each partition value in few files and still lets AQE
    split a value that holds a third of the rows over many tasks.
    """
    spread = df.hint("rebalance", *by)
    spread.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return path


def rewrite(df: DataFrame, folder: str, version: int) -> DataFrame:
    """Write a corrected table as a new version beside the old one and read it back.

    A job cannot overwrite the files it is reading, so each rewrite is a version.
    """
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_list(catalogue: DataFrame, urls: str = "urls") -> DataFrame:
    """One row per category and year out of a catalogue with a year-to-address map.

    Keys such as ``2020_v2`` mark several files of one year.
    """
    others = [c for c in catalogue.columns if c != urls]
    listed = catalogue.select(*others, F.explode(urls).alias("edition", "url"))
    return listed.withColumn("year", F.regexp_extract("edition", r"^(\d{4})", 1).try_cast("int"))


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (as in the lines read from it), ``path`` and ``length`` of every file below ``path``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("_metadata.file_path").alias("file"), "path", "length")


def plan_loads(catalogue: DataFrame, landed: DataFrame) -> DataFrame:
    """What to load: every edition of a catalogue and every landed file with its ``status``.

    ``catalogue`` comes from :func:`source_list` (``category``, ``edition``,
    ``year``, ``url``), ``landed`` has a ``file`` per row.  They meet by the file's
    name, decoded and in lower case.  Of several editions of one category and year
    that have landed the last (by name) is ``planned``, the others are ``doubled``;
    so are further files of one name, and all but the first category that claims a file.  ``missing`` editions have not landed;
    ``extra`` files are in no catalogue.  Category and year of a file come from here.
    """
    name = lambda address: F.lower(landing.landed_name(address))
    editions = catalogue.select("category", "edition", "year", name(F.col("url")).alias("name"))
    copies = Window.partitionBy("name").orderBy("file")
    files = landed.select("file").distinct().withColumn("name", name(F.col("file"))).withColumn("_copy", F.row_number().over(copies))
    met = editions.join(files, "name", "full")
    here = F.col("category").isNotNull() & F.coalesce(F.col("_copy") == 1, F.lit(False))
    newest = Window.partitionBy("category", "year").orderBy((~here).cast("int"), F.desc("edition"))
    place = F.when(F.col("category").isNotNull(), F.row_number().over(newest))
    met = met.withColumn("_chosen", here & (place == 1))
    claim = F.row_number().over(Window.partitionBy("file").orderBy((~F.col("_chosen")).cast("int"), "category"))
    status = (
        F.when(F.col("category").isNull(), "extra").when(F.col("file").isNull(), "missing")
        .when(F.col("_chosen") & (claim == 1), "planned").otherwise("doubled")
    )
    return met.withColumn("status", status).select("name", "file", "category", "edition", "year", "status")


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count of every source file behind a file-based frame."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def project_json(df: DataFrame, column: str, schema: str, fields: Mapping[str, str]) -> DataFrame:
    """Parse a JSON text column and take ``fields`` (new name to path) out of it."""
    parsed = df.withColumn("_json", F.from_json(column, schema))
    picked: list[Column] = [F.col(f"_json.{path}").alias(name) for name, path in fields.items()]
    return parsed.select(*[c for c in df.columns if c != column], *picked)
