"""Tables published part by part: readers see a whole version or the one before it.

``folder/data`` holds the rows by part (a year, say) and version, ``folder/manifests``
one small table per publication that lists the version of every part.  A manifest
counts once Spark has committed it; it is written last, so a job that dies in
between leaves nothing but files that no manifest lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part string, version string, rows long"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in any store that Spark reaches."""
    fs, path = _file_system(spark, folder), spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def publications(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed publications, oldest first."""
    numbers = [int(n) for n in _names(spark, f"{folder}/manifests") if n.isdigit()]
    return [n for n in sorted(numbers) if "_SUCCESS" in _names(spark, f"{folder}/manifests/{n}")]


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> list[tuple[str, str, int]]:
    """Part, version and rows of a publication, the last one by default: one entry per part."""
    known = publications(spark, folder)
    if number is None and not known:
        return []
    listed = spark.read.schema(MANIFEST).json(f"{folder}/manifests/{known[-1] if number is None else number}")
    return [tuple(r) for r in listed.orderBy("part").collect()]


def publish(
    df: DataFrame, folder: str, by: str, before_swap: Callable[[], None] | None = None
) -> int:
    """Store the parts that ``df`` holds as new versions, keep all others, and return the number of the publication.

    Parts are few (years, categories); they are listed by the driver.  Null parts
    are refused.  A publication that another one has overtaken fails when it comes
    to its manifest, and changes nothing.  ``before_swap`` runs between the rows
    and the manifest.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    before = publications(spark, folder)
    number = 1 + max([0, *(int(n) for n in _names(spark, f"{folder}/manifests") if n.isdigit())])
    spread = df.withColumn("_version", F.lit(version)).hint("rebalance", by)
    spread.write.mode("append").partitionBy(by, "_version").parquet(f"{folder}/data")
    written = spark.read.schema(_stored(df.schema)).parquet(f"{folder}/data").filter(F.col("_version") == version)
    fresh = written.groupBy(F.col(by).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    listed = {r["part"]: (version, r["rows"]) for r in fresh.collect()}
    if None in listed:
        raise ValueError(f"{by} is null in {listed[None][1]} rows")
    if before_swap:
        before_swap()
    if publications(spark, folder) != before:
        raise RuntimeError(f"overtaken by another publication in {folder}")
    kept = {p: (v, n) for p, v, n in manifest(spark, folder, before[-1])} if before else {}
    rows = [(p, v, n) for p, (v, n) in sorted((kept | listed).items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{folder}/manifests/{number}")
    return number


def _stored(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("_version", "string")


def published(spark: SparkSession, folder: str, schema: StructType, by: str, number: int | None = None) -> DataFrame:
    """The table as of a publication, the last one by default; files that its manifest does not list are not read."""
    listed = manifest(spark, folder, number)
    if not listed:
        return spark.createDataFrame([], schema)
    mark = "\u0001"
    stored = spark.read.schema(_stored(schema)).parquet(f"{folder}/data")
    # Filters on partition columns alone, so that other folders are never opened.
    wanted = F.concat(F.col(by).cast("string"), F.lit(mark), F.col("_version")).isin([p + mark + v for p, v, _ in listed])
    return stored.filter(wanted).select(*[f.name for f in schema.fields])


def forget(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Remove the versions that none of the last ``keep`` publications lists; returns how many folders went.

    Run it while nothing is being published: rows of an unfinished publication are
    not listed yet.
    """
    last = publications(spark, folder)[-keep:]
    wanted = {(p, v) for n in last for p, v, _ in manifest(spark, folder, n)}
    fs, gone = _file_system(spark, folder), 0
    for part in _names(spark, f"{folder}/data"):
        for name in _names(spark, f"{folder}/data/{part}"):
            if "=" in part and (part.split("=", 1)[1], name.split("=", 1)[-1]) not in wanted:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{part}/{name}"), True)
                gone += 1
    return gone
