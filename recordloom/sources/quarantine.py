"""Bad rows: judged and counted in the pass that writes them, kept apart, and reconciled with the good ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.session import scratch_path

GOOD = "good"


@dataclass(frozen=True)
class Intake:
    """Rows that may be used, rows set aside with their ``reason``, and how many of each the writing pass has seen."""

    good: DataFrame
    bad: DataFrame
    seen: dict[str, int]


def divide(rows: DataFrame, rules: Mapping[str, Column], path: str | None = None) -> Intake:
    """Write ``rows`` once, the good ones and those for which a rule holds in folders of their own under ``path``.

    The ``reason`` is the first rule that holds; a rule that is null does not.
    ``seen`` is counted by the job that writes.  Nothing is dropped:
    :func:`reconcile` holds the written rows against what came in.
    """
    path = path or scratch_path(rows.sparkSession, "intake")
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()], F.lit(GOOD))
    judged = rows.withColumn("reason", reason)
    counted = Observation("intake")
    marks = [F.count_if(F.col("reason") == name).alias(name) for name in (GOOD, *rules)]
    judged.observe(counted, F.count(F.lit(1)).alias("rows"), *marks).write.partitionBy("reason").parquet(path)
    stored = rows.sparkSession.read.schema(judged.schema).parquet(path)
    good = stored.filter(F.col("reason") == GOOD).drop("reason")
    return Intake(good, stored.filter(F.col("reason") != GOOD), {k: int(v) for k, v in counted.get.items()})


def reconcile(rows: DataFrame, intake: Intake, by: list[str]) -> DataFrame:
    """Per ``by`` the ``rows_in``, the ``rows_out`` and the rows ``audited``; ``missing`` is zero where all are accounted for."""
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    sides = count(rows, "rows_in").unionByName(count(intake.good, "rows_out"), True).unionByName(count(intake.bad, "audited"), True)
    names = ("rows_in", "rows_out", "audited")
    summed = sides.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return summed.withColumn("missing", F.col("rows_in") - F.col("rows_out") - F.col("audited"))
