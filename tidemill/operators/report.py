"""Latency and rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (50, 95, 99)


def latency_report(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, min, max, p50, p95, p99): percentiles are order statistics, element int(n * p) of the sorted values.

    Values are counted first, so a group's window holds its distinct values only; nulls are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("*", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy(group)).alias("n"))

    def pick(p: int) -> Column:
        place = F.floor(F.col("n") * (p / 100))
        return F.min(F.when(F.col("upto") > F.least(place, F.col("n") - 1), F.col(value))).alias(f"p{p}")

    return ranked.groupBy(group).agg(
        F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[pick(p) for p in PERCENTILES],
    )


def throughput(rows: DataFrame, group: str, at: str, unit_s: int = 60) -> DataFrame:
    """(group, n, seconds, per_unit): events of a group by the time from its first to its last."""
    span = F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (span / 1e6).alias("seconds"))
    return found.withColumn("per_unit", F.col("n") * unit_s / F.nullif("seconds", F.lit(0.0)))
