"""The chunk store as tables: upsert and removal by file, statistics, neighbours, line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import lines, tier


def chunk_id(path: Column, line_start: Column, ordinal: Column) -> Column:
    """An id that does not depend on the order of writing."""
    return F.xxhash64(path, line_start, ordinal)


def upsert(existing: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """``existing`` with all rows of the changed files replaced by ``changed``."""
    return existing.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def remove(existing: DataFrame, removed: DataFrame, key: str = "file_path") -> DataFrame:
    return existing.join(removed.select(key).distinct(), key, "left_anti")


def not_seen(files: DataFrame, positions: DataFrame, since_us: int | None = None) -> DataFrame:
    """Archived files that no position knows, modified no earlier than ``since_us``: (file_path, ...)."""
    fresh = files.where(F.unix_micros("modified") >= since_us) if since_us is not None else files
    return fresh.join(positions.select("file_path"), "file_path", "left_anti")


def statistics(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(total_chunks, total_files, total_entities, primary_chunks, secondary_chunks): one row."""
    kind = tier(F.col("metadata.source"))
    one = chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("file_path").alias("total_files"),
        F.count_if(kind == "primary").alias("primary_chunks"), F.count_if(kind == "secondary").alias("secondary_chunks"),
    )
    # both sides are one row each
    return one.join(F.broadcast(entities.agg(F.count(F.lit(1)).alias("total_entities"))))


def first_by_hash(rows: DataFrame, group: str, key: Column, *order: Column) -> DataFrame:
    """Per ``group`` the best row of each content hash; rows without a hash all stay."""
    w = Window.partitionBy(group, key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def neighbours(chunks: DataFrame) -> DataFrame:
    """(id, prev_id, next_id): the chunks before and after in the same file, by first line and id."""
    w = Window.partitionBy("file_path").orderBy("line_start", "id")
    return chunks.select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def line_range(texts: DataFrame, first: Column, count: Column) -> DataFrame:
    """``texts`` (.., text) with ``excerpt``: ``count`` lines from line ``first`` (1-based), clamped to the text."""
    ls = lines(F.col("text"))
    start = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1))
    part = F.when(start > F.size(ls), F.array().cast("array<string>")).otherwise(F.slice(ls, start, F.coalesce(count, F.size(ls))))
    return texts.withColumn("excerpt", F.array_join(part, "\n"))


def write(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """The table on disk, one folder a tier."""
    chunks.withColumn("tier", tier(F.col("metadata.source"))).write.mode(mode).partitionBy("tier").parquet(path)
