"""Files as tables: workspace texts, transcript lines, synonym settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.understand import SYNONYMS


def workspace_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(file_path, modified, size, text): one row per file; undecodable bytes are dropped, unreadable files skipped."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    )
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return raw.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), text.alias("text"))


def transcript_files(spark: SparkSession, folder: str, archived: bool = False) -> DataFrame:
    """(file_path, modified, size): active transcripts, or archived ones; deleted ones never."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = name.contains(".reset.") if archived else name.endswith(".jsonl") & ~name.contains(".reset.")
    return raw.where(kind & ~name.contains(".deleted.")).select(
        F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    )


def transcript_lines(spark: SparkSession, files: DataFrame | list[str]) -> DataFrame:
    """(file_path, line_num, value) of JSONL files, lines numbered from 1 in each."""
    paths = files if isinstance(files, list) else [r.file_path for r in files.select("file_path").collect()]
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.split("value", "\n", -1).alias("ls"))
    return raw.select("file_path", F.posexplode("ls").alias("p", "value")).select("file_path", (F.col("p") + 1).cast("int").alias("line_num"), "value")


def synonyms(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """The built-in synonyms, with those of a JSON object (term -> list) over them; a bad file is ignored."""
    found = dict(SYNONYMS)
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                found |= {str(k): tuple(map(str, v)) for k, v in json.load(f).items()}
        except (OSError, ValueError, AttributeError, TypeError):
            return dict(SYNONYMS)
    return found
