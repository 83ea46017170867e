"""What the streams keep current: a chunk table by file, parsed transcript lines, session blocks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.messages import transcript_session
from tidemill.functions.timestamps import instant_us
from tidemill.operators.chunking import chunk_files
from tidemill.operators.transcripts import parse_lines
from tidemill.streaming.sources import register

WORKSPACE_TRIGGER, TRANSCRIPT_TRIGGER = "2 seconds", "3 seconds"


def _start(writer, trigger: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The newest version of a table that ``keep_chunks`` writes."""
    versions = sorted(int(n[2:]) for n in os.listdir(table_dir) if n.startswith("v=")) if os.path.isdir(table_dir) else []
    versions = [v for v in versions if os.path.exists(f"{table_dir}/v={v}/_SUCCESS")]
    return spark.read.parquet(f"{table_dir}/v={versions[-1]}") if versions else None


def keep_chunks(spark: SparkSession, folder: str, table_dir: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """The chunks of a folder's files, replaced by file as files change, gone as files go.

    Every batch writes a version named by its number from the version before, so a batch that is
    repeated after a failure gives the same table. Without ``trigger`` it works off what is there.
    """
    register(spark)
    changes = spark.readStream.format("workspace_changes").option("path", folder).load()

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["path"]).persist()
        fresh = chunk_files(batch.where("op = 'upsert'").select(F.col("path").alias("file_path"), F.col("content").alias("text")))
        marks = batch.select(F.col("path").alias("file_path"))
        before = spark.read.parquet(f"{table_dir}/v={number - 1}") if number else None
        table = fresh if before is None else before.join(marks, "file_path", "left_anti").unionByName(fresh)
        table.write.mode("overwrite").parquet(f"{table_dir}/v={number}")
        batch.unpersist()

    return _start(changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint), trigger)


def keep_lines(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: str | None = None, archived: bool = False) -> StreamingQuery:
    """Parsed transcript lines appended to Parquet, each complete line once."""
    register(spark)
    raw = spark.readStream.format("transcript_lines").option("path", folder).option("archived", str(archived).lower()).load()
    return _start(parse_lines(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), trigger)


def session_windows(lines: DataFrame, gap_min: int = 30, late_min: int = 60) -> DataFrame:
    """Session blocks over a stream of parsed lines: (session_id, start_ms, end_ms, n_messages).

    State is held per open session; lines later than ``late_min`` minutes behind the newest are left out.
    """
    timed = lines.select(
        transcript_session(F.col("file_path")).alias("session_id"), F.timestamp_micros(instant_us(F.col("timestamp"))).alias("at")
    ).where("at is not null")
    blocks = (
        timed.withWatermark("at", f"{late_min} minutes")
        .groupBy("session_id", F.session_window("at", f"{gap_min} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_messages"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    return blocks.select("session_id", F.unix_millis("first").alias("start_ms"), F.unix_millis("last").alias("end_ms"), "n_messages")

