"""Columns that every reader of transcript lines needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.timestamps import instant_us

HEARTBEAT = "HEARTBEAT_OK"


def transcript_session(file_path: Column) -> Column:
    """The session that a transcript's path names: its file name up to the first dot."""
    name = F.element_at(F.split(file_path, "/"), -1)
    return F.nullif(F.substring_index(name, ".", 1), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


#: stands for a missing instant beside a code: beyond every instant that a timestamp can give
_NO_INSTANT = 1 << 59


def distinct_lines(messages: DataFrame, code: Column | None = None) -> DataFrame:
    """Each transcript line once: (session_id, line_num, us), and ``code`` (0 to 7) if it is given.

    A line is (session, line_num); lines delivered again have the same content, so which copy stays
    does not matter: the one first ingested is taken. The session is that of ``file_path`` or, where
    this names none, of ``session_id``; rows with neither are left out. Instant and code travel as one
    long, so that the rows of a line are aggregated in place, without a sort.
    """
    session = F.coalesce(transcript_session(F.col("file_path")), F.col("session_id"))
    us = instant_us(F.col("timestamp"))
    if code is not None:
        us = F.shiftleft(F.coalesce(us, F.lit(_NO_INSTANT)), 3).bitwiseOR(code.cast("bigint"))
    picked = messages.select(session.alias("session_id"), "line_num", "ingested_at", us.alias("v"))
    lines = (
        picked.where("session_id is not null")
        .groupBy("session_id", "line_num")
        .agg(F.coalesce(F.min_by("v", "ingested_at"), F.min("v")).alias("v"))
    )
    if code is None:
        return lines.withColumnRenamed("v", "us")
    us = F.shiftright("v", 3)
    return lines.select("session_id", "line_num", F.when(us != _NO_INSTANT, us).alias("us"), F.col("v").bitwiseAND(7).cast("int").alias("code"))
