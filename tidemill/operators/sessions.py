"""Blocks of activity in transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.messages import distinct_lines
from tidemill.operators.gap_tree import cut, gap_tree

SESSION_GAP_MIN = 30


def message_gap_tree(messages: DataFrame) -> DataFrame:
    """The gap tree of every session of ``messages``: all roles, each line once, real timestamps only."""
    return gap_tree(distinct_lines(messages), "session_id", "us")


def message_blocks(messages: DataFrame, gap_min: float = SESSION_GAP_MIN) -> DataFrame:
    """(session_id, start_us, end_us, duration_us, n_messages) of each block of activity.

    A block ends where more than ``gap_min`` minutes pass before the next message. Lines delivered
    again count once; lines whose timestamp is no real time are left out; one message makes a block.
    """
    blocks = cut(message_gap_tree(messages), int(gap_min * 60_000_000))
    return blocks.withColumnRenamed("entity", "session_id").withColumnRenamed("n", "n_messages")


def blocks_for_settings(tree: DataFrame, minutes: tuple[float, ...]) -> DataFrame:
    """The same tree cut at several gap settings in one pass: (gap_min, entity, start_us, end_us, n)."""
    settings = F.explode(F.array(*[F.lit(float(m)) for m in minutes])).alias("gap_min")
    limit = F.col("gap_min") * 60_000_000
    return (
        tree.select("*", settings)
        .where(F.col("gap_us").isNull() | (F.col("gap_us") <= limit))
        .where(F.col("parent_gap_us").isNull() | (F.col("parent_gap_us") > limit))
        .select("gap_min", "entity", "start_us", "end_us", "n")
    )
