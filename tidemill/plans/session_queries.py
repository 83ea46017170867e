"""Queries on blocks of activity (problem 4) and on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators.gap_tree import cut, gap_tree
from tidemill.operators.sessions import blocks_for_settings, message_blocks, message_gap_tree
from tidemill.plans.registry import query
from tidemill.sources.tables import table

#: each line once, with its instant in microseconds
LINES_SQL = r"""
raw AS (
  SELECT coalesce(nullif(split_part(list_last(string_split(file_path, '/')), '.', 1), ''), session_id) AS session_id,
         line_num, arg_min(trim(timestamp), ingested_at) AS ts
  FROM messages GROUP BY 1, 2),
parts AS (
  SELECT *, regexp_extract(ts, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?\s*(Z|z|[+-]\d{2}:?\d{2})?$',
                           ['d', 't', 'f', 'z']) AS p FROM raw),
lines AS (
  SELECT session_id, line_num, CASE
    WHEN regexp_matches(ts, '^\d{12,14}$') THEN ts::BIGINT * 1000
    WHEN p.d <> '' THEN epoch_us(try_cast(p.d || 'T' || p.t || '.' || rpad(p.f, 6, '0')[1:6] ||
      CASE WHEN p.z IN ('', 'Z', 'z') THEN '+00:00'
           ELSE regexp_replace(p.z, '^([+-]\d{2}):?(\d{2})$', '\1:\2') END AS TIMESTAMPTZ)) END AS us
  FROM parts WHERE session_id IS NOT NULL)"""

BLOCKS_SQL = """
flagged AS (
  SELECT session_id, us, CASE WHEN us - lag(us) OVER w > {gap_us} THEN 1 ELSE 0 END AS starts
  FROM lines WHERE us IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY us)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS block FROM flagged)"""

_P4 = "WITH" + LINES_SQL + "," + BLOCKS_SQL.format(gap_us=30 * 60_000_000)


@query(
    "p4_found",
    _P4 + """
SELECT session_id, CAST(floor(min(us) / 1000.0) AS BIGINT) AS start_ms, CAST(floor(max(us) / 1000.0) AS BIGINT) AS end_ms
FROM numbered GROUP BY session_id, block""",
)
def p4_found(spark, sf_dir):
    return message_blocks(table(spark, sf_dir, "messages")).select(
        "session_id",
        F.floor(F.col("start_us") / 1000).cast("bigint").alias("start_ms"),
        F.floor(F.col("end_us") / 1000).cast("bigint").alias("end_ms"),
    )


@query(
    "p4_blocks",
    _P4 + """
SELECT session_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_messages
FROM numbered GROUP BY session_id, block""",
)
def p4_blocks(spark, sf_dir):
    return message_blocks(table(spark, sf_dir, "messages"))


def _settings_sql(minutes):
    one = """SELECT {m}::DOUBLE AS gap_min, count(*) AS n_blocks, sum(n)::BIGINT AS n_messages, sum(d)::BIGINT AS active_us FROM (
  SELECT count(*) AS n, max(us) - min(us) AS d FROM (
    SELECT *, sum(CASE WHEN us - prev > {m} * 60000000::BIGINT THEN 1 ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS block
    FROM (SELECT session_id, us, lag(us) OVER (PARTITION BY session_id ORDER BY us) AS prev FROM lines WHERE us IS NOT NULL))
  GROUP BY session_id, block)"""
    return "WITH" + LINES_SQL + " " + " UNION ALL ".join(one.format(m=m) for m in minutes)


_SETTINGS = (5, 15, 30, 60, 240)


@query("p4_gap_settings", _settings_sql(_SETTINGS))
def p4_gap_settings(spark, sf_dir):
    """One tree, five gap settings: blocks, messages and active time of each."""
    blocks = blocks_for_settings(message_gap_tree(table(spark, sf_dir, "messages")), _SETTINGS)
    return blocks.groupBy("gap_min").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("n").alias("n_messages"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("active_us"),
    )


@query(
    "event_sessions",
    """
WITH e AS (SELECT user_id::VARCHAR AS entity, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity ORDER BY us) > 1800000000 THEN 1 ELSE 0 END AS starts FROM e),
b AS (SELECT *, sum(starts) OVER (PARTITION BY entity ORDER BY us ROWS UNBOUNDED PRECEDING) AS block FROM f)
SELECT entity, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n
FROM b GROUP BY entity, block""",
)
def event_sessions(spark, sf_dir):
    """The same operator on another table: each user's events."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return cut(gap_tree(events, "user_id", "us"), 30 * 60_000_000)
