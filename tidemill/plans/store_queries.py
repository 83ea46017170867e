"""Queries on the store: statistics, upsert and removal by file, positions, metadata, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.messages import distinct_lines
from tidemill.operators import store
from tidemill.operators.report import latency_report, throughput
from tidemill.plans.registry import query
from tidemill.plans.session_queries import LINES_SQL
from tidemill.sources.tables import table


@query(
    "store_statistics",
    """SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files,
  count(*) FILTER (WHERE metadata.source IS DISTINCT FROM 'transcript') AS primary_chunks,
  count(*) FILTER (WHERE metadata.source = 'transcript') AS secondary_chunks,
  (SELECT count(*) FROM entities) AS total_entities FROM chunks""",
)
def store_statistics(spark, sf_dir):
    return store.statistics(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "entities"))


@query(
    "upsert_files",
    """WITH new AS (SELECT file_path, doc_id AS id, text FROM documents), old AS (SELECT file_path, id, text FROM chunks),
changed AS (SELECT file_path, id + 1000000 AS id, text FROM old WHERE file_path LIKE 'team/%' UNION ALL SELECT * FROM new)
SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM changed) UNION ALL SELECT * FROM changed""",
)
def upsert_files(spark, sf_dir):
    """The chunks, with one family written anew and the documents' files added."""
    old = table(spark, sf_dir, "chunks").select("file_path", "id", "text")
    new = table(spark, sf_dir, "documents").select("file_path", F.col("doc_id").alias("id"), "text")
    changed = old.where("file_path like 'team/%'").withColumn("id", F.col("id") + 1000000).unionByName(new)
    return store.upsert(old, changed)


@query(
    "remove_files",
    """SELECT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.file_path = c.file_path)""",
)
def remove_files(spark, sf_dir):
    """The chunks that stay when all files with a transcript are removed."""
    return store.remove(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "messages")).select("id")


@query(
    "archive_scan",
    """WITH f AS (SELECT file_path, max(ingested_at) AS modified, max(line_num) AS n_lines FROM messages WHERE contains(file_path, '.reset.') GROUP BY 1)
SELECT file_path, n_lines FROM f WHERE file_path NOT IN (SELECT file_path FROM chunks WHERE file_path IS NOT NULL)""",
)
def archive_scan(spark, sf_dir):
    """Archived transcripts that no chunk was made from."""
    files = table(spark, sf_dir, "messages").where(F.col("file_path").contains(".reset.")).groupBy("file_path").agg(
        F.max("ingested_at").alias("modified"), F.max("line_num").alias("n_lines")
    )
    return store.not_seen(files, table(spark, sf_dir, "chunks").select("file_path").distinct()).select("file_path", "n_lines")


@query(
    "json_metadata",
    """SELECT event_type, count(*) AS n, count(DISTINCT k) AS n_keys FROM (
  SELECT event_type, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) GROUP BY event_type""",
)
def json_metadata(spark, sf_dir):
    """Keys of the JSON text in events; text that is no JSON object is skipped."""
    keys = F.explode(F.json_object_keys("props")).alias("k")
    return table(spark, sf_dir, "events").select("event_type", keys).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_keys")
    )


@query(
    "latency_report",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, min(value) AS "min", max(value) AS "max",
  min(CASE WHEN i = least(floor(n * 0.5::DOUBLE), n - 1) THEN value END) AS p50, min(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN value END) AS p95,
  min(CASE WHEN i = least(floor(n * 0.99::DOUBLE), n - 1) THEN value END) AS p99 FROM r GROUP BY event_type""",
)
def latency(spark, sf_dir):
    found = latency_report(table(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumn("mean", F.round("mean", 6))


@query(
    "throughput_report",
    """SELECT user_id, count(*) AS n, round(count(*) * 60 / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 0), 6) AS per_minute
FROM events GROUP BY user_id""",
)
def throughput_report(spark, sf_dir):
    found = throughput(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.select("user_id", "n", F.round("per_unit", 6).alias("per_minute"))


@query(
    "transcript_positions",
    "WITH" + LINES_SQL + """
SELECT session_id, max(line_num) AS last_line, count(*) AS n_lines, count(us) AS n_timed, max(us) AS last_us FROM lines GROUP BY session_id""",
)
def transcript_positions(spark, sf_dir):
    """How far each transcript has been read: its last line, lines and newest time."""
    lines = distinct_lines(table(spark, sf_dir, "messages"))
    return lines.groupBy("session_id").agg(
        F.max("line_num").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.count("us").alias("n_timed"), F.max("us").alias("last_us")
    )
