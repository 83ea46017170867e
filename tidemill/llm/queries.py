"""The registered queries on training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.llm import contamination, conversations, near_dup, pii, sentences, tokens, truncation
from tidemill.sources.tables import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: each line once, with its instant, its role and whether it is usable
LINES_SQL = r"""WITH raw AS (
  SELECT coalesce(nullif(split_part(list_last(string_split(file_path, '/')), '.', 1), ''), session_id) AS session_id,
         line_num, arg_min({'ts': trim(timestamp), 'r': role, 't': text}, ingested_at) AS m
  FROM messages GROUP BY 1, 2),
parts AS (
  SELECT session_id, line_num, m.ts AS ts, lower(regexp_replace(m.r, '^\s+|\s+$', '', 'g')) AS role, m.t AS text,
         regexp_extract(m.ts, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?\s*(Z|z|[+-]\d{2}:?\d{2})?$',
                        ['d', 't', 'f', 'z']) AS p FROM raw),
lines AS (
  SELECT session_id, line_num, role,
    coalesce(role IN ('user', 'assistant') AND regexp_matches(text, '\S') AND NOT contains(text, 'HEARTBEAT_OK'), false) AS usable,
    CASE WHEN regexp_matches(ts, '^\d{12,14}$') THEN ts::BIGINT * 1000
      WHEN p.d <> '' THEN epoch_us(try_cast(p.d || 'T' || p.t || '.' || rpad(p.f, 6, '0')[1:6] ||
        CASE WHEN p.z IN ('', 'Z', 'z') THEN '+00:00'
             ELSE regexp_replace(p.z, '^([+-]\d{2}):?(\d{2})$', '\1:\2') END AS TIMESTAMPTZ)) END AS us
  FROM parts WHERE session_id IS NOT NULL),
ends AS (
  SELECT session_id, count(*) FILTER (WHERE usable) AS n_usable, count(*) FILTER (WHERE usable AND us IS NULL) AS n_orphans,
    arg_min(role, {'us': us, 'line_num': line_num}) FILTER (WHERE usable AND us IS NOT NULL) AS first_role,
    arg_max(role, {'us': us, 'line_num': line_num}) FILTER (WHERE usable AND us IS NOT NULL) AS last_role
  FROM lines GROUP BY session_id),
faults AS (
  SELECT *, CASE WHEN n_usable = 0 THEN 'empty' WHEN n_orphans > 0 THEN 'broken'
    WHEN first_role <> 'user' THEN 'no_question' WHEN last_role <> 'assistant' THEN 'no_reply' END AS fault FROM ends)
"""


@query("p1_found", LINES_SQL + "SELECT session_id FROM faults WHERE fault IS NOT NULL")
def p1_found(spark, sf_dir):
    ends = conversations.conversation_ends(table(spark, sf_dir, "messages"))
    return conversations.conversation_fault(ends).where("fault is not null").select("session_id")


@query(
    "p1_turns",
    LINES_SQL + """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, line_num) - 1 AS position, line_num, role, us
FROM lines SEMI JOIN (SELECT session_id FROM faults WHERE fault IS NULL) USING (session_id) WHERE usable""",
)
def p1_turns(spark, sf_dir):
    """The sound conversations, turn by turn."""
    return conversations.conversation_turns(table(spark, sf_dir, "messages"))


@query("p1_faults", LINES_SQL + "SELECT coalesce(fault, 'sound') AS fault, count(*) AS n FROM faults GROUP BY 1")
def p1_faults(spark, sf_dir):
    """How many conversations have which fault."""
    ends = conversations.conversation_ends(table(spark, sf_dir, "messages"))
    faults = conversations.conversation_fault(ends)
    return faults.groupBy(F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("p6_ids")
def p6_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


#: runs of three consecutive words of each chunk's text, once each
RUNS_SQL = r"""WITH RECURSIVE words AS (
  SELECT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM chunks WHERE text IS NOT NULL),
runs AS (
  SELECT id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS r
  FROM words WHERE len(w) > 0),
flat AS (SELECT id, len(r) AS n, unnest(r) AS run FROM runs),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, count(*) AS c
  FROM flat a JOIN flat b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM shared WHERE c >= 0.6 * (n_a + n_b - c))
"""


@query("p5_found", RUNS_SQL + "SELECT id_a, id_b FROM pairs")
def p5_found(spark, sf_dir):
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "chunks"), threshold=0.6, width=3)


@query(
    "p5_groups",
    RUNS_SQL + """,
links AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(id, low) AS (
  SELECT id, id FROM chunks UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.id),
texts AS (SELECT DISTINCT least(a.text, b.text) AS s, greatest(a.text, b.text) AS t FROM pairs p
  JOIN chunks a ON a.id = p.id_a JOIN chunks b ON b.id = p.id_b WHERE a.text <> b.text),
degree AS (SELECT text, count(*) AS n FROM (SELECT s AS text FROM texts UNION ALL SELECT t FROM texts) GROUP BY 1)
SELECT c.id, (SELECT min(low) FROM reach r WHERE r.id = c.id) AS group_id, coalesce(d.n, 0) AS n_links
FROM chunks c LEFT JOIN degree d USING (text)""",
)
def p5_groups(spark, sf_dir):
    """The class of each chunk."""
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "chunks"), threshold=0.6, width=3)


@query("p7_found")
def p7_found(spark, sf_dir):
    found = contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


@query("p7_items")
def p7_items(spark, sf_dir):
    """The leaked items: in how many documents, and the longest leak's number of windows."""
    found = contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("n_windows").alias("most_windows")
    )


@query("p8_found")
def p8_found(spark, sf_dir):
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


@query("p8_lengths")
def p8_lengths(spark, sf_dir):
    """Per source: documents with a unit, units, and their mean length."""
    docs = table(spark, sf_dir, "documents")
    units = sentences.sentence_units(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars")
    )
    return docs.select("doc_id", "source").join(units, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_units"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars")
    )


@query("p2_found")
def p2_found(spark, sf_dir):
    return truncation.truncated(table(spark, sf_dir, "chunks")).where("is_cut").select("id")


@query("p2_report")
def p2_report(spark, sf_dir):
    """The share of truncated chunks of each metadata.source and file family."""
    return truncation.truncation_report(table(spark, sf_dir, "chunks"))


#: the Poisson tail summed term by term; the rest as in the operator
_HAZARDS_SQL = """WITH n AS (SELECT metadata.source AS source, split_part(file_path, '/', 1) AS family, length(text) AS len, count(*) AS n
  FROM chunks WHERE regexp_matches(text, '\\S') GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY source, family ORDER BY len DESC)::BIGINT AS at_risk FROM n),
w AS (SELECT *, sum(n) OVER near - n AS near_n, avg(at_risk) OVER near AS near_risk,
    greatest(least({near}, len - min(len) OVER g) + least({near}, max(len) OVER g - len), 1) AS near_lengths,
    min(len) OVER g < max(len) OVER g AS compared
  FROM r WINDOW g AS (PARTITION BY source, family),
    near AS (PARTITION BY source, family ORDER BY len RANGE BETWEEN {near} PRECEDING AND {near} FOLLOWING)),
m AS (SELECT *, (near_n + 0.5::DOUBLE) / near_lengths / near_risk AS expected,
    CASE WHEN compared THEN greatest((near_n + 0.5::DOUBLE) / near_lengths / near_risk * at_risk, (near_n + 0.5::DOUBLE) / near_lengths)
      ELSE n END::DOUBLE AS mean FROM w),
p AS (SELECT *, CASE WHEN n > mean THEN list_sum(list_transform(range(n, n + 400), lambda k: exp(k * ln(mean) - mean - lgamma(k + 1))))
    ELSE 1 END AS p FROM m),
q AS (SELECT p, row_number() OVER (ORDER BY p) AS rank FROM p WHERE p <= {alpha}),
cut AS (SELECT coalesce(max(p), -1) AS cut FROM q WHERE p <= rank * {alpha} / (SELECT count(*) FROM p))
SELECT source, family, len, n, at_risk, n / at_risk AS hazard, round(expected, 9) AS expected,
  round(greatest(0, 1 - mean / n), 6) AS excess, p <= cut AS significant FROM p CROSS JOIN cut"""


@query("p2_hazards", _HAZARDS_SQL.format(near=truncation.NEIGHBOURS, alpha=truncation.ALPHA))
def p2_hazards(spark, sf_dir):
    """The discrete hazard of every length of every source, and which are significant."""
    chunks = table(spark, sf_dir, "chunks").where(F.col("text").rlike(r"(?U)\S"))
    lengths = chunks.select("metadata.source", truncation.family(F.col("file_path")).alias("family"), F.length("text").alias("len"))
    return truncation.length_hazards(lengths).select(
        "source", "family", "len", "n", "at_risk", "hazard", F.round("expected", 9).alias("expected"), F.round("excess", 6).alias("excess"), "significant"
    )


@query("p3_found")
def p3_found(spark, sf_dir):
    return pii.pii_of_tables(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "entities"))


@query("p3_redacted")
def p3_redacted(spark, sf_dir):
    """Each chunk's text and each entity's value with typed placeholders."""
    return pii.redact_tables(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "entities"))
