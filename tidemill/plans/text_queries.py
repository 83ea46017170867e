"""Queries on texts: lines, sections, chunks, transcripts, entities, query understanding."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemill.functions.text import content_hash, path_date, tier
from tidemill.operators import chunking, entities, transcripts, understand
from tidemill.operators.store import line_range
from tidemill.plans.registry import query
from tidemill.sources.tables import spread, table


@query(
    "line_scan",
    """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line = '') AS n_empty, max(length(line)) AS longest
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id""",
)
def line_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line") == "").alias("n_empty"), F.max(F.length("line")).cast("bigint").alias("longest")
    )


@query(
    "line_range",
    """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS excerpt
FROM documents WHERE text IS NOT NULL""",
)
def line_range_query(spark, sf_dir):
    """Three lines from the second of each document."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return line_range(docs, F.lit(2), F.lit(3)).select("doc_id", "excerpt")


@query(
    "heading_sections",
    r"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+.+') THEN 1 ELSE 0 END) OVER w AS h FROM l
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, min(pos)::INT AS line_start, count(*)::INT AS n_lines,
  min(CASE WHEN regexp_matches(line, '^#{1,6}\s+.+') THEN trim(regexp_replace(line, '^#{1,6}\s+', '')) END) AS heading
FROM s GROUP BY doc_id, h""",
)
def heading_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", F.explode(chunking.heading_sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("line_start"), F.size("s.body").alias("n_lines"), F.col("s.heading").alias("heading"))


@query("section_chunks")
def section_chunks(spark, sf_dir):
    """Every document chunked by the file rules."""
    docs = table(spark, sf_dir, "documents").select("file_path", "text")
    return chunking.chunk_files(docs).drop("ordinal")


@query("sentence_tails")
def sentence_tails(spark, sf_dir):
    """The last two sentences of each chunk, as the overlap rule takes them."""
    said = chunking.sentences(F.col("text"))
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", F.array_join(F.slice(said, F.greatest(F.size(said) - 1, F.lit(1)), 2), " ").alias("tail"))


_TYPES = "string_split(text, chr(10))"


def _hits(patterns):
    return " + ".join("len(list_filter(ls, lambda x: regexp_matches(x, '%s')))" % p.replace("'", "''") for p in patterns)


@query(
    "type_detect",
    f"""WITH c AS (SELECT id, text, string_split(text, chr(10)) AS ls FROM chunks WHERE text IS NOT NULL),
h AS (SELECT id, length(text) AS n, {_hits(chunking.CONFIG_PATTERNS)} AS cfg, {_hits(chunking.TODO_PATTERNS)} AS todo,
  {_hits(chunking.FACT_PATTERNS)} AS fact FROM c)
SELECT id, CASE WHEN cfg >= 2 THEN 'config' WHEN todo >= 1 THEN 'todo' WHEN fact >= 3 OR (fact >= 1 AND n < 300) THEN 'fact'
  ELSE 'narrative' END AS kind FROM h""",
)
def type_detect(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "chunks").where("text is not null").select("id", "text"))
    return rows.select("id", chunking.chunk_type(F.col("text")).alias("kind"))


@query("content_hash", "SELECT id, left(md5(text), 12) AS hash, left(md5(text), 12) = metadata.hash AS is_stored FROM chunks WHERE text IS NOT NULL")
def content_hash_query(spark, sf_dir):
    h = content_hash(F.col("text"))
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", h.alias("hash"), (h == F.col("metadata.hash")).alias("is_stored"))


@query(
    "date_context",
    r"""WITH d AS (SELECT id, nullif(regexp_extract(file_path, '(\d{4}-\d{2}-\d{2})', 1), '') AS d FROM chunks)
SELECT id, d AS file_date, 'Date: ' || coalesce(strftime(try_cast(d AS DATE), '%A, %B %d, %Y') || ' (' || d || ')', d) AS prefix
FROM d WHERE d IS NOT NULL""",
)
def date_context(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks").select("id", path_date(F.col("file_path")).alias("file_date")).where("file_date is not null")
    return rows.withColumn("prefix", chunking.date_prefix(F.col("file_date")))


_KEPT = r"""WITH raw AS (
  SELECT split_part(list_last(string_split(file_path, '/')), '.', 1) AS session_id, line_num, lower(trim(role)) AS role, sender, text
  FROM messages),
kept AS (
  SELECT session_id, line_num, role,
    CASE WHEN role = 'user' THEN coalesce(nullif(regexp_extract(text, '"sender":\s*"([^"]+)"', 1), ''), sender) ELSE sender END AS sender,
    CASE WHEN role = 'user' THEN trim(regexp_replace(text, 'Conversation info \(untrusted metadata\):\s*```json\s*\{[^}]*\}\s*```\s*(?:Sender \(untrusted metadata\):\s*```json\s*\{[^}]*\}\s*```\s*)?', '', 'g'))
      ELSE trim(text) END AS text
  FROM raw WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 10
    AND NOT ((contains(text, 'Read HEARTBEAT.md') AND contains(text, 'HEARTBEAT_OK')) OR trim(text) = 'HEARTBEAT_OK'))
"""


@query("message_filter", _KEPT + "SELECT * FROM kept WHERE role <> 'user' OR length(text) >= 5")
def message_filter(spark, sf_dir):
    return transcripts.kept_messages(table(spark, sf_dir, "messages")).drop("us")


@query(
    "message_lines",
    _KEPT + """SELECT session_id, line_num, '**' || coalesce(nullif(sender, ''), upper(role[1]) || role[2:]) || ':** ' ||
  CASE WHEN length(text) > 2000 THEN left(text, 2000) || '... [truncated]' ELSE text END AS line
FROM kept WHERE role <> 'user' OR length(text) >= 5""",
)
def message_lines(spark, sf_dir):
    rows = transcripts.kept_messages(table(spark, sf_dir, "messages"))
    return rows.select("session_id", "line_num", transcripts.message_line(F.col("role"), F.col("sender"), F.col("text")).alias("line"))


@query(
    "json_lines",
    """SELECT file_path, line_num, CASE WHEN line_num % 3 = 0 AND text IS NOT NULL THEN text || chr(10) || 'END' WHEN line_num % 3 = 1 THEN coalesce(text, '')
  ELSE '' END AS text FROM (SELECT DISTINCT file_path, line_num, text FROM messages)""",
)
def json_lines(spark, sf_dir):
    """Transcript lines written as JSON and parsed again: texts as strings, as lists of items, as objects."""
    rows = table(spark, sf_dir, "messages").select("file_path", "line_num", "text").distinct()
    item = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    string = F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    items = F.array(item("text", F.col("text")), item("image", F.lit("no")), item("text", F.lit("END")))
    listed = F.to_json(F.struct(F.struct(F.when(F.col("text").isNotNull(), items).alias("content")).alias("message")))
    other = F.to_json(F.struct(F.struct(F.struct("text").alias("content")).alias("message")))
    kind = F.col("line_num") % 3
    value = F.when(kind == 0, listed).when(kind == 1, string).otherwise(other)
    return transcripts.parse_lines(rows.select("file_path", "line_num", value.alias("value"))).select("file_path", "line_num", "text")


@query("message_pack")
def message_pack(spark, sf_dir):
    """Conversation chunks of all transcripts."""
    lines = table(spark, sf_dir, "messages").dropDuplicates(["file_path", "line_num"])
    return transcripts.pack(transcripts.kept_messages(lines))


@query(
    "message_bins",
    _KEPT.replace("FROM messages)", "FROM (SELECT DISTINCT ON (file_path, line_num) * FROM messages ORDER BY file_path, line_num))")
    + """SELECT session_id, count(*) AS n_lines, min(line_num) AS first_line, max(line_num) AS last_line,
  sum(length('**' || coalesce(nullif(sender, ''), upper(role[1]) || role[2:]) || ':** ' || left(text, 2000)))::BIGINT AS chars
FROM kept WHERE role <> 'user' OR length(text) >= 5 GROUP BY session_id""",
)
def message_bins(spark, sf_dir):
    """What the conversation chunks of each session hold: no line is lost or told twice."""
    rows = message_pack(spark, sf_dir)
    body = F.when(F.col("text").startswith("Date: "), F.regexp_replace("text", r"^Date: [^\n]*\nSession: [^\n]*\n\n", "")).otherwise(F.col("text"))
    said = F.regexp_count(body, F.lit(r"(?:^|\n\n)\*\*[^*\n]+:\*\* ")).cast("bigint")
    return rows.groupBy("session_id").agg(
        F.sum(said).alias("n_lines"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"),
        F.sum(F.length(body) - 2 * (said - 1)).alias("chars"),
    )


def _case(pairs, other):
    return "CASE " + " ".join(f"WHEN {when} THEN '{then}'" for then, when in pairs) + f" ELSE '{other}' END"


def _rule_sql():
    """rule -> (pattern, type, name, value, condition) as SQL on the groups g0, g1 and g2 of a match, not yet trimmed."""
    e = entities
    fixed = {
        "email": (e.EMAIL, "email", "email"), "url": (e.URL, "url", "url"), "password": (e.PASSWORD, "credential", "password"),
        "token": (e.TOKEN, "credential", "token"), "ein": (e.EIN, "business", "EIN"), "ssn": (e.SSN, "pii", "SSN"), "address": (e.ADDRESS, "location", "address"),
        "date": (e.DATE, "date", "date"), "product": (e.PRODUCT, "business", "insurance_product"), "phone": (e.PHONE, "phone", "phone"),
        "state": (rf"(?i)\b({e.STATES})\b", "location", "state"), "ip_bare": (e.IP_BARE, "ip", "ip_address"),
    }
    found = {n: (p, f"'{kind}'", f"'{name}'", "g1", "true") for n, (p, kind, name) in fixed.items()}
    found["url"] = (*found["url"][:3], "regexp_replace(g1, '[.,;)]+$', '')", "true")
    found["phone"] = (*found["phone"][:4], "length(regexp_replace(g1, '\\D', '', 'g')) = 10")
    found["ip_bare"] = (*found["ip_bare"][:4], "len(list_filter(string_split(g1, '.'), lambda o: o::INT > 255)) = 0")
    kinds = _case([(k, "(" + " OR ".join(f"contains(lower(trim(g1)), '{w}')" for w in ws) + ")") for k, ws in e.KEY_TYPES], "fact")
    found["key_value"] = (e.KEY_VALUE, kinds, "g1", "g2", "length(trim(g1)) < 50 AND length(trim(g2)) < 200")
    kin = _case([(k, f"contains(lower(g0), '{k}')") for k in e.KIN], "family")
    found |= {f"kinship_{i}": (p, "'person'", kin, "g1", "true") for i, p in enumerate(e.KINSHIP)}
    found["role"] = (e.ROLE, "'person'", "trim(g1) || '_role'", "g2", "length(trim(g1)) < 40 AND length(trim(g2)) < 60")
    found |= {f"person_{i}": (p, "'person'", "'person_name'", "g1", "length(trim(g1)) BETWEEN 4 AND 49") for i, p in enumerate(e.PERSON)}
    found["employee_near"] = (e.EMPLOYEE_NEAR, "'person'", "trim(g1) || '_employee_id'", "g2", "true")
    found |= {f"fact_{i}": (p, "'person'", f"trim(g1) || '_{kind}'", "g2", "length(trim(g1)) > 3 AND length(trim(g2)) > 1") for i, (p, kind) in enumerate(e.FACTS)}
    names = ", ".join(f"'{n}'" for n in e.NO_NAMES)
    found["structured"] = (e.STRUCTURED, "'person'", "'person_name'", "g1", f"length(trim(g1)) > 4 AND trim(g1) NOT IN ({names})")
    return found


def _entity_sql(names):
    parts = []
    for i, n in enumerate(names):
        pattern, kind, name, value, keep = _rule_sql()[n]
        # words need not be taken whole in an engine without backtracking
        plain = pattern.replace("(?<![A-Za-z])", "").replace("++", "+").replace("'", "''")
        two = f"regexp_extract_all(text, '{plain}', 2)" if re.compile(pattern).groups > 1 else "[]"
        parts.append(
            f"SELECT id, {i} AS rule, {kind} AS entity_type, {name} AS entity_name, {value} AS entity_value, pos FROM ("
            f"SELECT id, unnest(a) AS g0, unnest(b) AS g1, unnest(c)::VARCHAR AS g2, generate_subscripts(a, 1) AS pos FROM ("
            f"SELECT id, regexp_extract_all(text, '{plain}', 0) AS a, regexp_extract_all(text, '{plain}', 1) AS b, {two} AS c FROM chunks)) WHERE {keep}"
        )
    blanks = "'^\\s+|\\s+$', '', 'g'"
    return (
        "WITH e AS (" + " UNION ALL ".join(parts) + f") SELECT id, entity_type, regexp_replace(entity_name, {blanks}) AS entity_name, "
        f"regexp_replace(entity_value, {blanks}) AS entity_value FROM e "
        "QUALIFY row_number() OVER (PARTITION BY id, entity_type, lower(entity_name), left(lower(entity_value), 50) ORDER BY rule, pos) = 1"
    )


def _entity_query(name, rules):
    @query(name, _entity_sql(rules))
    def run(spark, sf_dir):
        return entities.extract(table(spark, sf_dir, "chunks"), only=rules)


_entity_query("entities_contact", ("email", "url"))
_entity_query("entities_credential", ("password", "token"))
_entity_query("entities_business", ("ein", "ssn", "product"))
_entity_query("entities_date", ("date",))
_entity_query("entities_places", ("ip_bare", "phone", "address", "state"))
_entity_query("entities_key_value", ("key_value",))
_entity_query("entities_kinship", ("kinship_0", "kinship_1", "kinship_2"))
_entity_query("entities_people", (*(f"person_{i}" for i in range(len(entities.PERSON))), "structured"))
_entity_query("entities_facts", ("role", "employee_near", *(f"fact_{i}" for i in range(len(entities.FACTS)))))


@query("entities_all")
def entities_all(spark, sf_dir):
    """All rules over all chunks."""
    return entities.extract(table(spark, sf_dir, "chunks"))


@query(
    "entity_summary",
    """SELECT entity_type, count(*) AS n, count(DISTINCT lower(trim(entity_value))) AS n_values, count(DISTINCT chunk_id) AS n_chunks
FROM entities GROUP BY entity_type""",
)
def entity_summary(spark, sf_dir):
    return table(spark, sf_dir, "entities").groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower(F.trim("entity_value"))).alias("n_values"), F.countDistinct("chunk_id").alias("n_chunks")
    )


def _or(patterns, col="text"):
    return "(" + " OR ".join("regexp_matches(%s, '(?i)%s')" % (col, p.replace("'", "''")) for p in patterns) + ")"


@query(
    "intents",
    "SELECT file_path, line_num, intent FROM (SELECT file_path, line_num, unnest(list_filter(["
    + ", ".join("CASE WHEN %s THEN '%s' END" % (_or(p), n) for n, (p, _, _) in understand.INTENTS.items())
    + "], lambda x: x IS NOT NULL)) AS intent FROM messages WHERE lower(trim(role)) = 'user' AND text IS NOT NULL)",
)
def intents(spark, sf_dir):
    """The intents of everything users said."""
    said = table(spark, sf_dir, "messages").where("lower(trim(role)) = 'user' and text is not null")
    return said.select("file_path", "line_num", F.explode(understand.intents(F.col("text"))).alias("intent"))


@query(
    "temporal_mode",
    f"""SELECT file_path, line_num, CASE WHEN {_or(understand.SPECIFIC_DATE)} THEN 'specific_date' WHEN {_or(understand.RECENCY)} THEN 'recency'
  WHEN {_or(understand.WHEN)} THEN 'when' END AS mode FROM messages WHERE text IS NOT NULL""",
)
def temporal_mode(spark, sf_dir):
    return table(spark, sf_dir, "messages").where("text is not null").select("file_path", "line_num", understand.temporal_mode(F.col("text")).alias("mode"))


def _dates_sql():
    named = f"regexp_extract(text, '(?i)\\b({understand.MONTH_NAMES})\\s+(\\d{{1,2}})(?:[,\\s]+(\\d{{4}}))?\\b', ['m', 'd', 'y'])"
    slash = "regexp_extract(text, '\\b(\\d{1,2})/(\\d{1,2})(?:/(\\d{2,4}))?\\b', ['m', 'd', 'y'])"
    month = "lpad(list_position([%s], lower(left(a.m, 3)))::VARCHAR, 2, '0')" % ", ".join(f"'{m}'" for m in understand.MONTHS)
    return f"""WITH t AS (SELECT file_path, line_num, {named} AS a, regexp_extract(text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS iso, {slash} AS s
  FROM (SELECT DISTINCT file_path, line_num, text FROM messages) WHERE text IS NOT NULL),
p AS (SELECT *, CASE WHEN a.m <> '' THEN {month} || '-' || lpad(a.d, 2, '0') END AS md1, CASE WHEN s.m <> '' THEN lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') END AS md2,
  coalesce(nullif(a.y, ''), '2026') AS y1, CASE WHEN s.y = '' THEN '2026' WHEN length(s.y) = 2 THEN '20' || s.y ELSE s.y END AS y2 FROM t)
SELECT file_path, line_num, unnest(list_distinct(list_filter([y1 || '-' || md1, md1, nullif(iso, ''), y2 || '-' || md2, md2], lambda x: x IS NOT NULL))) AS date FROM p"""


@query("query_dates", _dates_sql())
def query_dates(spark, sf_dir):
    """The dates that messages name."""
    said = table(spark, sf_dir, "messages").select("file_path", "line_num", "text").distinct().where("text is not null")
    rows = said.select("file_path", "line_num", understand.date_patterns(F.col("text"), 2026).alias("d"))
    return rows.select("file_path", "line_num", F.explode("d").alias("date"))


def _synonym_sql():
    each = ["CASE WHEN regexp_matches(text, '(?i)\\b%s\\b') THEN [%s] ELSE [] END" % (k, ", ".join("'%s'" % s for s in v if s != k)) for k, v in understand.SYNONYMS.items()]
    # first places in the flattened list keep the dictionary's order
    return (
        "WITH f AS (SELECT file_path, line_num, flatten([" + ", ".join(each) + "]) AS l FROM messages WHERE text IS NOT NULL), "
        "u AS (SELECT file_path, line_num, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM f), "
        "d AS (SELECT file_path, line_num, s, min(p) AS p FROM u GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY file_path, line_num ORDER BY p) AS n FROM d) "
        "SELECT file_path, line_num, s AS synonym FROM r WHERE n <= 5"
    )


@query("synonyms", _synonym_sql().replace("FROM messages WHERE", "FROM (SELECT DISTINCT file_path, line_num, text FROM messages) WHERE"))
def synonyms(spark, sf_dir):
    said = table(spark, sf_dir, "messages").select("file_path", "line_num", "text").distinct().where("text is not null")
    return said.select("file_path", "line_num", F.explode(understand.expansion(F.col("text"))).alias("synonym"))


@query(
    "type_hints",
    "SELECT file_path, line_num, CASE WHEN " + " OR ".join("contains(lower(text), '%s')" % w for w in understand.CONFIG_WORDS) + " THEN 'config' WHEN "
    + " OR ".join("contains(lower(text), '%s')" % w for w in understand.FACT_WORDS) + " THEN 'fact' END AS hint FROM messages WHERE text IS NOT NULL",
)
def type_hints(spark, sf_dir):
    return table(spark, sf_dir, "messages").where("text is not null").select("file_path", "line_num", understand.type_hint(F.col("text")).alias("hint"))


@query(
    "tier_counts",
    """SELECT CASE WHEN metadata.source = 'transcript' THEN 'secondary' ELSE 'primary' END AS tier, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM chunks GROUP BY 1""",
)
def tier_counts(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy(tier(F.col("metadata.source")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
