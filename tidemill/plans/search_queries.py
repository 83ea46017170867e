"""Queries on retrieval: keyword, vector and entity search, scoring, fusion, reranking, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import models, scoring, store, understand, vector
from tidemill.operators.bm25 import corpus_stats, doc_terms, keyword_scores, postings, top_k
from tidemill.plans import hybrid
from tidemill.plans.registry import query
from tidemill.sources.tables import kept_table, spread, table

AS_OF = "2026-11-01 00:00:00"


def _bm25_sql(docs, queries, k, where="hit = n_terms"):
    return f"""WITH t AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({docs})),
d AS (SELECT id, len(w) AS len FROM t),
st AS (SELECT count(*) AS n_docs, avg(coalesce(len, 0)) AS avgdl FROM d),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, unnest(ts) AS term, len(ts) AS n_terms FROM (
  SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS ts FROM ({queries}))),
s AS (SELECT q.query_id, p.id, q.n_terms, count(*) AS hit,
    sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.len / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN d ON d.id = p.id CROSS JOIN st GROUP BY ALL),
r AS (SELECT query_id, id, round(score, 6) AS score FROM s WHERE {where})
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= {k}"""


def _ranked(df, k):
    best = top_k(df.withColumn("score", F.round("score", 6)), k, "id")
    return best.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "keyword_topk",
    _bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, expect AS query FROM eval_items", 10),
)
def keyword_topk(spark, sf_dir):
    """The ten best documents for each evaluation item's expected words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("expect").alias("query"))
    return _ranked(keyword_scores(docs, asked, fold=False), 10)


_HEADINGS = "SELECT min(id) AS query_id, metadata.heading AS query FROM chunks WHERE metadata.heading IS NOT NULL GROUP BY metadata.heading"


@query("keyword_headings", _bm25_sql("SELECT id, text FROM chunks", _HEADINGS, 20))
def keyword_headings(spark, sf_dir):
    """The chunks that fit each heading best."""
    chunks = table(spark, sf_dir, "chunks")
    asked = chunks.where("metadata.heading is not null").groupBy(F.col("metadata.heading").alias("query")).agg(F.min("id").alias("query_id"))
    return _ranked(keyword_scores(chunks.select("id", "text"), asked, fold=False), 20)


@query(
    "entity_topk",
    _bm25_sql(
        "SELECT id, concat_ws(' ', entity_name, entity_value) AS text FROM entities",
        "SELECT min(id) AS query_id, entity_name AS query FROM entities WHERE entity_type = 'config' AND entity_name IS NOT NULL GROUP BY entity_name", 5,
    ),
)
def entity_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "entities")
    both = rows.select("id", F.concat_ws(" ", "entity_name", "entity_value").alias("text"))
    asked = rows.where("entity_type = 'config' and entity_name is not null").groupBy(F.col("entity_name").alias("query")).agg(F.min("id").alias("query_id"))
    return _ranked(keyword_scores(both, asked, fold=False), 5)


@query(
    "postings",
    r"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
)
def postings_query(spark, sf_dir):
    """Document and corpus frequency of every term."""
    p = postings(doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text", fold=False))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(
    "corpus_stats",
    r"""SELECT count(*) AS n_docs, round(avg(coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 0)), 6) AS avgdl FROM documents""",
)
def corpus_stats_query(spark, sf_dir):
    stats = corpus_stats(doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text", fold=False))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _knn_sql(rows, k):
    return f"""SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id,
      round(greatest(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 0), 6) AS score
    FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q CROSS JOIN ({rows}) e)) WHERE rank <= {k}"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _rounded(found, k):
    return _ranked(found.drop("rank"), k)


@query("knn_topk", _knn_sql("SELECT * FROM embeddings", 10))
def knn_topk(spark, sf_dir):
    """The ten nearest vectors of every twentieth one, among all."""
    rows = _vectors(spark, sf_dir)
    return _rounded(vector.exact_neighbours(rows, rows.where("id % 20 = 0"), 10), 10)


@query(
    "knn_two_tier",
    "SELECT *, 'primary' AS tier FROM (" + _knn_sql("SELECT * FROM embeddings WHERE label % 2 = 0", 5) + ") UNION ALL SELECT *, 'secondary' AS tier FROM ("
    + _knn_sql("SELECT * FROM embeddings WHERE label % 2 = 1", 5) + ")",
)
def knn_two_tier(spark, sf_dir):
    """The five nearest of either half; the label's parity stands for the tier."""
    rows = _vectors(spark, sf_dir).withColumn("tier", F.when(F.col("label") % 2 == 0, "primary").otherwise("secondary"))
    found = vector.two_tier(rows, rows.where("id % 20 = 0"), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "tier")


@query("knn_index_recall")
def knn_index_recall(spark, sf_dir):
    """Recall of the inverted file against brute force: one row per query."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 20 = 0")
    true = vector.exact_neighbours(rows, asked, 10).select("query_id", "id")
    found = vector.InvertedFile.fit(rows).search(rows, asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query(
    "temporal_decay",
    f"""SELECT id, round(coalesce(pow(0.5, greatest(floor(epoch(TIMESTAMPTZ '{AS_OF}+00') - epoch(indexed_at)) / 86400, 0)::BIGINT / 30), 1), 6) AS factor
FROM (SELECT id, date_trunc('second', indexed_at) AS indexed_at FROM chunks)""".replace(
        "greatest(floor(epoch(TIMESTAMPTZ '" + AS_OF + "+00') - epoch(indexed_at)) / 86400, 0)::BIGINT",
        "greatest(floor((epoch(TIMESTAMPTZ '" + AS_OF + "+00') - epoch(indexed_at)) / 86400), 0)",
    ),
)
def temporal_decay(spark, sf_dir):
    f = scoring.temporal_factor(F.col("indexed_at"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "chunks").select("id", F.round(f, 6).alias("factor"))


@query(
    "source_and_type_boost",
    """SELECT id, CASE WHEN metadata.source = 'transcript' THEN -0.18 ELSE 0.1 END::DOUBLE AS source_boost,
  CASE WHEN metadata.type = 'config' THEN 0.2 ELSE 0.0 END::DOUBLE AS config_boost,
  CASE WHEN metadata.type = 'todo' THEN 0.15 WHEN metadata.type = 'fact' THEN 0.15 ELSE 0.0 END::DOUBLE AS fact_boost FROM chunks""",
)
def source_and_type_boost(spark, sf_dir):
    kind, none = F.col("metadata.type"), F.lit(None).cast("string")
    return table(spark, sf_dir, "chunks").select(
        "id", scoring.source_boost(F.col("metadata.source")).alias("source_boost"),
        scoring.type_boost(kind, F.lit("config"), none).alias("config_boost"), scoring.type_boost(kind, F.lit("fact"), F.lit("todo")).alias("fact_boost"),
    )


@query(
    "intent_boost",
    r"""WITH h AS (SELECT id, text, lower(text) AS t FROM chunks WHERE text IS NOT NULL)
SELECT id, round(least(0.35,
  CASE WHEN regexp_matches(text, '(?i)\d+\.\d+\.\d+\.\d+|port\s*\d+') THEN 0.25
    WHEN contains(t, 'ip')::INT + contains(t, 'port')::INT + contains(t, 'host')::INT + contains(t, 'server')::INT + contains(t, 'config')::INT + contains(t, 'address')::INT >= 2 THEN 0.15
    WHEN contains(t, 'ip') OR contains(t, 'port') OR contains(t, 'host') OR contains(t, 'server') OR contains(t, 'config') OR contains(t, 'address') THEN 0.08 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)\$[\d,]+|\d+\s*(?:dollars|USD)') THEN 0.25
    WHEN contains(t, 'money')::INT + contains(t, 'cost')::INT + contains(t, 'price')::INT + contains(t, 'revenue')::INT + contains(t, 'salary')::INT + contains(t, 'budget')::INT >= 2 THEN 0.15
    WHEN contains(t, 'money') OR contains(t, 'cost') OR contains(t, 'price') OR contains(t, 'revenue') OR contains(t, 'salary') OR contains(t, 'budget') THEN 0.08 ELSE 0 END)::DOUBLE, 6) AS boost
FROM h""",
)
def intent_boost(spark, sf_dir):
    """What a query on configuration and money would add to each chunk."""
    names = F.array(F.lit("config"), F.lit("financial"))
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", F.round(scoring.intent_boost(F.col("text"), names), 6).alias("boost"))


@query(
    "recency_boost",
    f"""WITH d AS (SELECT id, nullif(regexp_extract(file_path, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS p, indexed_at::DATE AS i FROM chunks)
SELECT id, round(coalesce(greatest(0, 0.5::DOUBLE * (1 - greatest(date_diff('day', CASE WHEN p IS NULL THEN i ELSE try_cast(p AS DATE) END, DATE '{AS_OF[:10]}'), 0) / 365.0::DOUBLE)), 0), 6)::DOUBLE AS boost
FROM d""",
)
def recency_boost(spark, sf_dir):
    from tidemill.functions.text import path_date

    b = scoring.recency_boost(path_date(F.col("file_path")), F.col("indexed_at"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "chunks").select("id", F.round(b, 6).alias("boost"))


@query(
    "when_boost",
    r"""SELECT id, round(least(0.3, 0.1 * len(regexp_extract_all(text,
  '(?i)\b\d{4}-\d{2}-\d{2}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b')))::DOUBLE, 6) AS boost
FROM chunks WHERE text IS NOT NULL""",
)
def when_boost(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where("text is not null").select("id", F.round(scoring.when_boost(F.col("text")), 6).alias("boost"))


_SIDES = {"a": ("eskdale", "rota"), "b": ("norwick", "budget")}


@query(
    "fuse_outer",
    """WITH v AS (SELECT id, length(text)::BIGINT AS semantic FROM chunks WHERE contains(lower(text), 'eskdale')),
k AS (SELECT id, chars::BIGINT AS keyword FROM chunks WHERE contains(lower(text), 'budget'))
SELECT coalesce(v.id, k.id) AS id, semantic, keyword FROM v FULL OUTER JOIN k ON v.id = k.id""",
)
def fuse_outer(spark, sf_dir):
    """The full outer join of two candidate sets by chunk."""
    c = table(spark, sf_dir, "chunks")
    one = F.lit(1).alias("query_id")
    v = c.where(F.lower("text").contains("eskdale")).select(one, "id", F.length("text").cast("bigint").alias("score"))
    k = c.where(F.lower("text").contains("budget")).select(one, "id", F.col("chars").cast("bigint").alias("score"))
    return hybrid.fused(v, k).drop("query_id")


@query(
    "neighbours",
    """SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY file_path ORDER BY line_start NULLS FIRST, id)""",
)
def neighbours(spark, sf_dir):
    return store.neighbours(table(spark, sf_dir, "chunks"))


@query(
    "hash_dedup",
    """SELECT id FROM chunks QUALIFY row_number() OVER (
  PARTITION BY metadata.source, coalesce(nullif(metadata.hash, ''), 'id:' || id) ORDER BY length(text) DESC NULLS LAST, id) = 1""",
)
def hash_dedup(spark, sf_dir):
    """One chunk of each content hash in each tier: the longest."""
    c = table(spark, sf_dir, "chunks").select("id", F.col("metadata.source").alias("source"), F.col("metadata.hash").alias("hash"), "text")
    key = F.coalesce(F.nullif("hash", F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    return store.first_by_hash(c, "source", key, F.length("text").desc_nulls_last(), F.col("id")).select("id")


@query(
    "accuracy_by_category",
    "WITH found AS (" + _bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, expect AS query FROM eval_items", 5) + """),
hit AS (SELECT f.query_id, max(contains(lower(d.text), lower(e.expect))::INT) AS ok FROM found f JOIN documents d ON d.doc_id = f.id
  JOIN eval_items e ON e.item_id = f.query_id GROUP BY 1)
SELECT category, count(*) AS n, sum(coalesce(ok, 0))::BIGINT AS passed, round(100.0::DOUBLE * sum(coalesce(ok, 0)) / count(*), 6) AS pct
FROM eval_items LEFT JOIN hit ON query_id = item_id GROUP BY category""",
)
def accuracy_by_category(spark, sf_dir):
    """Share of evaluation items whose expected words stand in one of the five best documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "eval_items")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("expect").alias("query"))
    found = _ranked(keyword_scores(docs, asked, fold=False), 5).join(docs, "id").join(asked, "query_id")
    hit = found.groupBy("query_id").agg(F.max(F.lower("text").contains(F.lower("query")).cast("int")).alias("ok"))
    return items.join(hit, items["item_id"] == hit["query_id"], "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("passed"),
        F.round(100 * F.sum(F.coalesce("ok", F.lit(0))) / F.count(F.lit(1)), 6).alias("pct"),
    )


def _corpus(spark, sf_dir):
    c = table(spark, sf_dir, "chunks").select(
        "id", "file_path", "line_start", "line_end", "text", "indexed_at", F.col("metadata.type").alias("kind"),
        F.col("metadata.source").alias("source"), F.col("metadata.hash").alias("hash"),
    )
    embedded = models.embed(spread(c.where("text is not null")), "text")
    # the index: embedded once, read by every part of the search
    return kept_table(embedded)


def _questions(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "query")
    said = models.embed(items.withColumn("said", understand.expanded(F.col("query"))), "said").drop("said")
    return kept_table(said)


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    """The whole search for every twentieth evaluation item, against all chunks."""
    return hybrid.search(_corpus(spark, sf_dir), table(spark, sf_dir, "entities"), _questions(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


@query("hybrid_report")
def hybrid_report(spark, sf_dir):
    """The same, as one markdown report a query."""
    corpus = _corpus(spark, sf_dir)
    found = hybrid.search(corpus, table(spark, sf_dir, "entities"), _questions(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), max_results=3)
    return hybrid.format_results(found, corpus)
