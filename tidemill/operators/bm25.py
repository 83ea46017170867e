"""Keyword ranking: an inverted index as tables, BM25 over a table of queries.

score(q, d) = sum over q's terms of idf(t) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * |d| / avgdl)),
idf(t) = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. A document must hold every term of the query, or
of one of its alternatives where it says OR, and none of what follows a NOT (``units``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import tokens
from tidemill.sources.tables import kept_table

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: up to so many distinct query terms are broadcast; beyond, postings and terms are both shuffled
BROADCAST_TERMS = 500_000


def doc_terms(docs: DataFrame, id_col: str, text: str, fold: bool = True) -> DataFrame:
    """(id, len, terms): each document's tokens and their number; null texts have none."""
    t = F.coalesce(tokens(F.col(text), fold), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("id"), t.alias("terms")).withColumn("len", F.size("terms"))


def postings(terms: DataFrame) -> DataFrame:
    """(term, id, len, tf): one row per term of a document, counted before the shuffle."""
    return terms.select("id", "len", F.explode("terms").alias("term")).groupBy("term", "id", "len").agg(
        F.count(F.lit(1)).alias("tf")
    )


def corpus_stats(terms: DataFrame) -> DataFrame:
    """(n_docs, avgdl): one row."""
    return terms.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl"))


def units(query: Column) -> Column:
    """The alternatives of a query: an array, by OR, of arrays of texts: what must be there, then what must not.

    OR, NOT and AND are operators in capital letters between words; AND says what a blank says. A query
    with an operator that lacks a side has no alternatives, and so no answer.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(query, r"[!-/:-@\[-^`{-~]", " "), r"\s+", " "))
    joined = F.regexp_replace(plain, r"(?<=\S) AND (?=\S)", " ")
    parts = F.transform(F.split(joined, r"(?:^| )OR(?: |$)", -1), lambda g: F.split(g, r"(?:^| )NOT(?: |$)", -1))
    broken = F.exists(parts, lambda g: F.exists(g, lambda u: (F.trim(u) == "") | u.rlike(r"(?:^| )AND(?: |$)")))
    return F.when(broken, F.array().cast("array<array<string>>")).otherwise(parts)


def query_terms(queries: DataFrame, query_id: str, query: str, fold: bool = True) -> DataFrame:
    """(query_id, alternative, unit, term, n_terms): the distinct terms of each unit of a query; unit 0 must be there.

    Queries without a term vanish.
    """
    parts = queries.select(F.col(query_id).alias("query_id"), F.posexplode(units(F.col(query))).alias("alternative", "us"))
    parts = parts.select("query_id", "alternative", F.posexplode("us").alias("unit", "u"))
    distinct = F.array_distinct(tokens(F.col("u"), fold))
    return parts.select("query_id", "alternative", "unit", F.explode(distinct).alias("term"), F.size(distinct).alias("n_terms"))


def top_k(scored: DataFrame, k: int, *tie: str, of: str = "query_id") -> DataFrame:
    """The k best rows of each query, ranked from 1; Spark limits each group before its shuffle."""
    best = Window.partitionBy(of).orderBy(F.col("score").desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def keyword_scores(
    docs: DataFrame, queries: DataFrame, id_col: str = "id", text: str = "text", query_id: str = "query_id",
    query: str = "query", fold: bool = True,
) -> DataFrame:
    """(query_id, id, score) of every document that holds all terms of a query.

    Only terms that some query asks for leave the scan, and one row a document; document frequencies are
    counted over all documents, repeated ids of one length as one. Work grows with the postings of the asked terms.
    """
    asked = query_terms(queries, query_id, query, fold)
    vocabulary = asked.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    if vocabulary.count() <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    # each document also holds the empty term, once: its row stands for the document in the statistics, so
    # texts are cut into tokens once for all that follows
    terms = doc_terms(docs, id_col, text, fold).select("id", "len", F.explode(F.array_append("terms", F.lit(""))).alias("term"))
    held = kept_table(terms.join(vocabulary, "term", "left_semi").groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")))
    stats, found = corpus_stats(held.where("term = ''")), held.where("term <> ''")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row by its nature: an aggregate without a key
    weighted = df.join(F.broadcast(stats)).select(
        "term",
        "avgdl",
        F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR)).alias("idf"),
    )
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    weighed = found.join(weighted, "term").select("term", "id", part.alias("part"))
    # a query is one unit unless it says OR or NOT; only those with more need a second look
    met = weighed.join(asked, "term").groupBy("query_id", "id", "alternative", "unit", "n_terms").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("hit"))
    whole = met.where(F.col("hit") == F.col("n_terms"))
    many = asked.where((F.col("alternative") > 0) | (F.col("unit") > 0)).select("query_id").distinct()
    n_many = many.count()
    if not n_many:
        return whole.select("query_id", "id", "score")
    many = F.broadcast(many) if n_many <= BROADCAST_TERMS else many
    sides = whole.join(many, "query_id", "left_semi").groupBy("query_id", "id", "alternative").agg(
        F.count_if(F.col("unit") == 0).alias("is_met"), F.count_if(F.col("unit") > 0).alias("is_barred"), F.sum(F.when(F.col("unit") == 0, F.col("score"))).alias("score")
    )
    chosen = sides.where("is_met = 1 and is_barred = 0").groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    return whole.join(many, "query_id", "left_anti").select("query_id", "id", "score").unionByName(chosen)
