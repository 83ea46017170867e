"""The hybrid search over a table of queries: three candidate sources, fused, scored, cut and reranked.

``search`` takes a corpus (id, file_path, text, indexed_at, kind, source, hash, vector), entities (chunk_id, entity_name,
entity_value) and queries (query_id, query, vector), and answers all queries in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import path_date, tier
from tidemill.operators import scoring
from tidemill.operators.bm25 import keyword_scores, top_k
from tidemill.operators.models import overlap_logit, rerank
from tidemill.operators.store import first_by_hash, neighbours
from tidemill.operators.understand import date_patterns, has_words, intents, proper_nouns, temporal_mode, type_hint
from tidemill.operators.vector import two_tier
from tidemill.sources.tables import kept_table

CANDIDATES, TEMPORAL_FACTOR, ENTITY_LIMIT, SINGLE_LIMIT, INJECTED = 5, 3, 5, 3, 0.5
ADJACENT_TOP, ADJACENT_FLOOR, ADJACENT_SHARE = 3, 0.3, 0.5


def understood(queries: DataFrame, default_year: int) -> DataFrame:
    """Queries with some word in them, with (intents, dates, mode, hint)."""
    q = F.col("query")
    return queries.where(has_words(q)).withColumns(
        {"intents": intents(q), "dates": date_patterns(q, default_year), "mode": temporal_mode(q), "hint": type_hint(q)}
    )


def entity_probes(queries: DataFrame) -> DataFrame:
    """(query_id, stage, part, probe, width): what the entities are asked: the query, pairs of its names, single names."""
    names = proper_nouns(F.col("query"))
    pairs = F.transform(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), lambda n, i: F.concat_ws(" ", n, F.get(names, i + 1)))
    stage = lambda n, texts, width: F.transform(
        texts, lambda t, i: F.struct(F.lit(n).alias("stage"), i.alias("part"), t.alias("probe"), F.lit(width).alias("width"))
    )
    cleaned = F.trim(F.regexp_replace("query", r"(?U)[^\w\s]", ""))
    all_ = F.concat(stage(1, F.array(cleaned), ENTITY_LIMIT), stage(2, pairs, ENTITY_LIMIT), stage(3, names, SINGLE_LIMIT))
    return queries.select("query_id", F.explode(all_).alias("p")).select("query_id", "p.*")


def entity_hits(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks of the best entities whose name and value hold all words of a probe.

    The probes of all stages are ranked in one pass; of each query the first stage with a hit counts. Of a
    pair's hits those count in which both names stand as written, or else the first three.
    """
    both = entities.select("id", "chunk_id", F.concat_ws(" ", "entity_name", "entity_value").alias("text"))
    probes = entity_probes(queries).withColumn("pid", F.xxhash64("query_id", "stage", "part"))
    ranked = top_k(keyword_scores(both, probes.select("pid", "probe"), query_id="pid", query="probe").withColumnRenamed("query_id", "pid"), ENTITY_LIMIT, "id", of="pid")
    said = ranked.join(probes, "pid").where(F.col("rank") <= F.col("width")).join(both, "id")
    as_written = F.forall(F.split(F.lower("probe"), " "), lambda w: F.contains(F.lower("text"), w))
    of_pair = Window.partitionBy("pid")
    said = said.withColumn("named", as_written).withColumn("some", F.max("named").over(of_pair))
    kept = said.where((F.col("stage") != 2) | F.col("named") | (~F.col("some") & (F.col("rank") <= SINGLE_LIMIT)))
    first = kept.withColumn("first", F.min("stage").over(Window.partitionBy("query_id"))).where(F.col("stage") == F.col("first"))
    return first.select("query_id", "chunk_id").distinct()


def dated_chunks(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id): chunks whose path holds a date that a query on a certain date names."""
    wanted = asked.where("mode = 'specific_date'").select("query_id", F.explode("dates").alias("date")).distinct()
    held = F.concat(*[F.regexp_extract_all("file_path", F.lit(f"(?=({p}))"), F.lit(1)) for p in (r"\d{4}-\d{2}-\d{2}", r"\d{2}-\d{2}")])
    dated = corpus.where(F.col("file_path").rlike(r"\d{2}-\d{2}")).select("id", F.explode(F.array_distinct(held)).alias("date"))
    return dated.join(wanted, "date").select("query_id", "id").distinct()


def fused(vector_side: DataFrame, keyword_side: DataFrame) -> DataFrame:
    """(query_id, id, semantic, keyword): the full outer join of both sides."""
    v = vector_side.select("query_id", "id", F.col("score").alias("semantic"))
    k = keyword_side.select("query_id", "id", F.col("score").alias("keyword"))
    return v.join(k, ["query_id", "id"], "full_outer")


def combined_score(as_of: Column, prefer: Column) -> Column:
    """Rows found by vector (or injected) and rows found by keyword only have formulas of their own."""
    best = F.max("keyword").over(Window.partitionBy("query_id"))
    intent = scoring.intent_boost(F.col("text"), F.col("intents"))
    decay = scoring.temporal_factor(F.col("indexed_at"), as_of)
    dated = scoring.date_boost(F.col("file_path"), F.col("dates"), F.col("mode"))
    full = (
        F.col("semantic") + scoring.keyword_boost(F.col("keyword"), best)
        + scoring.type_boost(F.coalesce("kind", F.lit("narrative")), F.col("hint"), prefer) + scoring.source_boost(F.col("source"))
        + scoring.entity_boost(F.coalesce("chunk_hit", F.lit(False)), F.coalesce("file_hit", F.lit(False))) + intent + dated
    ) * decay
    norm = F.coalesce(F.col("keyword") / F.nullif(best, F.lit(0.0)), F.lit(0.0))
    keyword_only = (
        0.25 + 0.5 * norm + F.when(F.col("source") == "transcript", -0.15).otherwise(0.0) + intent + F.when(dated > 0, 0.3).otherwise(0.0)
    ) * decay
    return F.when(F.col("semantic").isNotNull(), full).otherwise(keyword_only)


def search(
    corpus: DataFrame, entities: DataFrame, queries: DataFrame, as_of: Column, max_results: int = 10, min_score: float = 0.0,
    prefer_type: str | None = None, default_year: int = 2026, pool: int | None = 10,
) -> DataFrame:
    """(query_id, rank, id, file_path, score, semantic, keyword): the answer of every query.

    ``pool=None`` leaves the pair model out. Queries without a word have no answer.
    """
    asked = understood(queries, default_year)
    limit = max_results * CANDIDATES * TEMPORAL_FACTOR
    width = F.when(F.col("mode").isNull(), max_results * CANDIDATES).otherwise(limit)
    widths = asked.select("query_id", width.alias("width"))
    keep = lambda df: df.join(widths, "query_id").where(F.col("rank") <= F.col("width")).drop("width")
    keyword_side = keep(top_k(keyword_scores(corpus, asked), limit, "id"))
    rows = corpus.withColumn("tier", tier(F.col("source")))
    vectors = two_tier(rows, asked.select(F.col("query_id").alias("id"), "vector"), limit)
    hits = kept_table(entity_hits(entities, asked))
    named = hits.withColumnRenamed("chunk_id", "id").withColumn("chunk_hit", F.lit(True))
    # chunks of asked dates and of found entities that the vectors did not bring come in at a fixed score
    base = keep(vectors).select("query_id", "id", "score")
    brought = dated_chunks(corpus, asked).unionByName(named.select("query_id", "id")).distinct()
    injected = brought.join(base, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(INJECTED).alias("score"))
    pairs = fused(base.unionByName(injected), keyword_side)
    paths = hits.join(corpus.select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id").select("query_id", "file_path").distinct()
    rich = (
        pairs.join(corpus.drop("vector"), "id")
        .join(asked.drop("vector"), "query_id")
        .join(named, ["query_id", "id"], "left")
        .join(paths.withColumn("file_hit", F.lit(True)), ["query_id", "file_path"], "left")
    )
    prefer = F.lit(prefer_type).cast("string")
    # few rows a query, read by the adjacency rule three times: computed once
    scored = kept_table(rich.withColumn("score", combined_score(as_of, prefer)))
    scored = scored.unionByName(_adjacent(scored, corpus), allowMissingColumns=True)
    mode = F.col("mode")
    again = F.when(mode == "recency", scoring.recency_boost(path_date(F.col("file_path")), F.col("indexed_at"), as_of)).when(
        mode == "when", scoring.when_boost(F.col("text"))
    )
    scored = scored.withColumn("score", F.col("score") + F.coalesce(again, F.lit(0.0)))
    key = F.coalesce(F.nullif("hash", F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    unique = first_by_hash(scored, "query_id", key, F.col("score").desc(), F.col("id")).where(F.col("score") >= min_score)
    ranked = top_k(unique, max(max_results, pool or 0), "id")
    if pool:
        ranked = rerank(ranked, overlap_logit(F.col("query"), F.col("text")), pool, top=max_results).withColumn("score", F.col("blended"))
    return ranked.where(F.col("rank") <= max_results).select("query_id", "rank", "id", "file_path", "score", "semantic", "keyword")


def _adjacent(scored: DataFrame, corpus: DataFrame) -> DataFrame:
    """The neighbours in file of each query's three best vector-side rows, at half their score plus intent."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").desc())
    top = (
        scored.where("semantic is not null").withColumn("nth", F.row_number().over(best))
        .where((F.col("nth") <= ADJACENT_TOP) & (F.col("score") >= ADJACENT_FLOOR)).select("query_id", "id", "score", "nth")
    )
    beside = neighbours(corpus).join(top, "id").select("query_id", "score", "nth", F.explode(F.array("prev_id", "next_id")).alias("id")).where("id is not null")
    first = beside.groupBy("query_id", "id").agg(F.min_by("score", "nth").alias("parent"))
    fresh = first.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
    context = scored.select("query_id", "query", "intents", "dates", "mode", "hint").dropDuplicates(["query_id"])
    rows = fresh.join(corpus.drop("vector"), "id").join(context, "query_id")
    return rows.withColumn("score", ADJACENT_SHARE * F.col("parent") + scoring.intent_boost(F.col("text"), F.col("intents"))).drop("parent")


def format_results(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, report): one markdown block a query, results in order of rank."""
    rows = found.join(corpus.select("id", "text", "line_start", "line_end"), "id")
    name = F.element_at(F.split("file_path", "/"), -1)
    block = F.format_string(
        "**%d. %s** (lines %d-%d, score %.3f)\n```\n%s\n```", F.col("rank"), name, F.col("line_start"), F.col("line_end"), F.col("score"), F.col("text")
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda r: r["block"]), "\n\n").alias("report"))
