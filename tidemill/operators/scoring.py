"""Score terms of the hybrid search as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.operators.understand import INTENTS, any_match

# The half life, the caps, and the weights of the terms below.
HALF_LIFE_DAYS, KEYWORD_CAP, INTENT_CAP = 30, 0.4, 0.35


def keyword_boost(score: Column, best: Column) -> Column:
    """The keyword score as a share of the query's best, at most 0.4."""
    return F.least(F.lit(KEYWORD_CAP), F.coalesce(score, F.lit(0.0)) / F.coalesce(F.nullif(best, F.lit(0.0)), F.lit(1.0)) * KEYWORD_CAP)


def temporal_factor(indexed_at: Column, as_of: Column) -> Column:
    """Half as much every 30 whole days; 1 for the future and where no time is known."""
    days = F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(indexed_at)) / 86_400), F.lit(0))
    return F.coalesce(F.pow(F.lit(0.5), days / HALF_LIFE_DAYS), F.lit(1.0))


def type_boost(kind: Column, hint: Column, prefer: Column) -> Column:
    """0.15 for a preferred type; else by the query's hint: config 0.2, fact 0.15."""
    return (
        F.when(prefer.isNotNull() & (kind == prefer), 0.15)
        .when((hint == "config") & (kind == "config"), 0.2)
        .when((hint == "fact") & (kind == "fact"), 0.15)
        .otherwise(0.0)
    )


def source_boost(source: Column) -> Column:
    return F.when(source == "transcript", -0.18).otherwise(0.1)


def entity_boost(chunk_hit: Column, file_hit: Column) -> Column:
    return F.when(chunk_hit, 0.4).when(file_hit, 0.1).otherwise(0.0)


def intent_boost(text: Column, names: Column) -> Column:
    """Per intent of the query: 0.25 for a pattern in the text, else 0.15 for two words, 0.08 for one; at most 0.35."""
    low, total = F.lower(text), F.lit(0.0)
    for name, (_, words, patterns) in INTENTS.items():
        hits = F.size(F.filter(F.split(F.lit("|".join(words)), r"\|"), low.contains))
        own = F.when(any_match(text, patterns), 0.25).when(hits >= 2, 0.15).when(hits == 1, 0.08).otherwise(0.0)
        total = total + F.when(F.array_contains(names, name), own).otherwise(0.0)
    return F.least(F.lit(INTENT_CAP), total)


def date_boost(path: Column, dates: Column, mode: Column) -> Column:
    """0.3 if the path holds one of the query's dates, 0.8 if the query asks for that date."""
    hit = F.exists(F.coalesce(dates, F.array().cast("array<string>")), lambda d: path.contains(d))
    return F.when(hit & (mode == "specific_date"), 0.8).when(hit, 0.3).otherwise(0.0)


def recency_boost(path_date: Column, indexed_at: Column, as_of: Column) -> Column:
    """0.5 falling to 0 over a year, by the path's date, else the time of indexing; 0 for impossible dates."""
    days = F.datediff(as_of.cast("date"), F.coalesce(path_date.try_cast("date"), F.when(path_date.isNull(), indexed_at.cast("date"))))
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(0.5) * (1 - F.greatest(days, F.lit(0)) / 365.0)), F.lit(0.0))


def when_boost(text: Column) -> Column:
    """0.1 a date named in the text, at most 0.3."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return F.least(F.lit(0.3), F.regexp_count(text, F.lit(rf"(?i)\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{months})\s+\d{{1,2}}\b")) * 0.1)


def blended(original: Column, low: Column, high: Column, logit: Column, weight: float = 0.4) -> Column:
    """The original score, scaled to the pool, and the model's probability, weighted."""
    scaled = F.when(high > low, (original - low) / (high - low)).otherwise(1.0)
    return weight * scaled + (1 - weight) / (1 + F.exp(-logit))
