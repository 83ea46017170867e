"""Embedding and pair-scoring models behind two small interfaces, with built-in stand-ins.

Real models plug in as functions on lists; a task loads one once and feeds it Arrow batches. The
stand-ins need no files: feature hashing of words for vectors, word overlap for pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import tokens
from tidemill.operators.scoring import blended

DIM = 384


class _Hashes(dict):
    """The 8-byte hashes of words, each computed when first asked for."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_digest(word)
        return got


_HASHES = _Hashes()


def hashed_embedding(words: list[str], dim: int = DIM) -> np.ndarray:
    """Signed feature hashing of words and pairs of words, to unit length; all zero without a word."""
    one = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two = two ^ (two >> np.uint64(29))
    h = np.r_[one, two]
    v = np.bincount(((h >> np.uint64(1)) % np.uint64(dim)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0), dim).astype(np.float32)
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(df: DataFrame, text: str, out: str = "vector", model: Callable[[], Callable[[list[list[str]]], list]] | None = None) -> DataFrame:
    """``df`` with a vector for each text; null texts have none. ``model`` is called once a task."""
    make = model or (lambda: lambda texts: [hashed_embedding(t) for t in texts])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for words in batches:
            yield pd.Series(list(encode([list(w) if w is not None else [] for w in words])), dtype=object)

    return df.withColumn(out, F.when(F.col(text).isNotNull(), run(tokens(F.col(text)))))


def overlap_logit(query: Column, text: Column) -> Column:
    """A lexical pair score: the share of the query's words in the text, as a logit between -4 and 4."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)) * 8 - 4


def rerank(ranked: DataFrame, logit: Column, pool: int = 10, weight: float = 0.4, top: int = 10) -> DataFrame:
    """The first ``pool`` rows of each query scored anew: (.., rerank_raw, blended, rank), best first.

    ``ranked`` has (query_id, id, score, rank). Scores are scaled to the pool's range, 1 where there is none.
    """
    held = ranked.where(F.col("rank") <= pool).withColumn("rerank_raw", logit)
    w = Window.partitionBy("query_id")
    mixed = held.withColumn(
        "blended", blended(F.col("score"), F.min("score").over(w), F.max("score").over(w), F.col("rerank_raw"), weight)
    )
    best = w.orderBy(F.col("blended").desc(), "id")
    return mixed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
