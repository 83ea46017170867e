"""Nearest vectors: an exact search in blocks, and an inverted file fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: vectors of one block of queries, which meets every block of rows once
QUERY_BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as a column; null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows, without a detour over Python's lists."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    m = np.asarray(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of a row: by score, ties by id."""
    if len(scores) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= low)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def exact_neighbours(
    rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "vector", group: str | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of each query by cosine, at least 0.

    With ``group`` the k best of each of its values, and that column besides. Queries are packed into
    blocks; each partition of rows meets one block after the other, keeps the k best of each query,
    and only those are shuffled. A query finds itself if it is among the rows. Rows and queries with a
    null id or vector are left out.
    """
    q = queries.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v")
    )
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    blocks = (
        q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        .groupBy("block").agg(F.collect_list(F.struct("query_id", "v")).alias("qs"))
    )
    parts = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit("")).cast("string").alias("g")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, m, names = batch.column(0).to_numpy(), _matrix(batch.column(1)), np.array(batch.column(2).to_pylist(), object)
            for g in sorted({x for x in names if x is not None}) + ([None] if None in names else []):
                at = np.flatnonzero(names == g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.string()), pa.ListArray.from_arrays([0, len(at)], ids[at]), pa.ListArray.from_arrays([0, m[at].size], m[at].ravel())],
                    names=["g", "ids", "vs"],
                )

    packed = parts.mapInArrow(pack, "g string, ids array<bigint>, vs array<double>")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                g, ids, vs, qs = (batch.column(i)[r] for i in range(4))
                ids, asked = ids.values.to_numpy(), qs.values.field(0).to_numpy()
                m = _unit(vs.values.to_numpy().reshape(len(ids), -1))
                sims = np.maximum(_unit(_matrix(qs.values.field(1))) @ m.T, 0.0)
                best = [_best(ids, s, k) for s in sims]
                a, at = np.repeat(asked, [len(x) for x in best]), np.concatenate(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.as_py()] * len(a), pa.string()), pa.array(a), pa.array(ids[at]), pa.array(np.concatenate([s[x] for s, x in zip(sims, best)]))],
                    names=["g", "query_id", "id", "score"],
                )

    # a stated query set against all rows, block by block
    near = packed.crossJoin(F.broadcast(blocks) if n_blocks <= 8 else blocks).select("g", "ids", "vs", "qs").mapInArrow(
        match, "g string, query_id bigint, id bigint, score double"
    )
    best = Window.partitionBy("query_id", "g").orderBy(F.col("score").desc(), "id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("g", group) if group else ranked.drop("g")


def two_tier(rows: DataFrame, queries: DataFrame, k: int, tier: str = "tier", **names: str) -> DataFrame:
    """The k best of either tier for each query, in one pass over the rows: (query_id, id, score, rank, tier)."""
    return exact_neighbours(rows, queries, k, group=tier, **names)


class InvertedFile:
    """Centroids fitted on a bounded sample; every row is indexed under its nearest ones."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    @classmethod
    def fit(cls, rows: DataFrame, lists: int = 16, sample: int = 20_000, vector: str = "vector", id_col: str = "id", rounds: int = 12) -> InvertedFile:
        """Spherical k-means on the ``sample`` rows whose ids hash lowest."""
        picked = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector).toPandas()[vector]
        if not len(picked):
            return cls(np.zeros((1, 1)))
        m = _unit(picked.to_list())
        c = m[:: max(1, len(m) // lists)][:lists].copy()
        for _ in range(rounds):
            at = (m @ c.T).argmax(1)
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = m[at == j].mean(0)
            c = _unit(c)
        return cls(c)

    def assign(self, df: DataFrame, vector: str, probes: int) -> DataFrame:
        """``df`` once per list among the ``probes`` nearest, with the list's number in ``list_id``."""
        c = self.centroids

        @F.pandas_udf("array<int>")
        def near(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.argsort(-(_unit(v.to_list()) @ c.T), axis=1)[:, :probes].astype(np.int32)))

        return df.where(F.col(vector).isNotNull()).withColumn("list_id", F.explode(near(vector)))

    def search(self, rows: DataFrame, queries: DataFrame, k: int, probes: int = 12, id_col: str = "id", vector: str = "vector") -> DataFrame:
        """(query_id, id, score, rank) among the rows of the ``probes`` lists nearest to each query."""
        indexed = self.assign(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v", 1)
        asked = self.assign(queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("q")), "q", probes)
        scored = indexed.join(asked, "list_id").select("query_id", "id", F.greatest(cosine(F.col("v"), F.col("q")), F.lit(0.0)).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
