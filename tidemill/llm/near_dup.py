"""Near-duplicate texts by SetSketch registers, bands, joint likelihood and exact verification.

A text is the set of its runs of three consecutive words (words are runs of letters, digits and
underscores, in lower case). Of this set a SetSketch is kept: register i is the floor of the
logarithm, to a base slightly above one, of the smallest exponential hash i over the set, truncated
to 16 bits. Registers are maxima of logarithms, so sketches of parts merge by maximum (``merged``),
and two registers are equal with a probability slightly above the sets' Jaccard similarity. Stages:

1. each text is read once and sketched where it lies; a text that the same task has met before is
   left out (a third of all rows may be copies of one text, and copies are equal at sight);
2. the registers are cut into ``BANDS`` bands of ``ROWS``; texts that agree in a whole band share a
   bucket. At similarity 0.6 a register is equal with 0.604, so a pair shares no band with
   (1 - 0.604 ** 4) ** 72, 3 in 100,000, with 7 in a million at 0.62 and 5 in 10 million at 0.65;
3. a bucket of up to ``BUCKET_LIMIT`` texts gives its pairs. The texts of larger buckets are joined by
   an exact prefix filter instead: a text offers its rarest runs only, as many as it must for no pair
   to be lost, a run that many texts share is split into blocks over many tasks, and a pair is given at
   the first run that it shares, so once;
4. candidates are estimated twice: first by the registers' last bits, of which two texts share half
   where their registers differ, then by maximum likelihood from which registers are equal, larger and
   smaller, jointly with the set sizes. Both drop what lies ``ERRORS`` standard errors below the
   threshold (3 pairs in 10 million at the threshold itself);
5. the rest is verified on the runs of words themselves, and each pair of texts expanded to its copies' ids.

Texts are named by a 64-bit hash of the text (two of 10 billion different texts share one with a
probability near 1, two of 100 million with 0.0003); copies are told by two such hashes. Null texts and
texts without a word have no pair. Texts with one or two words count as one run. Other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.hashing import Words, run_hashes
from tidemill.sources.tables import cut_lineage, kept_table

BANDS, ROWS = 72, 4
REGISTERS = BANDS * ROWS
BASE = 1.02
_SHIFT = math.log(32) / math.log(BASE)
_TOP = 65_534
#: standard errors below the threshold that an estimate may lie
ERRORS = 5
#: texts of larger buckets are joined by the prefix filter, and runs of more texts in blocks of so many
BUCKET_LIMIT = 500
#: up to so many texts to estimate or verify, their names (8 bytes each) are broadcast; beyond, texts are shuffled
BROADCAST_TEXTS = 1_000_000
SEEN_KEPT = 1_000_000

_WORD = re.compile(r"\w+")
_STEP = 256


def shingles(text: str, width: int, words: Words) -> np.ndarray:
    """The 64-bit hashes of the different runs of ``width`` words of a text, sorted."""
    return np.unique(run_hashes(words.hashes(_WORD.findall(text.lower())), width))


@lru_cache(maxsize=4)
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_101).integers(0, 2**32, (2, n), dtype=np.uint32) | np.uint32(1)


def minima(runs: np.ndarray, starts: np.ndarray | None = None, registers: int = REGISTERS) -> np.ndarray:
    """The smallest 32-bit hash of sets under each register's hash function, one row a set.

    A register's function is a sum of both halves of a run's 64-bit hash, each times a random odd
    number. ``runs`` holds the sets one after the other, none of them empty; ``starts`` is where each
    begins.
    """
    a, b = _seeds(registers)
    starts = np.zeros(1, np.int64) if starts is None else starts
    upper, lower = (runs >> np.uint64(32)).astype(np.uint32)[:, None], runs.astype(np.uint32)[:, None]
    low = np.full((len(starts), registers), ~np.uint32(0))
    one, two = np.empty((2, _STEP, registers), np.uint32)
    for row, start, end in zip(low, starts.tolist(), [*starts[1:].tolist(), len(runs)]):
        for at in range(start, end, _STEP):
            size = min(_STEP, end - at)
            h = np.multiply(lower[at : at + size], a, out=one[:size])
            h += np.multiply(upper[at : at + size], b, out=two[:size])
            np.minimum(row, np.minimum.reduce(h, axis=0), out=row)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers from minima: exponentially spaced, truncated to 16 bits."""
    u = np.minimum((low.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32), np.float32(1 - 2.0**-24))
    k = np.floor(np.float32(1 + _SHIFT) - np.log(-np.log1p(-u)) * np.float32(1 / math.log(BASE)))
    return np.clip(k, 0, _TOP + 1).astype(np.uint16)


def packed(regs: np.ndarray) -> list[bytes]:
    """Sketches as they are stored: of each the registers' low bytes, then their high bytes."""
    return [r.tobytes() for r in regs.view(np.uint8).reshape(len(regs), -1, 2).transpose(0, 2, 1)]


def unpacked(stored: list[bytes]) -> np.ndarray:
    """The registers of stored sketches, one row each."""
    both = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), 2, -1)
    return both.transpose(0, 2, 1).copy().view(np.uint16)[:, :, 0]


def merged(first: bytes, second: bytes) -> bytes:
    """The sketch of the union of two sets, from their stored sketches."""
    return packed(unpacked([first, second]).max(0, keepdims=True))[0]


def similarity(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sketches (rows of registers) with set sizes n1, n2."""
    larger, smaller = (first > second).sum(1), (first < second).sum(1)
    equal = first.shape[1] - larger - smaller
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    same = np.clip(1 - up - down, 1e-9, 1)
    up, down = np.clip(up, 1e-9, 1), np.clip(down, 1e-9, 1)
    fit = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return grid[np.arange(len(grid)), fit.argmax(1)] if len(grid) else np.empty(0)


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).rlike(r"(?U)\w")).select(
        F.xxhash64(F.col(text).cast("string")).alias("key"), F.col(text).alias("text")
    )


def sketches(df: DataFrame, text: str, width: int) -> DataFrame:
    """(key, n, sketch): set size and the registers, 16 bits each; a task keeps a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            keys, sets = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key in seen:
                    continue
                if len(seen) >= SEEN_KEPT:
                    seen.clear()
                seen.add(key)
                s = shingles(t, width, words)
                if len(s):
                    keys.append(key)
                    sets.append(s)
            sizes = np.array([len(s) for s in sets], np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            regs = packed(registers(minima(flat, np.r_[0, np.cumsum(sizes[:-1])].astype(np.int64)))) if sets else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes), pa.array(regs, pa.binary())],
                names=["key", "n", "sketch"],
            )

    return _texts(df, text).mapInArrow(run, "key bigint, n int, sketch binary")


def _bucket_pairs(limit: int):
    """Reads (bucket, key) in order of buckets; gives the pairs of each bucket, or its keys alone where it is too large.

    Never more than ``limit`` keys of a bucket are held.
    """

    def emit(keys: np.ndarray, out_a: list, out_b: list) -> None:
        if len(keys) > 1:
            i, j = np.triu_indices(len(keys), 1)
            out_a.append(keys[i])
            out_b.append(keys[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, held, large = None, np.empty(0, np.int64), False
        for batch in batches:
            bucket, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(bucket):
                continue
            out_a: list = []
            out_b: list = []
            big: list = []
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[starts[1:], len(bucket)]
            if open_bucket is not None and bucket[0] != open_bucket and not large:
                emit(held, out_a, out_b)
            # buckets of one text give nothing; the first may go on from before and the last into what follows
            last = len(starts) - 1
            sizes, inner = ends - starts, np.ones(last + 1, bool)
            inner[[0, last]] = False
            two = starts[inner & (sizes == 2)]
            two = two[key[two] != key[two + 1]]
            out_a.append(np.minimum(key[two], key[two + 1]))
            out_b.append(np.maximum(key[two], key[two + 1]))
            for r in np.flatnonzero((sizes > 2) | ~inner):
                keys = np.unique(key[starts[r] : ends[r]])
                goes_on = r == 0 and bucket[0] == open_bucket
                was_large = goes_on and large
                if goes_on and not large:
                    keys = np.union1d(held, keys)
                now_large = was_large or len(keys) > limit
                if now_large:
                    big.append(keys)
                if r == last:
                    open_bucket, large, held = bucket[-1], now_large, keys
                elif not now_large:
                    emit(keys, out_a, out_b)
            yield _pair_batch(out_a, out_b, big)
        if open_bucket is not None and not large:
            out_a, out_b = [], []
            emit(held, out_a, out_b)
            yield _pair_batch(out_a, out_b, [])

    return run


def _pair_batch(out_a: list, out_b: list, big: list) -> pa.RecordBatch:
    none = np.empty(0, np.int64)
    a, b, c = (np.concatenate(x) if x else none for x in (out_a, out_b, big))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[a, c]), pa.concat_arrays([pa.array(b), pa.nulls(len(c), pa.int64())])], names=["a", "b"]
    )


def band_pairs(sketch: DataFrame, limit: int) -> DataFrame:
    """(a, b) with a < b, once a shared band; b is null for a text of a bucket that is too large.

    A text may come in several copies of its sketch, from the tasks that met it.
    """
    part = lambda at: F.substring(F.col("sketch"), at + 1, F.lit(ROWS))
    i = F.col("band")
    bucket = F.shiftrightunsigned(F.xxhash64(i, part(i * ROWS), part(i * ROWS + REGISTERS)), 16)
    return (
        sketch.select("key", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
        .select(bucket.alias("bucket"), "key")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_bucket_pairs(limit), "a bigint, b bigint")
    )


def prefix_pairs(sets: DataFrame, threshold: float, block: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b), a < b, once each: a superset of the pairs that are similar enough, without loss.

    A set of n runs must share one of its n - ceil(threshold * n) + 1 rarest runs with any set that
    is similar enough, by one order of rarity for all; only those rare runs are joined, and a pair is
    given at the first of them that it shares. A run of many texts is split: its texts fall into blocks,
    and each two blocks meet in a task of their own.
    """
    runs = sets.select("key", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    rarity = runs.groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # runs of one text only come first in the order and take up places without being joined
    ranked = runs.join(rarity, "run", "left").select("key", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "run").alias("r"))
    prefix = ranked.groupBy("key", "n").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    shared = F.filter(F.slice("rs", F.lit(1), keep), lambda r: r["df"] > 1)
    rare = prefix.select("key", "n", shared.alias("rs")).select("key", "n", F.transform("rs", lambda r: r["run"]).alias("all"), F.posexplode("rs").alias("at", "r"))
    blocks = F.ceil(F.col("r.df") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), F.ceil(F.col("r.df") / block)).cast("int")
    placed = rare.select("key", "n", F.slice("all", F.lit(1), F.col("at")).alias("before"), F.col("r.run").alias("run"), own.alias("own"), blocks.alias("blocks"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "own").alias("low"), F.greatest(i, "own").alias("high")))
    spread = placed.select("key", "n", "before", "run", "own", F.explode(met).alias("m")).select("key", "n", "before", "run", "own", "m.low", "m.high")
    other = spread.select("run", "low", "high", F.col("key").alias("b"), F.col("n").alias("m"), F.col("before").alias("before_b"), F.col("own").alias("own_b"))
    sizes = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    here = (F.col("low") == F.least("own", "own_b")) & (F.col("high") == F.greatest("own", "own_b"))
    return (
        spread.join(other, ["run", "low", "high"])
        .where((F.col("key") < F.col("b")) & sizes & here & ~F.arrays_overlap("before", "before_b"))
        .select(F.col("key").alias("a"), "b")
    )


def sets_of(df: DataFrame, text: str, width: int, keys: DataFrame, n: int) -> DataFrame:
    """(key, runs array<bigint>) of the ``n`` texts named in ``keys``, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [shingles(t, width, words).view(np.int64) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            ends = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "runs"]
            )

    picked = _named(_texts(df, text), keys, n).dropDuplicates(["key"])
    return picked.select("key", "text").mapInArrow(run, "key bigint, runs array<bigint>")


def _named(df: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``; these are broadcast up to ``BROADCAST_TEXTS``."""
    return df.join(F.broadcast(keys) if n <= BROADCAST_TEXTS else keys, "key", "left_semi")


def _keys(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The texts in ``pairs``, and how many they are."""
    keys = kept_table(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    return keys, keys.count()


def _both(pairs: DataFrame, of: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pairs`` (a, b) with the columns of both texts, numbered 1 and 2; ``of`` has one row a key."""
    one = of.select(F.col("key").alias("a"), *[F.col(c).alias(c + "1") for c in columns])
    two = of.select(F.col("key").alias("b"), *[F.col(c).alias(c + "2") for c in columns])
    return pairs.join(one, "a").join(two, "b")


def last_bits(sketch: DataFrame) -> DataFrame:
    """(key, n, w0, w1, ..): the last bit of every register, 64 to a word; one row a key."""
    words = -(-REGISTERS // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            low = unpacked(batch.column(2).to_pylist()) & 1
            bits = np.zeros((len(low), 64 * words), np.uint8)
            bits[:, :REGISTERS] = low
            w = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(w[:, i]) for i in range(words)]],
                names=["key", "n", *[f"w{i}" for i in range(words)]],
            )

    schema = "key bigint, n int, " + ", ".join(f"w{i} bigint" for i in range(words))
    return sketch.select("key", "n", "sketch").mapInArrow(run, schema).dropDuplicates(["key"])


def estimated(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), once each, whose sketches do not speak against ``threshold``."""
    words = [f"w{i}" for i in range(-(-REGISTERS // 64))]
    same = (1 + threshold) / 2
    least = REGISTERS * same - ERRORS * math.sqrt(REGISTERS * same * (1 - same))
    differ = sum((F.bit_count(F.col(w + "1").bitwiseXOR(F.col(w + "2"))) for w in words), F.lit(0))
    sizes = (F.col("n1") >= threshold * F.col("n2") - 1e-9) & (F.col("n2") >= threshold * F.col("n1") - 1e-9)
    # brought together by a once: the distinct and the first join need no further shuffle
    once = pairs.repartition("a").distinct()
    alike = kept_table(_both(once, last_bits(sketch), ("n", *words)).where(sizes & (differ <= REGISTERS - least)).select("a", "b"))
    floor = max(0.0, threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS))

    @F.pandas_udf("double")
    def likely(s1: pd.Series, s2: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        if not len(s1):
            return pd.Series([], dtype=float)
        return pd.Series(similarity(unpacked(s1.to_list()), unpacked(s2.to_list()), n1.to_numpy(float), n2.to_numpy(float)))

    near = _named(sketch, *_keys(alike)).dropDuplicates(["key"])
    return _both(alike, near, ("sketch", "n")).where(likely("sketch1", "sketch2", "n1", "n2") >= floor).select("a", "b")


def word_runs(text: str, width: int) -> set[str]:
    """The different runs of ``width`` words of a text, as they are; of fewer words the one run."""
    w = _WORD.findall(text.lower())
    k = min(width, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def verified(pairs: DataFrame, df: DataFrame, text: str, threshold: float, width: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose texts share at least ``threshold`` of their runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs = None, set()
        for batch in batches:
            rows, found = [], []
            for i, (key, t1, t2) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if key != last:
                    last, runs = key, word_runs(t2, width)
                other = word_runs(t1, width)
                shared = len(runs & other)
                if shared >= threshold * (len(runs) + len(other) - shared) - 1e-9:
                    rows.append(i)
                    found.append(shared / (len(runs) + len(other) - shared))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.float64())], names=["a", "b", "jaccard"]
            )

    texts = _named(_texts(df, text), *_keys(pairs)).dropDuplicates(["key"])
    return _both(pairs, texts, ("text",)).select("a", "b", "text1", "text2").mapInArrow(run, "a bigint, b bigint, jaccard double")


def similar_texts(
    df: DataFrame, text: str = "text", threshold: float = 0.8, width: int = 5, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """(a, b, jaccard): pairs of different texts, named by ``xxhash64(text)``, with at least ``threshold``."""
    sketch = kept_table(sketches(df, text, width))
    found = kept_table(band_pairs(sketch, bucket_limit))
    pairs, large = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("key")).distinct()
    if n_large := large.count():
        sets = kept_table(sets_of(df, text, width, large, n_large))
        pairs = pairs.unionByName(prefix_pairs(sets, threshold, bucket_limit))
    return verified(kept_table(estimated(pairs, sketch, threshold)), df, text, threshold, width)


def near_duplicate_pairs(
    df: DataFrame, id_col: str = "id", text: str = "text", threshold: float = 0.8, width: int = 5,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows whose texts are equal or similar enough, copies expanded.

    Repeated rows of one id count once. Ids that are null are left out.
    """
    texts = similar_texts(df, text, threshold, width, bucket_limit)
    t = F.col(text).cast("string")
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).rlike(r"(?U)\w")).select(
        F.col(id_col).alias("id"), F.xxhash64(t).alias("key"), F.xxhash64(F.lit(1), t).alias("key2")
    )
    a, b = rows.select(F.col("id").alias("x"), F.col("key").alias("a")), rows.select(F.col("id").alias("y"), F.col("key").alias("b"))
    apart = texts.select("a", "b").join(a, "a").join(b, "b")
    copies = rows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "key2")
    same = rows.join(copies, ["key", "key2"])
    equal = same.select("key", "key2", F.col("id").alias("x")).join(same.select("key", "key2", F.col("id").alias("y")), ["key", "key2"]).where("x < y")
    ids = apart.select("x", "y").unionByName(equal.select("x", "y")).where("x <> y")
    return ids.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(
    df: DataFrame, id_col: str = "id", text: str = "text", threshold: float = 0.8, width: int = 5,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(id, group_id, n_links): each row's class and its text's number of links to other texts.

    ``group_id`` is the least id of the class: rows linked by equal or similar texts, directly or over
    others. Rows without a link are classes of their own. Copies are joined by their text's name, not
    by pairs.
    """
    pairs = cut_lineage(similar_texts(df, text, threshold, width, bucket_limit).select("a", "b"))
    keys = components(pairs).select(F.col("node").alias("key"), "class")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    named = F.when(F.col(text).rlike(r"(?U)\w"), F.xxhash64(F.col(text).cast("string")))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), named.alias("key"))
    placed = rows.where("key is not null").join(keys.join(degree, "key"), "key", "left").select(
        "id", F.coalesce("class", "key").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )
    least = placed.groupBy("class").agg(F.min("id").alias("group_id"))
    grouped = placed.join(least, "class").select("id", "group_id", "n_links")
    alone = rows.where("key is null").select("id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"))
    return grouped.unionByName(alone)
