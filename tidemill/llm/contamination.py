"""Which documents contain passages of held-out items: size-partitioned MinHash containment search.

A document leaks an item if it holds ``run`` consecutive words of the item's passage. Both sides are
normalised the same way (compatibility form, case folded, markup and punctuation gone, any spacing)
and cut into shingles of ``width`` words.

Items are short, documents may be long. One MinHash of a whole document would drown a short passage,
so a document is searched as domains: of up to ``block`` words it is one, a longer one is covered by
blocks of ``block`` words that overlap by ``run - 1``, so that every possible quote lies whole in one.
Domains are partitioned by size. The query is an item's window of ``run`` words, a set of a few
shingles; its signature is the least hash of them under each of several hash functions. A domain's
signature holds, under each function, the least hashes of all its windows, about a quarter of its
shingles. If x of a window's shingles are in the domain, a register of the window is met in the
domain's signature with a probability of about that share, so the share of registers met estimates the
window's containment. A quoted window has containment 1 and meets in every register: the threshold of a
partition is that all its registers are met, and no quote is missed, whatever its place and length.
The larger the domains of a partition, the more chance meetings there are, and the more registers it
has (``registers_of``). Candidates, a block and an item each, are verified word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.hashing import Words, run_hashes
from tidemill.sources.tables import kept_table

RUN, WIDTH = 12, 5
#: words of a block of a long document
BLOCK = 4096
#: registers of the partitions of the smallest and of the largest domains
FEWEST, MOST = 2, 4
#: up to so many rows of 8 to 24 bytes (registers of items, blocks to verify) are broadcast; beyond, both sides are shuffled
BROADCAST_ROWS = 1_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")
_LINK = re.compile(r"\]\([^()\s]*\)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_BREAK = re.compile(r"\\[nrt]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_WORD = re.compile("[^\\W_]+(?:[\u0300-\u036f][^\\W_]*)*")


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, spacing and Unicode form."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), _BREAK.sub(" ", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "'" in text or "’" in text:
        text = text.replace("'", "").replace("’", "")
    return _WORD.findall(unicodedata.normalize("NFC", text.casefold()))


def size_class(words: int) -> int:
    """The partition of a domain: the binary logarithm of its number of words."""
    return words.bit_length() - 1


def registers_of(partition: int) -> int:
    """How many registers a partition's search uses, and a window must meet: one more each time domains are four times as large."""
    return min(MOST, max(FEWEST, FEWEST + (partition - 7) // 2))


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.random.default_rng(7_070_707).integers(0, 2**63, (2, MOST, 1), dtype=np.uint64) | np.uint64(1)


def window_minima(words: list[str], run: int, width: int, registers: int, store: Words) -> np.ndarray:
    """The least shingle hash of every window of ``run`` words, in order, one row a register."""
    if len(words) < run:
        return np.empty((registers, 0), np.uint64)
    s = run_hashes(store.hashes(words), width)
    salt, odd = _seeds()[:, :registers]
    h = (s ^ salt) * odd
    h ^= h >> np.uint64(32)
    views = run - width + 1
    return reduce(np.minimum, [h[:, i : h.shape[1] - views + 1 + i] for i in range(views)])


def _flat(parts: list, kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def item_windows(items: DataFrame, item_id: str, passage: str, run: int, width: int) -> DataFrame:
    """(item, win, register, minimum): the signature of every window of every passage, the queries of the search."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Words()
        for batch in batches:
            rows, wins, regs, values = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                m = window_minima(words_of(t), run, width, MOST, store)
                rows.append(np.full(m.size, i))
                wins.append(np.tile(np.arange(m.shape[1], dtype=np.int32), MOST))
                regs.append(np.repeat(np.arange(MOST, dtype=np.int32), m.shape[1]))
                values.append(m.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(_flat(rows, np.int64))), pa.array(_flat(wins, np.int32)), pa.array(_flat(regs, np.int32)),
                 pa.array(_flat(values, np.int64))],
                names=["item", "win", "register", "minimum"],
            )

    kind = dict(items.dtypes)[item_id]
    rows = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id), F.col(passage)).distinct()
    return rows.mapInArrow(sign, f"item {kind}, win int, register int, minimum bigint")


def domain_signatures(
    df: DataFrame, id_col: str, text: str, run: int, width: int, block: int, only: np.ndarray | None = None
) -> DataFrame:
    """(id, block, size_class, register, minimum): the signatures of all domains of each row's text.

    ``only`` (sorted) leaves out the minima that no query has. Texts that are null or have fewer than
    ``run`` words have no signature.
    """
    sent = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, asked = Words(), sent.value if sent else None
        for batch in batches:
            rows, blocks, classes, regs, values = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                for nth, at in enumerate(range(0, max(1, len(words) - run + 1), block - run + 1)):
                    part = words[at : at + block]
                    c = size_class(len(part)) if part else 0
                    for r, m in enumerate(window_minima(part, run, width, registers_of(c), store)):
                        if asked is not None:
                            m = m[asked[np.minimum(np.searchsorted(asked, m), len(asked) - 1)] == m] if len(asked) else m[:0]
                        if len(m := np.unique(m)):
                            rows.append(np.full(len(m), i))
                            blocks.append(np.full(len(m), nth, np.int32))
                            classes.append(np.full(len(m), c, np.int32))
                            regs.append(np.full(len(m), r, np.int32))
                            values.append(m.view(np.int64))
            flat = [pa.array(_flat(x, np.int32)) for x in (blocks, classes, regs)] + [pa.array(_flat(values, np.int64))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(_flat(rows, np.int64))), *flat], names=["id", "block", "size_class", "register", "minimum"]
            )

    kind = dict(df.dtypes)[id_col]
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col), F.col(text))
    return rows.mapInArrow(sign, f"id {kind}, block int, size_class int, register int, minimum bigint")


def contained(
    documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, run: int, width: int, block: int
) -> DataFrame:
    """(id, block, item): domains in whose partition some window of the item reaches the partition's containment."""
    wanted = kept_table(item_windows(items, item_id, passage, run, width))
    n = wanted.count()
    only = None
    if n <= BROADCAST_ROWS:
        only = np.unique(wanted.select("minimum").toPandas()["minimum"].to_numpy(np.int64).view(np.uint64))
    found = domain_signatures(documents, doc_id, text, run, width, block, only)
    met = found.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, ["register", "minimum"])
    least = F.element_at(F.array(*[F.lit(registers_of(c)) for c in range(size_class(block) + 1)]), F.col("size_class") + 1)
    return (
        met.groupBy("id", "block", "size_class", "item", "win").agg(F.bit_count(F.bit_or(F.pow(F.lit(2), F.col("register")).cast("int"))).alias("met"))
        .where(F.col("met") >= least).select("id", "block", "item").distinct()
    )


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", passage: str = "passage", run: int = RUN, width: int = WIDTH, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, n_windows): documents that hold at least ``run`` consecutive words of an item.

    ``n_windows`` is the number of different ``run``-word windows of the item found in the document.
    Null texts, passages and ids never match; passages shorter than ``run`` words cannot leak.
    Repeated rows count once. Documents are never shuffled whole: only those with a candidate are
    read again to be verified, block by block.
    """
    pairs = kept_table(contained(documents, items, doc_id, text, item_id, passage, run, width, block))
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    few = pairs.count() <= BROADCAST_ROWS
    near = docs.join(F.broadcast(pairs) if few else pairs, "id")
    said = items.where(F.col(passage).isNotNull()).select(F.col(item_id).alias("item"), F.col(passage).alias("passage"))
    near = near.join(said, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words, passages = None, [], {}
        for batch in batches:
            rows, wins = [], []
            for i, (t, p, nth) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                if t != last:
                    last, words = t, words_of(t)
                if p not in passages:
                    if len(passages) >= 10_000:
                        passages.clear()
                    w = words_of(p)
                    own = passages[p] = {}
                    for k in range(len(w) - run + 1):
                        own.setdefault(tuple(w[k : k + run]), k)
                own, at = passages[p], nth * (block - run + 1)
                part = words[at : at + block]
                for k in {own[x] for k in range(len(part) - run + 1) if (x := tuple(part[k : k + run])) in own}:
                    rows.append(i)
                    wins.append(k)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(wins, pa.int32())], names=["d", "i", "win"]
            )

    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    found = near.select("id", "item", "text", "passage", "block").mapInArrow(verify, f"d {kinds[0]}, i {kinds[1]}, win int")
    return found.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.countDistinct("win").alias("n_windows"))
