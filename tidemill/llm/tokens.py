"""Token ids of every text by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Inside a piece a segment tree over the ranks
of adjacent pairs gives the leftmost pair of lowest rank at its root; the pair is merged, and the
ranks of its two neighbours are updated in logarithmic time, until no pair has a rank. So a piece of
n bytes costs O(n log n), also where a script without blanks makes a whole document one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the pattern of byte_bpe_50k, given with the vocabulary (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: pieces whose ids a worker keeps; when full, the store starts afresh
CACHE_PIECES = 200_000
_NONE = 1 << 60


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None or n == 0:
        return [] if n == 0 else [whole]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    # a leaf holds rank * n + place: its smallest value is the leftmost pair of lowest rank
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (low := tree[1]) != _NONE:
        i = low % n
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k
        put(j, _NONE)
        if k < n:
            before[k] = i
            rank = ranks.get(parts[i] + parts[k])
            put(i, _NONE if rank is None else rank * n + i)
        else:
            put(i, _NONE)
        if i:
            h = before[i]
            rank = ranks.get(parts[h] + parts[i])
            put(h, _NONE if rank is None else rank * n + h)
    return [ranks[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as byte strings with their ranks; read once per worker."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_text(text: str, ranks: dict[bytes, int], find, cache: dict[str, list[int]]) -> list[int]:
    ids: list[int] = []
    for piece in find(text):
        got = cache.get(piece)
        if got is None:
            got = encode_piece(piece.encode("utf-8", "replace"), ranks)
            if len(cache) >= CACHE_PIECES:
                cache.clear()
            cache[piece] = got
        ids += got
    return ids


def encode_corpus(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """(doc_id, ids array<int>): one row per row of ``documents``.

    Null and empty texts give an empty list. Strings that look like special tokens are plain text.
    Other columns are ignored; repeated rows give repeated rows; an empty table an empty result.
    The vocabulary's path must be readable on every worker. No shuffle: each text is encoded where it
    is read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find, cache = load_ranks(vocabulary), regex.compile(pattern).findall, {}
        for batch in batches:
            ids, ends = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    ids += encode_text(t, ranks, find, cache)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(F.col(doc_id), F.col(text)).mapInArrow(encode, f"doc_id {kind}, ids array<int>")
