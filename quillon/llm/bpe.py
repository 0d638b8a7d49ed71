"""Byte-level BPE encoding of a corpus with the vocabulary of a public tokenizer.

The merges of a pre-token are ordered by a rank queue: a three-level bitmap of
64-bit words marks which merge ranks wait, the bucket of a rank holds the
positions of the left tokens in a linked list, and find-first-set picks the
next rank.  Entries whose pair has changed since are skipped.  A pre-token of
n bytes takes O(n log n), so megabytes without a space are no trouble; the
frequent short ones come from a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.runtime import spread

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public split pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept per worker; beyond it the cache starts anew.
CACHE = 300_000
#: Longer pre-tokens are rarely repeated and are not cached.
CACHE_LENGTH = 48


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class RankQueue:
    """Waiting positions by merge rank; the least rank first, then the leftmost position."""

    __slots__ = ("l0", "l1", "l2", "buckets")

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self.l0 = [0] * words
        self.l1 = [0] * ((words + 63) // 64)
        self.l2 = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        b = self.buckets.get(rank)
        if b:
            heapq.heappush(b, pos)
            return
        self.buckets[rank] = [pos]
        w = rank >> 6
        self.l0[w] |= 1 << (rank & 63)
        self.l1[w >> 6] |= 1 << (w & 63)
        self.l2 |= 1 << (w >> 6)

    def pop(self) -> tuple[int, int] | None:
        if not self.l2:
            return None
        a = (self.l2 & -self.l2).bit_length() - 1
        x = self.l1[a]
        w = (a << 6) | ((x & -x).bit_length() - 1)
        x = self.l0[w]
        rank = (w << 6) | ((x & -x).bit_length() - 1)
        b = self.buckets[rank]
        pos = heapq.heappop(b)
        if not b:
            del self.buckets[rank]
            self.l0[w] &= ~(1 << (rank & 63))
            if not self.l0[w]:
                self.l1[a] &= ~(1 << (w & 63))
                if not self.l1[a]:
                    self.l2 &= ~(1 << a)
        return rank, pos


class Encoder:
    """Encodes texts; one per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.size = max(ranks.values()) + 1
        self.find = regex.compile(pattern).findall
        self.by_id = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _pair(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, -1 if there is none."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            r = self.pairs[(a, b)] = self.ranks.get(self.by_id[a] + self.by_id[b], -1)
        return r

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        tok = [self.single[x] for x in word]
        n = len(tok)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        pair, q = self._pair, RankQueue(self.size)
        for i in range(n - 1):
            r = pair(tok[i], tok[i + 1])
            if r >= 0:
                q.push(r, i)
        while (top := q.pop()) is not None:
            r, i = top
            if tok[i] < 0:
                continue  # merged into its left neighbour since
            j = nxt[i]
            if j >= n or pair(tok[i], tok[j]) != r:
                continue  # its pair has changed since
            tok[i] = r
            tok[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                r = pair(tok[i], tok[k])
                if r >= 0:
                    q.push(r, i)
            h = prv[i]
            if h >= 0:
                r = pair(tok[h], tok[i])
                if r >= 0:
                    q.push(r, h)
        return [t for t in tok if t >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of an empty text or null an empty list."""
        if not text:
            return []
        out: list[int] = []
        cache, add = self.cache, out.extend
        for w in self.find(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = tuple(ids)
            add(ids)
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """The worker's encoder; Python workers are reused by later tasks."""
    key = held.id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load_ranks(held.value))
    return _ENCODERS[key]


class _Held:
    """A broadcast value with its id, which the value alone does not tell on a worker."""

    def __init__(self, broadcast):
        self.id, self.broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self) -> bytes:
        return self.broadcast.value

    def __reduce__(self):
        return _restore, (self.id, self.broadcast)


def _restore(key, broadcast):
    h = _Held.__new__(_Held)
    h.id, h.broadcast = key, broadcast
    return h


def _vocabulary(spark: SparkSession, vocab: str, folder: str | None) -> _Held:
    """The rank file, about 1 MB, read by the driver and broadcast: executors need no copy of it."""
    with open(os.path.join(folder or TOKENIZERS, f"{vocab}.tiktoken"), "rb") as f:
        return _Held(spark.sparkContext.broadcast(f.read()))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs``, whole texts, no special tokens.

    Null and empty texts give an empty list; blank texts have tokens.  A special
    token's name within a text is ordinary text.  Repeated rows stay repeated.
    """
    held = _vocabulary(docs.sparkSession, vocab, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held)
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    src = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text_col: str = "text", *, vocab: str = "byte_bpe_50k", folder: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``docs`` without its text but with the number of its tokens; null and empty texts have 0."""
    held = _vocabulary(docs.sparkSession, vocab, folder)
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], [*keep, out])

    src = spread(docs.select(*keep, F.col(text_col).cast("string").alias(text_col)))
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return src.mapInArrow(run, schema)
