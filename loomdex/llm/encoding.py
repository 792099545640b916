"""Encoding texts with a byte-level BPE vocabulary.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash over the vocabulary: no merge is run for it. The others are merged with a
heap over a linked list of bytes, in O(n log n) of their length, so a very long
one does no harm. The hash's two arrays and the ranks are sent to the executors
once; their size is that of the vocabulary file.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from loomdex.sources.tables import table

#: The folder of the vocabulary files; a parameter of encode().
VOCABULARIES = os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers")
#: The pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a Python worker remembers of pre-tokens already resolved is cleared at so many; only speed depends on it.
REMEMBER = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a line each of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings to their values.

    A first hash picks a bucket; the bucket's displacement turns a second hash into a
    slot that no other key has. The key kept at the slot tells members from others.
    """

    def __init__(self, values: dict[bytes, int], load: int = 4):
        keys = list(values)
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = np.zeros(self.n, dtype=np.int32)
        by: dict[int, list[bytes]] = {}
        for k in keys:
            by.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        for b, members in sorted(by.items(), key=lambda x: -len(x[1])):
            shift = 0
            while True:
                slots = [self._slot(xxhash.xxh3_64_intdigest(k), shift) for k in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                shift += 1
            self.shift[b] = shift
            for k, s in zip(members, slots, strict=True):
                self.keys[s], self.values[s] = k, values[k]
        self.shifts = self.shift.tolist()

    def _slot(self, h: int, shift: int) -> int:
        h = ((h >> 17) ^ (shift * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 29)) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shifts[h % self.buckets])
        return int(self.values[s]) if self.keys[s] == key else None


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: the pair of lowest rank is merged first, the leftmost of equals."""
    n = len(token)
    part: list[bytes | None] = [token[k : k + 1] for k in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, part[k] + part[k + 1]) for k in range(n - 1) if (r := ranks.get(part[k] + part[k + 1])) is not None]
    heapify(heap)
    while heap:
        _, k, both = heappop(heap)
        left = part[k]
        if left is None or (j := after[k]) >= n or left + part[j] != both:
            continue  # one of the two has been merged since
        part[k], part[j] = both, None
        after[k] = j = after[j]
        if j < n:
            before[j] = k
            if (r := ranks.get(both + part[j])) is not None:
                heappush(heap, (r, k, both + part[j]))
        if (i := before[k]) >= 0 and (r := ranks.get(part[i] + both)) is not None:
            heappush(heap, (r, i, part[i] + both))
    return [ranks[p] for p in part if p is not None]


class Encoder:
    """Text to ids by the two tiers; text that looks like a special token is ordinary text."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, pattern: str = PATTERN):
        self.ranks, self.perfect, self.split = ranks, perfect, regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def token(self, t: str) -> list[int]:
        b = t.encode("utf-8", "surrogatepass")
        v = self.perfect.get(b)
        ids = [v] if v is not None else merge(b, self.ranks)
        if len(self.seen) >= REMEMBER:
            self.seen.clear()
        if len(t) <= 64:
            self.seen[t] = ids
        return ids

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            seen, token = self.seen, self.token
            for t in self.split(text):
                out += seen.get(t) or token(t)
        return out


_sent: dict[tuple[str, int], Broadcast] = {}
_encoders: dict[tuple[int, str], Encoder] = {}


def sent(spark: SparkSession, path: str) -> tuple[int, Broadcast]:
    """The digest of a vocabulary file, and its ranks with their hash, which are built and sent to the executors once an application."""
    with open(path, "rb") as f:
        digest = xxhash.xxh3_64_intdigest(f.read())
    at = (spark.sparkContext.applicationId, digest)
    if at not in _sent:
        ranks = read_ranks(path)
        _sent[at] = spark.sparkContext.broadcast((ranks, PerfectHash(ranks)))  # of the vocabulary's size
    return digest, _sent[at]


def encode(spark: SparkSession, texts: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row: ids of the text without special tokens; [] for null and empty text.

    A map over the rows, without a shuffle; repeated keys stay repeated rows. Whole texts are encoded. The pattern that cuts pre-tokens is that of the rank
    files' own library; a vocabulary with another names it.
    """
    digest, shared = sent(spark, f"{folder}/{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (digest, pattern) not in _encoders:  # once a worker
            _encoders.clear()
            _encoders[digest, pattern] = Encoder(*shared.value, pattern)
        encoder = _encoders[digest, pattern]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.asarray(encoder(t), dtype=np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=[key, "ids"])

    rows = texts.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def p8_ids(spark, d: str) -> DataFrame:
    """The ids of every document."""
    return encode(spark, table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_counts(spark, d: str) -> DataFrame:
    """Documents with no ids, and documents in all: those without text are the ones without ids."""
    from pyspark.sql import functions as F

    return p8_ids(spark, d).agg(F.count("*").alias("n_documents"), F.sum((F.size("ids") == 0).cast("long")).alias("n_without_ids"))


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
SQL = {"p8_counts": "SELECT count(*) AS n_documents, sum(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 0 END)::BIGINT AS n_without_ids FROM documents"}
