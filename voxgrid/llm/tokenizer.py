"""Encoding of texts with a public byte-level BPE vocabulary.

Method: two tiers. A minimal perfect hash over the vocabulary resolves whole pre-tokens that are
tokens themselves; the others are merged by a heap of pair ranks over a linked list of their parts.
Distinct pre-tokens are resolved once per batch and kept by the worker for later batches.

The vocabulary's path is a parameter. Its file is read once on the driver and travels to the workers
as a broadcast; its size is fixed (50,256 tokens, under 1 MB).

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text;
texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.session import table

#: Fixed value: the pattern that the vocabulary's texts are split by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Resolved pre-tokens that a worker keeps; when full it starts over.
KEPT = 300_000
#: Longer pre-tokens are encoded anew each time.
KEPT_LENGTH = 64


def vocabulary_path() -> str:
    """The default vocabulary's file, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, id) of a rank file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


def _spread(h: int, d: int, n: int) -> int:
    x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    return ((x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) * n >> 32


class PerfectHash:
    """A minimal perfect hash of byte strings: bucket, displacement, slot. Every slot holds one key."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys repeat, or their hashes collide")
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            held[(h & 0xFFFFFFFF) % self.buckets].append(i)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(n, np.int64)
        taken = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        singles = []
        for b in order:
            if len(held[b]) <= 1:
                singles += [b] * len(held[b])
                continue
            d = 0
            while True:
                d += 1
                slots = [_spread(hashes[i], d, n) for i in held[b]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
            self.displace[b] = d
            for i, s in zip(held[b], slots, strict=True):
                taken[s], self.slot_of[i] = 1, s
        free = (s for s in range(n) if not taken[s])
        for b in singles:
            s = next(free)
            self.displace[b], self.slot_of[held[b][0]] = -s - 1, s

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot that each hash would have; only a key of the set really lies there."""
        h = hashes.astype(np.uint64)
        d = self.displace[(h & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)]
        x = h + np.where(d > 0, d, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        at = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)
        return np.where(d < 0, -d - 1, at.astype(np.int64))


class Encoder:
    """Both tiers over one vocabulary."""

    def __init__(self, ranks: list[tuple[bytes, int]], hashed: PerfectHash):
        self.hashed = hashed
        self.key_at: list[bytes] = [b""] * len(ranks)
        self.id_at = np.zeros(len(ranks), np.int64)
        for (k, i), s in zip(ranks, hashed.slot_of, strict=True):
            self.key_at[s], self.id_at[s] = k, i
        rank = dict(ranks)
        self.byte = [rank[bytes([b])] for b in range(256)]
        #: id of the token that two adjacent parts make; the lower, the earlier they are merged
        self.merge: dict[int, int] = {}
        for k, i in ranks:
            for cut in range(1, len(k)):
                a, b = rank.get(k[:cut]), rank.get(k[cut:])
                if a is not None and b is not None:
                    self.merge[a << 24 | b] = i
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The ids of one pre-token, by a heap over its linked parts."""
        ids = [self.byte[b] for b in data]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << 32) | i for i in range(n - 1) if (r := merge.get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            e = heapq.heappop(heap)
            r, i = e >> 32, e & 0xFFFFFFFF
            j = after[i] if ids[i] >= 0 else n
            if j >= n or merge.get(ids[i] << 24 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := merge.get(r << 24 | ids[k])) is not None:
                    heapq.heappush(heap, (x << 32) | i)
            h = before[i]
            if h >= 0 and (x := merge.get(ids[h] << 24 | r)) is not None:
                heapq.heappush(heap, (x << 32) | h)
        return [x for x in ids if x >= 0]

    def resolve(self, tokens: list[str]) -> dict[str, list[int]]:
        """The ids of distinct pre-tokens: whole by the perfect hash, else merged."""
        data = [t.encode() for t in tokens]
        slots = self.hashed.slots(np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64)) if data else []
        ids = self.id_at
        return {t: [int(ids[s])] if self.key_at[s] == d else self.merged(d) for t, d, s in zip(tokens, data, slots, strict=True)}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        kept = self.kept
        pieces = [self.split(t) if t else [] for t in texts]
        new = {p for ps in pieces for p in ps if p not in kept}
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = {p for ps in pieces for p in ps}
        got = self.resolve(list(new))
        short = {k: v for k, v in got.items() if len(k) <= KEPT_LENGTH}
        if len(short) <= KEPT:
            kept.update(short)
        rows = [[i for p in ps for i in (kept.get(p) or got[p])] for ps in pieces]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
        return offsets, np.array([i for r in rows for i in r], np.int32)


@functools.cache
def _built(path: str) -> tuple[list[tuple[bytes, int]], PerfectHash]:
    ranks = read_ranks(path)
    return ranks, PerfectHash([k for k, _ in ranks])


_workers: dict[int, tuple[Encoder, object]] = {}


class SharedEncoder:
    """An encoder that travels to the workers as a broadcast and is set up once in each."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.sent = spark.sparkContext.broadcast(_built(path or vocabulary_path()))

    def get(self) -> Encoder:
        value = self.sent.value  # one object as long as the worker lives
        if id(value) not in _workers:
            _workers.clear()
            _workers[id(value)] = (Encoder(*value), value)
        return _workers[id(value)][0]


def with_ids(df: DataFrame, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of a text column as a new last column; the text column is left out."""
    shared = SharedEncoder(df.sparkSession, path)
    names = [c for c in df.columns if c != text]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for b in batches:
            offsets, ids = encoder.encode(b.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [lists], [*names, out])

    return df.mapInArrow(run, df.drop(text).select("*", F.array().cast("array<int>").alias(out)).schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return with_ids(table(spark, sf_dir, "documents", "doc_id", "text"), "text")
