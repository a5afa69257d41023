"""Filling containers of fixed capacity with texts, lexically related texts together.

Method: lexical retrieval packing. Documents are spread over shards of bounded size, ordered by a
lexical signature so that related texts share a shard. Each shard builds a BM25 inverted index of its
items; the largest unused item seeds a container, the index returns its unused neighbours by score,
and they fill the window greedily as far as they fit. What space no neighbour fits is filled with the
largest unused items that still fit, so little of it stays unused.

A text longer than a container is cut into full containers and a rest, which is an item like others;
no other text is split. Defined results: null and empty texts have no tokens and get no container;
repeated rows are items of their own, told apart by their place in the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.llm.codepoints import points_of
from voxgrid.llm.tokenizer import SharedEncoder
from voxgrid.session import table

CAPACITY = 2048
#: Documents a shard has on average. The range partitioning splits a hot signature by doc_id.
SHARD = 4000
#: BM25 parameters, and the number of hashed terms.
K1, B, TERMS = 1.2, 0.75, 1 << 20
_SCHEMA = "container long, doc_id long, start long, n_tokens long, place int, seed boolean"


class Index:
    """A BM25 inverted index over the items of a shard, in numpy arrays."""

    def __init__(self, texts: pa.Array, rows: np.ndarray):
        """rows: the text of each item."""
        cps, row = points_of(texts)
        letter = (cps >= 0x30) & ~((cps >= 0x3A) & (cps < 0x41)) & ~((cps >= 0x2000) & (cps < 0x3041)) & (cps < 0xFF00)
        two = letter[1:] & letter[:-1] & (row[1:] == row[:-1]) if len(cps) else np.empty(0, bool)
        low = np.where((cps >= 0x41) & (cps <= 0x5A), cps + 32, cps).astype(np.int64)
        term = ((low[:-1] * 1_000_003 + low[1:]) * 2_654_435_761 % (1 << 40) % TERMS)[two] if len(cps) else np.empty(0, np.int64)
        code, tf = np.unique(row[1:][two].astype(np.int64) * TERMS + term if len(cps) else np.empty(0, np.int64), return_counts=True)
        doc, term = code // TERMS, code % TERMS
        n = len(texts)
        size = np.bincount(doc, weights=tf, minlength=n)
        terms, at = np.unique(term, return_inverse=True)
        df = np.bincount(at, minlength=len(terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1, 1e-9))
        self.weight = (idf[at] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        by_term = np.argsort(at, kind="stable")
        self.posting_doc, self.posting_weight = doc[by_term], self.weight[by_term]
        self.term_start = np.concatenate(([0], np.cumsum(df)))
        self.doc_start = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms, self.rows, self.n = at, rows, n

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every item against all terms of one item."""
        r = self.rows[item]
        ts = self.doc_terms[self.doc_start[r] : self.doc_start[r + 1]]
        if not len(ts):
            return np.zeros(len(self.rows))
        a, b = self.term_start[ts], self.term_start[ts + 1]
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.posting_doc[at], weights=self.posting_weight[at], minlength=self.n)[self.rows]


def fill(sizes: np.ndarray, capacity: int, scores) -> list[list[int]]:
    """Containers of items, each a seed followed by neighbours and fillers. scores(item) ranks all items."""
    unused = np.ones(len(sizes), bool)
    order = np.argsort(-sizes, kind="stable")  # also the order of fillers, largest first
    down = -sizes[order]
    left, first, out = len(sizes), 0, []
    while left:
        while not unused[order[first]]:
            first += 1
        seed = int(order[first])
        unused[seed] = False
        left -= 1
        room, got = capacity - int(sizes[seed]), [seed]
        if room and left:
            near = np.flatnonzero(unused & (sizes <= room))
            if len(near):
                s = scores(seed)[near]
                near = near[s > 0][np.argsort(-s[s > 0], kind="stable")]
                for i in near.tolist():
                    if sizes[i] <= room:
                        got.append(i)
                        unused[i] = False
                        left -= 1
                        room -= int(sizes[i])
                        if not room:
                            break
        while room and left:
            at = int(np.searchsorted(down, -room))  # the largest that can fit, or the next smaller unused
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                break
            i = int(order[at])
            got.append(i)
            unused[i] = False
            left -= 1
            room -= int(sizes[i])
        out.append(got)
    return out


def pack_shard(shard: int, doc_ids: np.ndarray, texts: pa.Array, counts: np.ndarray, capacity: int) -> pa.RecordBatch:
    """The containers of one shard. counts: tokens of each text."""
    full = counts // capacity
    rest = counts - full * capacity
    rows = np.flatnonzero(rest > 0)
    groups = fill(rest[rows], capacity, Index(texts, rows).scores) if len(rows) else []
    member = np.array([i for g in groups for i in g], np.int64)
    place = np.array([k for g in groups for k in range(len(g))], np.int32)
    box = np.repeat(np.arange(len(groups)), [len(g) for g in groups]).astype(np.int64)
    whole = np.repeat(np.arange(len(counts)), full)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    member = rows[member]
    cols = [
        np.concatenate((box, len(groups) + np.arange(len(whole)))) + (np.int64(shard) << 32),
        doc_ids[np.concatenate((member, whole))],
        np.concatenate((full[member] * capacity, nth * capacity)),
        np.concatenate((rest[member], np.full(len(whole), capacity))),
        np.concatenate((place, np.zeros(len(whole), np.int32))).astype(np.int32),
        np.concatenate((place == 0, np.ones(len(whole), bool))),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["container", "doc_id", "start", "n_tokens", "place", "seed"])


def packed(df: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The tokens of (doc_id, text) assigned to containers: (container, doc_id, start, n_tokens, place, seed).

    A row is a run of a document's tokens, from start on. Texts are shuffled once, to their shards; one
    pass over a shard encodes, indexes and packs.
    """
    shards = max(1, -(-df.count() // SHARD))
    words = F.transform(F.split("text", r"[，。！？!?,.;；～\s]+"), lambda w: F.xxhash64(w))
    rows = df.select(F.col("doc_id").cast("bigint"), "text").where("text is not null and text <> ''").withColumn("sig", F.array_min(words))
    rows = rows.repartitionByRange(shards, "sig", "doc_id").sortWithinPartitions("sig", "doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    shared = SharedEncoder(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, counts = shared.get(), [], []
        for b in batches:
            if b.num_rows:
                held.append(b)
                counts.append(np.diff(encoder.encode(b.column(1).to_pylist())[0]))
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            texts = pa.chunked_array(t.column(1)).combine_chunks()
            yield pack_shard(t.column(2)[0].as_py(), t.column(0).to_numpy(), texts, np.concatenate(counts), capacity)

    return rows.mapInArrow(run, _SCHEMA)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents by byte_bpe_50k in containers of 2,048."""
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens, and the share of space used."""
    boxes = p9_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("items").alias("pieces"),
        F.round(F.sum("n") / (F.count("*") * CAPACITY), 4).alias("used"), F.count_if(F.col("n") == CAPACITY).alias("full"),
    )
