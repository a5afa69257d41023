"""Containers: every token once, none over capacity, nothing split that fits, little space unused."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxgrid.llm import packing
from voxgrid.llm import tokenizer as T

pytest.importorskip("public_tokenizers")


def check(rows, counts, capacity):
    boxes, docs = defaultdict(int), defaultdict(list)
    for r in rows:
        boxes[r.container] += r.n_tokens
        docs[r.doc_id].append((r.start, r.n_tokens))
    assert all(n <= capacity for n in boxes.values())
    assert {d for d, n in counts.items() if n} == set(docs)
    for d, runs in docs.items():
        runs.sort()
        assert [s for s, _ in runs] == list(np.cumsum([0] + [n for _, n in runs])[:-1])
        assert sum(n for _, n in runs) == counts[d]
        assert len(runs) == -(-counts[d] // capacity)
    return sum(boxes.values()) / (len(boxes) * capacity) if boxes else 1


def decreasing(sizes, capacity):
    """Containers that first-fit decreasing needs, ignoring which texts belong together."""
    rooms = []
    for n in sorted((x % capacity for x in sizes), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if n and at is None:
            rooms.append(capacity - n)
        elif n:
            rooms[at] -= n
    return len(rooms) + sum(x // capacity for x in sizes)


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 150)
    rng = random.Random(4)
    subjects = ["音箱的低频", "背包的拉链", "red lamp light", "keyboard keys feel"]
    texts = [rng.choice(subjects) * rng.choice([1, 2, 3, 5, 9, 30]) for _ in range(400)] + [None, "", " ", "长" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, container string")
    encoder = T.Encoder(*T._built(T.vocabulary_path()))
    counts = dict(enumerate(np.diff(encoder.encode(texts)[0]).tolist()))
    rows = packing.packed(df, 128).collect()
    check(rows, counts, 128)
    assert len({r.container for r in rows}) <= 1.06 * decreasing(counts.values(), 128)
    assert packing.packed(df.limit(0), 128).count() == 0
    twice = packing.packed(df.where("doc_id = 0").union(df.where("doc_id = 0")), 128).collect()
    assert len(twice) == 2 * -(-counts[0] // 128)


def test_neighbours_come_first():
    texts = pa.array(["音箱低频音箱低频" * 3, "背包拉链背包拉链" * 3, "音箱低频很好", "背包拉链很好", "完全无关的话"])
    index = packing.Index(texts, np.arange(5))
    s = index.scores(0)
    assert s[2] > max(s[1], s[3], s[4]) and s[4] == 0
    got = packing.fill(np.array([8, 8, 2, 2, 2]), 10, index.scores)
    assert sorted(map(sorted, got)) == [[0, 2], [1, 3], [4]]


def test_scores_against_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("音箱背包很好看吗") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    index = packing.Index(pa.array(texts), np.arange(40))
    grams = [[t[i : i + 2] for i in range(len(t) - 1)] for t in texts]
    mean = sum(map(len, grams)) / 40
    df = defaultdict(int)
    for g in grams:
        for w in set(g):
            df[w] += 1
    for i in (0, 7, 39):
        want = []
        for g in grams:
            s = 0.0
            for w in set(grams[i]):
                tf = g.count(w)
                idf = np.log(1 + (40 - df[w] + 0.5) / (df[w] + 0.5))
                s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(g) / mean)) if tf else 0
            want.append(s)
        assert np.allclose(index.scores(i), want, rtol=1e-4, atol=1e-5)
