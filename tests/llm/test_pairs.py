"""Pair statistics against counting by hand."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxgrid.llm import pairs


def brute(records):
    n, single, both = len(records), Counter(), Counter()
    for items in records:
        single.update(items)
        both.update(itertools.combinations(sorted(items), 2))
    return {(a, b): (k, single[a], single[b], n) for (a, b), k in both.items()}


def sets_of(spark, records):
    return spark.createDataFrame([(sorted(r),) for r in records], "items array<string>")


def test_against_counting(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["热", "é", "😀"]
    records = [set(rng.choices(words, k=rng.randint(0, 6))) | ({"hot"} if rng.random() < 0.4 else set()) for _ in range(600)]
    want = brute(records)
    for run, whole in ((pairs.RUN, pairs.WHOLE_DICTIONARY), (50, pairs.WHOLE_DICTIONARY), (50, 3)):
        monkeypatch.setattr(pairs, "RUN", run)
        monkeypatch.setattr(pairs, "WHOLE_DICTIONARY", whole)
        got = pairs.pair_statistics(sets_of(spark, records)).collect()
        assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in got} == want
    r = got[0]
    cells = [r.n_ab, r.n_a - r.n_ab, r.n_b - r.n_ab, r.n_records - r.n_a - r.n_b + r.n_ab]
    odds = (cells[0] + 0.5) * (cells[3] + 0.5) / ((cells[1] + 0.5) * (cells[2] + 0.5))
    assert math.isclose(r.odds_ratio, odds, abs_tol=1e-6)
    got = pairs.pair_statistics(sets_of(spark, records), least=5, share=40).collect()
    assert {(r.item_a, r.item_b) for r in got} == {k for k, v in want.items() if v[0] >= 15}


def test_nulls_repeats_and_empty(spark):
    rows = [("a", None, ["x", "x", None, " Y "], None), ("a", None, ["z"], []), ("b", "t", None, None), (None, "t", [" "], ["d", ""])]
    df = spark.createDataFrame(rows, "text_id string, text string, k array<string>, r1 array<string>")
    items = F.filter(F.transform(F.coalesce("k", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    sets = pairs.item_sets(df, ["text_id", "text"], items)
    assert sorted(sorted(r["items"]) for r in sets.collect()) == [[], [], ["Y", "x", "z"]]
    assert pairs.pair_statistics(sets.limit(0)).count() == 0


def test_runs():
    codes, n = pairs._runs(np.array([5, 1, 5, 2, 1, 5]))
    assert codes.tolist() == [1, 2, 5] and n.tolist() == [2, 1, 3]


def test_codes_in_blocks(monkeypatch):
    """A record with more pairs than a run gives the same codes, a block at a time."""
    import numpy as np

    from voxgrid.llm import pairs

    ids, offsets = np.array([3, 7, 8, 9, 11, 2, 5, *range(20, 60)], np.int64), np.array([0, 5, 7, 7, 47])
    want = sorted((int(ids[i]) << 32) | int(ids[j]) for a, b in zip(offsets[:-1], offsets[1:]) for i in range(a, b) for j in range(i + 1, b))
    for run in (2_000_000, 50, 1):
        monkeypatch.setattr(pairs, "RUN", run)
        got = list(pairs._codes(offsets, ids))
        assert sorted(np.concatenate(got).tolist()) == want and max(map(len, got)) <= max(run, 40)
