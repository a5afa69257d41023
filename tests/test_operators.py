"""Evaluation, funnel, control, sampling and token operators by hand-worked numbers and plain readings."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from voxgrid.operators import control, evaluation, funnel, sampling, tokens
from voxgrid.operators import evidence as V


def test_kappa(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 10
    assert abs(evaluation.kappa(spark.createDataFrame(rows, "gold string, pred string")).first().kappa - 0.3077) < 0.001
    assert evaluation.kappa(spark.createDataFrame([("a", "a")], "gold string, pred string")).first().kappa == 1.0
    assert evaluation.kappa(spark.createDataFrame([], "gold string, pred string")).count() == 0


def test_calibration(spark):
    rows = [("a", "a", 0.95), ("a", "a", 0.99), ("a", "b", 0.65), ("a", "a", 0.61), ("a", "a", None)]
    got = {r.bin: (r.n, r.accuracy) for r in evaluation.calibration(spark.createDataFrame(rows, "gold string, pred string, confidence double")).collect()}
    assert got["0.9-1.0"] == (2, 1.0) and got["0.6-0.7"] == (2, 0.5) and got["missing"] == (1, 1.0) and got["0.0-0.5"] == (0, None)


def test_aspect_metrics(spark):
    rows = [({"A": "positive"}, {"A": "positive"}), ({"B": "negative"}, {"B": "positive"}), ({"A": "negative", "B": "positive"}, {"A": "negative", "B": "positive"}), ({}, {}), (None, None)]
    df = spark.createDataFrame(rows, "gold map<string,string>, pred map<string,string>")
    r = evaluation.aspect_prf(df, by_dim=False).first()
    assert (r.precision, r.recall, r.f1, r.mention_f1) == (0.75, 0.75, 0.75, 1.0)
    by = {x.dim: x for x in evaluation.aspect_prf(df).collect()}
    assert by["A"].f1 == 1.0 and by["B"].precision == by["B"].recall == 0.5
    e = evaluation.exact_match(df).first()
    assert e.n == 3 and abs(e.exact - 2 / 3) < 1e-4


def test_accuracy_groups(spark):
    df = spark.createDataFrame([("a", "a", "x"), ("a", "b", "x"), ("b", "b", None)], "gold string, pred string, g string")
    got = {(r.grp, r.segment): (r.n, r.accuracy) for r in evaluation.accuracy(df, "g").collect()}
    assert got == {("all", ""): (3, 0.6667), ("g", "x"): (2, 0.5), ("g", ""): (1, 1.0)}


def test_alignment_with_repeated_ids(spark):
    gold = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, ord long, gold string")
    pred = spark.createDataFrame([("a", 1, "x"), ("a", 5, "z")], "k string, ord long, pred string")
    assert sorted((r.gold, r.pred) for r in evaluation.aligned(gold, pred, "k", "ord").collect()) == [("x", "x"), ("y", "z")]


def test_funnel(spark):
    key = "run_id string, run_seq int, channel string, keyword string, query string, url string"
    kept = spark.createDataFrame([("r", 1, "c", "k", "q", f"u{i}") for i in range(3)], key)
    dropped = spark.createDataFrame([("r", 1, "c", "k", None, "u8", "too short", "quality", 1), ("r", 1, "c", "k", "", "u9", "duplicate", "duplicate", 2)], key + ", reason string, kind string, ord long")
    coded = spark.createDataFrame([("c", "k", "negative", False), ("c", "k", "negative", True), ("c", "k", "positive", None)], "channel string, keyword string, sentiment string, ad_flag boolean")
    r = funnel.extract(kept, dropped, coded).collect()
    assert len(r) == 1 and (r[0].collected, r[0].kept, r[0].dropped, r[0].coded, r[0].negative, r[0].ads) == (5, 3, 2, 3, 2, 1)
    assert r[0].effective_rate == 0.6 and r[0].quality_rate == 0.75 and r[0].reasons == {"too short": 1, "duplicate": 1}
    assert funnel.extract(kept.limit(0), dropped.limit(0), coded).count() == 0


def test_unique_urls(spark):
    key = "run_id string, channel string, query string, url string"
    kept = spark.createDataFrame([("r1", "c", "q", "u1"), ("r2", "c", "q", "u1"), ("r2", "c", "q", None)], key)
    dropped = spark.createDataFrame([("r1", "c", "q", "u1", "x", "quality", 1), ("r1", "c", "q", "u2", "first", "quality", 2), ("r2", "c", "q", "u2", "later", "duplicate", 3), ("r2", "c", "q", "", "x", "quality", 4)], key + ", reason string, kind string, ord long")
    r = funnel.unique_urls(kept, dropped).first()
    assert (r.collected, r.kept, r.dropped, r.quality_dropped) == (3, 2, 1, 1)


def test_quota_against_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), dt.datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 23)), i, rng.choice(["consume", "refund", "settle"]), rng.randint(0, 5), rng.randint(0, 5)) for i in range(400)]
    want = {}
    for c, ts, _, op, est, actual in sorted(rows, key=lambda r: (r[1], r[2])):
        k = (c, ts.date())
        want[k] = max(want.get(k, 0) + (est if op == "consume" else -est if op == "refund" else actual - est), 0)
    df = spark.createDataFrame(rows, "channel string, ts timestamp, seq int, op string, est int, actual int")
    assert {(r.channel, r.day): r.used for r in control.quota_fold(df, 10).collect()} == want
    assert not any(r.spent for r in control.quota_fold(df, 0).collect())


def test_cooldown_against_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), dt.datetime(2024, 1, 1, 0, 0, i), i, rng.random() < 0.4) for i in range(50)]
    level = {}
    for c, _, _, ok in rows:
        level[c] = 0 if ok else level.get(c, 0) + 1
    got = {r.channel: (r.level, r.minutes) for r in control.cooldown_fold(spark.createDataFrame(rows, "channel string, ts timestamp, seq int, ok boolean")).collect()}
    assert got == {c: (n, min(10 * 2 ** (n - 1), 60) if n else 0) for c, n in level.items()}


def test_top_up(spark):
    df = spark.range(10).selectExpr("id", "'quality' as kind")
    kept, dropped = control.top_up(lambda r: df.withColumn("r", F.lit(r)) if r < 5 else None, lambda x: (x.where("id < 4"), x.where("id >= 4")), target=20)
    assert kept.count() == 12 and dropped.count() == 18


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 10 = 0 then 'rare' else 'usual' end as s")
    take, rest = sampling.hold_out(df, "s", "id", 50)
    assert take.count() == 50 and rest.count() == 950 and take.join(rest, "id").count() == 0
    assert all(r.ok for r in sampling.share_check(take, df, "s").collect())
    a = {r.id for r in sampling.weighted_sample(df, "id", F.when(F.col("s") == "rare", 50.0).otherwise(1.0), 100).collect()}
    assert len(a) == 100 and sum(i % 10 == 0 for i in a) > 50
    assert a == {r.id for r in sampling.weighted_sample(df.repartition(7), "id", F.when(F.col("s") == "rare", 50.0).otherwise(1.0), 100).collect()}
    rows = [{"id": i, "p": "a" if i < 3 else "b"} for i in range(20)]
    got = sampling.quota_sample(rows, {"p": {"a": 2, "b": 3}}, 6)
    assert len(got) == 6 and sum(r["p"] == "a" for r in got) >= 2
    e = sampling.edge_sample(df, "id", [("x", F.col("id") < 5), ("y", F.col("id") < 8)], 4)
    assert sorted((r.id, r.subset) for r in e.collect()) == [(i, "x") for i in range(4)] + [(i, "y") for i in range(4, 8)]


def test_cooccurrence_against_reading(spark):
    rng = random.Random(6)
    docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(200)]
    both, df = Counter(), Counter()
    for d in docs:
        df.update(set(d))
        both.update({tuple(sorted((d[i], d[j]))) for i in range(len(d)) for j in range(i + 1, min(i + 4, len(d))) if d[i] != d[j]})
    want = {k: round(math.log(n * sum(map(bool, docs)) / (df[k[0]] * df[k[1]])), 3) for k, n in both.items() if n >= 3}
    got = tokens.cooccurrence(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc long, tokens array<string>"), k=None).collect()
    assert {(r.source, r.target): r.n for r in got} == {k: both[k] for k in want}
    assert all(math.isclose(r.weight, want[r.source, r.target], abs_tol=2e-3) for r in got)


def test_communities():
    ring = lambda xs, w: [(a, b, w) for a, b in itertools.combinations(xs, 2)]
    edges = ring("abcd", 2.0) + ring("efgh", 2.0) + [("d", "e", 0.1)]
    assert tokens.communities(edges) == [list("abcd"), list("efgh")]
    assert tokens.communities(edges) == tokens.communities(edges[::-1])
    many = [e for i in range(8) for e in ring([f"{i}x", f"{i}y", f"{i}z"], 1.0)]
    got = tokens.communities(many)
    assert len(got) == 5 and len(got[-1]) == 12 and sorted(x for g in got for x in g) == sorted({x for a, b, _ in many for x in (a, b)})
    assert tokens.cluster_view(5, edges)[0] == "none" and tokens.cluster_view(50, edges[:3])[0] == "pairs"


def test_suppression(spark):
    rows = [("音质 很好", 5, 3.0, 0.1, [1]), ("音质", 4, 3.0, 0.1, [1]), ("别的", 9, 1.0, 0.0, [2])]
    got = tokens.suppressed(spark.createDataFrame(rows, "phrase string, n long, pmi double, sentiment double, samples array<long>"))
    assert [r.phrase for r in got.collect()] == ["音质 很好", "别的"]


def test_supported_findings(spark):
    found = spark.createDataFrame([("f1", ["E1", "E2"], "a long enough action"), ("f2", ["E9"], "a long enough action"), ("f3", ["E1"], "short"), ("f4", [], "a long enough action")], "id string, refs array<string>, action string")
    cards = spark.createDataFrame([("E1",), ("E2",)], "card string")
    assert [r.id for r in V.supported(found, cards).collect()] == ["f1"]
