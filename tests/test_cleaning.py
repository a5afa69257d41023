"""Cleaning rules by hand; first-wins de-duplication against a sequential reading; ledger balance."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxgrid.functions import text as T
from voxgrid.operators import cleaning as K

POST = "post_seq long, id string, platform string, keyword string, title string, content string, url string"


def sequential(rows):
    """The rule as it reads: rows in order, keys of kept ones only."""
    seen, out = set(), {}
    for seq, id_, _, _, title, content, url in sorted(rows):
        t, b = (title or "").strip(), (content or "").strip()
        keys = [("id", id_ or ""), ("url", url or "")]
        if t:
            keys.append(("title", t[:50]))
        if b != t and len(b) >= 20:
            keys.append(("body", b[:50]))
        hit = next((k for k in keys if k in seen), None)
        out[seq] = hit[0] if hit else None
        if not hit:
            seen.update(keys)
    return out


def greedy(spark, rows):
    got = K.greedy_duplicates(spark.createDataFrame(rows, POST), "post_seq", K.post_keys()).collect()
    assert all(r.kept == (r.reason is None) for r in got)
    return {r.post_seq: r.reason for r in got}


def test_only_kept_rows_register(spark):
    rows = [(1, "a", "w", "k", "t1", None, "u1"), (2, "b", "w", "k", "t2", None, "u1"), (3, "c", "w", "k", "t2", None, "u3"), (4, "d", "w", "k", None, None, ""), (5, "e", "w", "k", "", None, None), (6, "a", "w", "k", "t9", None, "u9")]
    assert greedy(spark, rows) == {1: None, 2: "url", 3: None, 4: None, 5: "url", 6: "id"} == sequential(rows)
    assert greedy(spark, []) == {}
    assert greedy(spark, [(None, "a", "w", "k", "t", None, "u"), (1, "a", "w", "k", "t", None, "u")]) == {None: None, 1: None}


def test_chains_and_hot_keys(spark):
    rng = random.Random(1)
    body = "这是一段足够长的正文，用来当作去重的第四个键，" * 3
    rows = [(i, rng.choice(["x", f"i{i}", f"i{i - 1}"]), "w", "k", rng.choice([None, "热门标题", f"t{i // 2}"]), rng.choice([None, body, body + str(i), f"短{i}"]), rng.choice(["", f"u{i}", f"u{i // 3}"])) for i in range(600)]
    assert greedy(spark, rows) == sequential(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["t1", "t2", "", None]), st.sampled_from(["u1", "u2", "u3", "", None])), max_size=14))
def test_against_sequential(spark, xs):
    rows = [(i, a, "w", "k", t, None, u) for i, (a, t, u) in enumerate(xs)]
    assert greedy(spark, rows) == sequential(rows)


def test_rules(spark):
    rows = [
        (1, "a", "weibo", "音箱", "音箱很好", "音箱用了三天，声音很清楚，推荐给大家", "u1"), (2, "b", "weibo", "音箱", "嗯", "好", "u2"), (3, "c", "weibo", "音箱", "", "", "u3"),
        (4, "d", "websearch", "音箱", "音箱官方旗舰店", "音箱现货，全国联保，欢迎选购", "u4"), (5, "e", "weibo", "音箱", "音箱", "版权所有 音箱 2024", "u5"), (6, "f", "weibo", "音箱", "无关", "无关", "u6"), (7, "g", "weibo", "音箱", None, None, None),
    ]
    df = K.clean(spark.createDataFrame(rows, POST), T.relevance_contains(F.concat_ws(" ", "title", "content"), F.array("keyword")))
    got = {r.post_seq: list(r.reasons) for r in df.collect()}
    assert got[1] == [] and got[2] == ["too short"] and got[3] == ["empty"] and got[4] == ["official page"] and got[5] == ["boilerplate"] and got[6] == ["too short"] and got[7] == ["empty"]
    b = K.balance(df).first()
    assert b.ok and b.input == 7 and b.kept == 1
    assert {(r.kind, r.step) for r in K.ledger(df).collect()} == {("quality", "rules")}
    assert K.balance(df.limit(0)).first().input == 0


def test_first_wins_and_cap(spark):
    df = spark.createDataFrame([(3, "a", 0.1), (1, "a", 0.5), (2, None, 0.2), (4, None, 0.2)], "s long, k string, score double")
    assert sorted(r.s for r in K.first_wins(df, "s", F.col("k")).collect()) == [1, 2]
    assert [r.s for r in K.capped(df, "score > 0", "score", "s", 2).collect()] == [3, 2]


def test_window_and_unseen(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert df.where(K.in_window(F.col("d"), F.lit("2024-02-01").cast("date"), None)).count() == 2
    a = spark.createDataFrame([("x",), ("y",), (None,)], "url string")
    assert a.transform(lambda x: K.unseen(x, a.where("url = 'x'"))).count() == 2


def test_comments(spark):
    rows = [(1, "c1", "p", "A", "t", 5, False, "", 0), (2, "c2", "p", "B", "t", 9, False, "", 0), (3, "c1", "p", "A", "t", 7, False, "", 0), (4, "r1", "p", "X", "t", 1, True, "A", 1), (5, "r2", "p", "Y", "t", 3, True, "A", 1), (6, "", "p", "C", None, None, False, None, 0), (7, "", "p", "C", None, None, False, None, 0)]
    df = spark.createDataFrame(rows, "comment_seq long, id string, post_id string, author string, text string, likes long, is_reply boolean, reply_to string, depth int")
    got = sorted((r.place, r.part, r.comment_seq) for r in K.flatten_comments(df).collect())
    assert got == [(1, 0, 2), (2, 0, 1), (2, 1, 5), (3, 0, 6), (4, 0, 7)]


def test_imbalance_is_an_error(spark):
    import pytest

    from voxgrid.operators.cleaning import balanced

    good = spark.createDataFrame([(True,), (False,)], "kept boolean")
    assert balanced(good).first().input == 2
    with pytest.raises(ValueError):
        balanced(good.unionByName(spark.createDataFrame([(None,)], "kept boolean")))
