"""Scopes, unions and contracts on hand-worked rows."""

from pyspark.sql import functions as F

from voxgrid.operators import scoping as X


def test_scopes(spark):
    df = spark.createDataFrame([("websearch",), ("websearch_tieba",), ("weibo",), (None,)], "channel_id string")
    assert X.channel_rows(df, None).count() == 2 and X.channel_rows(df, "weibo").count() == 1
    gold = spark.createDataFrame([(1, "yes", None), (2, "Yes ", "是"), (3, "no", ""), (4, None, ""), (5, "yes", "no"), (6, "yes", "TRUE")], "id int, relevant string, gold_revised_by_model string")
    assert {r.id for r in X.gold_rows(gold).collect()} == {1, 5} and {r.id for r in X.gold_rows(gold, True).collect()} == {1, 2, 5, 6}
    urls = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    assert X.kept_rows(urls, urls.where("url is null or url = 'a'")).count() == 2
    logs = spark.createDataFrame([("t1", 1), ("t2", 2), (None, 3)], "task_id string, n int")
    assert {r.n for r in X.logs_kept(logs, logs.where("n <> 2")).collect()} == {2, 3}
    flags = spark.createDataFrame([("a", True), ("b", False), ("b", True)], "url string, relevant boolean")
    kept, dropped = X.relevance_applied(urls, flags, "url")
    assert kept.count() == 3 and [r.url for r in dropped.collect()] == ["b"]
    seen, none = X.relevance_applied(urls, flags, "url", review=True)
    assert seen.count() == 4 and none.count() == 0 and seen.where("not relevant").count() == 1


def test_values(spark):
    df = spark.createDataFrame([(["b", "a", None], {"c": " Positive", "x": "neutral", "a": "NEGATIVE"}), (None, None)], "d array<string>, m map<string,string>")
    got = df.select(X.item_dimensions(F.col("d"), F.col("m")).alias("u"), X.aspects_kept(F.col("m"), ["a", "c", "x"]).alias("k"), X.appended(F.col("d"), F.array(F.lit("a"), F.lit("z")), 3).alias("p")).collect()
    assert got[0].u == ["a", "b", "c", "x"] and got[0].k == {"c": "positive", "a": "negative"} and got[0].p == ["b", "a", None]
    assert got[1].u == [] and got[1].k == {} and got[1].p == ["a", "z"]
    n = spark.createDataFrame([(" Conflict",), ("gossip",), (None,)], "v string").select(X.narrative_kept(F.col("v")).alias("v")).collect()
    assert [r.v for r in n] == ["conflict", None, None]
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "dim string")
    assert {r.dim: r.name for r in X.display_names(rows, "dim", names.where("id = 'a'"), names.replace("A", "shipped")).collect()} == {"a": "A", "b": "B", "c": "c"}


def test_groups(spark):
    rows = [("k", None, 1), ("k", 5, 2), ("k", 5, 3), ("k", 9, 4), (None, 1, 5)]
    df = spark.createDataFrame(rows, "g string, likes long, id int")
    assert {r.id for r in X.hot_rows(df, "g", "likes", "id", 2).collect()} == {4, 2, 5}
    a, b = (spark.createDataFrame(x, "key string, n long") for x in ([("x", 3), ("y", 1)], [("x", 2), ("z", 4)]))
    assert {r.key: r.n for r in X.max_union(a, b, "key").collect()} == {"x": 3, "y": 1, "z": 4}
    assert X.key_union(a, b, "key").count() == 3
    docs = spark.createDataFrame([(["u", "u", "v"], {"d": "negative"}), (["v"], {"d": "positive"}), (["w"], None)], "tokens array<string>, dimension_sentiments map<string,string>")
    assert [tuple(r) for r in X.worst_words(docs, "d").collect()] == [("u", 2), ("v", 1)] and X.worst_words(docs, None).count() == 0
