"""Adapters, the demo source, sinks and file readers on small inputs."""

import json

from pyspark.sql import functions as F

from voxgrid.sources import adapters as A
from voxgrid.sources import channels as CH
from voxgrid.sources import sinks as K


def test_json_adapters(spark):
    w = {"mblog": {"id": "9", "text": "很<b>好</b> &amp; 快", "created_at": "Mon", "attitudes_count": 3, "user": {"screen_name": "甲"}}, "card_type": 9}
    rows = [(1, json.dumps(w)), (2, json.dumps({**w, "ad_marked": True})), (3, json.dumps({"card_type": 4})), (4, "{broken"), (5, None)]
    got = {r.k: r for r in A.weibo(spark.createDataFrame(rows, "k int, raw string"), "raw").collect()}
    assert (got[1].id, got[1].content, got[1].likes, got[1].reposts, got[1].drop_reason) == ("9", "很好 & 快", 3, 0, None)
    assert got[2].drop_reason == "advert" and got[3].drop_reason == "not a post" and got[4].id is None and got[5].id is None
    b = [(1, json.dumps({"bvid": "B1", "title": "<em>题</em>", "description": " ", "desc": "说明", "pubdate": 86400, "like": 2})), (2, json.dumps({"bvid": "B2", "title": "题"}))]
    got = {r.k: r for r in A.bilibili(spark.createDataFrame(b, "k int, raw string"), "raw").collect()}
    assert got[1].content == "说明" and got[1].timestamp.startswith("1970-01-02") and got[2].content == "题"
    x = [(1, json.dumps({"url": "https://x.com/n/64ab12?z=1", "fields": [{"field": "title", "value": "旧"}, {"field": "title", "value": "新"}, {"field": "likes", "value": "1.2万"}]})), (2, json.dumps({"id": "7", "title": "t"}))]
    got = {r.k: r for r in A.xiaohongshu(spark.createDataFrame(x, "k int, raw string"), "raw").collect()}
    assert (got[1].id, got[1].title, got[1].content, got[1].likes) == ("64ab12", "新", "新", 12000) and got[2].id == "7" and got[2].likes == 0


def test_result_links(spark):
    page = '<h3><a href="//a.com/1">A &lt;b&gt;</a></h3><h2><a href="https://bing.com/x">no</a></h2><h3><a href="https://c.com"></a></h3><h3>none</h3><title> T </title>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, page string")
    assert [(r.url, r.title) for r in A.result_links(df, "page").collect()] == [("https://a.com/1", "A <b>")]
    assert df.select(A.page_title(F.col("page")).alias("t")).first().t == "T"


def test_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿text_id,text,dimension_sentiments\na,"x\n""y""","{""音质"": ""positive""}"\nb,z,\n', encoding="utf-8")
    got = {r.text_id: r for r in A.gold_csv(spark, str(tmp_path / "g.csv")).collect()}
    assert got["a"].text == 'x\n"y"' and got["a"].dimension_sentiments == {"音质": "positive"} and got["b"].dimension_sentiments == {}
    (tmp_path / "h.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in A.json_lines(spark, str(tmp_path / "h.jsonl"), "a int").collect()) == [1, 2]
    for p, t in (("r1/result.json", "{}"), ("r2/result.json", "{}"), ("r3/result.json", "[]"), ("archive/r4/result.json", "9")):
        f = tmp_path / "runs" / p
        f.parent.mkdir(parents=True)
        f.write_text(t)
    found = A.report_files(spark, str(tmp_path / "runs"))
    assert found.count() == 2 and found.where("run_id like 'sha256:%' and length(run_id) = 19").count() == 2
    assert A.new_reports(found, found.limit(1)).count() == 1
    (tmp_path / "d.md").write_text("# x\n| 名称 | 关键词 |\n|---|---|\n| 音质 | 低频, 高频 |\n| 物流 | |\n")
    assert [(r.name, r.keywords) for r in A.markdown_rows(spark, str(tmp_path / "d.md")).collect()] == [("名称", ["关键词"]), ("音质", ["低频", "高频"]), ("物流", [])]


def test_merges(spark):
    got = {r.word: r.score for r in A.merge_lexicons(spark, [{"好用": 1.0, "x": 2.0}, {"好用": -1.0, "BAD": -1.0, "看好": 1.0}], ["看好"]).collect()}
    assert got == {"好用": 1.0, "bad": -1.0}
    rows = spark.createDataFrame([(1, "a", "A", ["x", "y"]), (2, "a", "B", ["y", "z"]), (3, "b", "C", [])], "ord int, dim_id string, dim_name string, keywords array<string>")
    got = {r.dim_id: (r.dim_name, r.keywords) for r in A.merge_schemas(rows).collect()}
    assert got == {"a": ("A", ["x", "y", "z"]), "b": ("C", None)}


def test_demo_source(spark):
    posts, runs = CH.collect(spark, ["demo", "nowhere"], keywords="音箱,背包", posts="3")
    rows = posts.collect()
    assert len(rows) == 2 * 4 * 3 and len({r.post_seq for r in rows}) == 24
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in CH.collect(spark, ["demo"], keywords="音箱,背包", posts="3")[0].collect())
    got = {r.channel_id: r for r in CH.ordered(runs).collect()}
    assert got["demo"].ok and got["demo"].posts == 24 and not got["nowhere"].ok and "KeyError" in got["nowhere"].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    K.write_bundle({"t": df}, str(tmp_path / "b"))
    assert K.read_bundle(spark, str(tmp_path / "b"), "t")["t"].collect() == df.collect()
    K.append_history(df, str(tmp_path / "h"))
    K.append_history(df, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).count() == 2
    K.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().y == "a"
    assert [K.run_folder(str(tmp_path), "run").name for _ in range(3)] == ["run", "run-2", "run-3"]
