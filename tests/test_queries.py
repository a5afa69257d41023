"""Every core query on the smallest tables, on empty ones, and on ones with nulls in every column and extra columns."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxgrid.plans import catalog, pipeline
from voxgrid.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    """The tables emptied, and the tables with a row of nulls, repeated rows and a column of another's name added."""
    root = tmp_path_factory.mktemp("tables")
    for p in Path(DATA).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        df.limit(0).write.parquet(f"{root}/empty/{p.name}")
        few = df.limit(30)
        null = few.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        few.unionByName(few.limit(3)).unionByName(null).withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).coalesce(1).write.parquet(f"{root}/dirty/{p.name}")
    return root


@pytest.mark.parametrize("name", NAMES)
def test_runs(spark, dirs, name):
    q = catalog.QUERIES[name]
    full = q(spark, DATA)
    n = full.count()
    assert n >= 0 and full.columns
    for kind in ("empty", "dirty"):
        got = q(spark, f"{dirs}/{kind}")
        assert got.columns == full.columns
        got.collect()


def test_sql_is_for_queries():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_pipeline(spark):
    posts, comments = table(spark, DATA, "posts"), table(spark, DATA, "comments")
    got = pipeline.analyse(posts, comments, [("sound_feel", ["音质", "sound"]), ("ship_speed", ["物流", "快递"])])
    b = got["balance"].first()
    assert b.ok and b.input == posts.count()
    assert sum(r.n for r in got["sentiment"].collect()) == got["items"].where("not ad_flag").count()
    for df in got.values():
        df.collect()
    after = pipeline.after_review(table(spark, DATA, "coded_items"), table(spark, DATA, "feedback"))
    assert after["items"].count() == table(spark, DATA, "coded_items").count()


def test_analyzer(spark):
    class Picky:
        def analyze(self, texts):
            if len(texts) > 2 or "bad" in texts:
                raise ValueError("too much")
            return ["ok"] * len(texts)

    df = spark.createDataFrame([("a",), ("b",), ("bad",), ("c",), ("a",), (None,)], "text string").coalesce(1)
    assert {r.text: r.label for r in pipeline.analyzed(df, Picky).collect()} == {"a": "ok", "b": "ok", "c": "ok", "bad": None}
    assert pipeline.analyzed(df, pipeline.OfflineAnalyzer).count() == 4
