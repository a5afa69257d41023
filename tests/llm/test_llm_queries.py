"""Every query of this subpackage on empty tables, and on ones with nulls in every column, repeats and extra columns."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxgrid.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for p in Path(DATA).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        df.limit(0).write.parquet(f"{root}/empty/{p.name}")
        few = df.limit(30)
        null = few.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        few.unionByName(few.limit(3)).unionByName(null).withColumn("n", F.lit("x")).withColumn("score", F.lit(1)).coalesce(1).write.parquet(f"{root}/dirty/{p.name}")
    return root


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, dirs, name):
    q = catalog.QUERIES[name]
    empty = q(spark, f"{dirs}/empty")
    assert empty.columns == q(spark, f"{dirs}/dirty").columns
    assert empty.count() == (1 if name == "p9_usage" else 0)
    q(spark, f"{dirs}/dirty").collect()
