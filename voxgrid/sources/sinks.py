"""Results as files: bundles, sheets, histories, review snapshots, versioned run folders."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgrid.functions import text as T


def write_bundle(bundle: Mapping[str, DataFrame], path: str) -> None:
    """Every frame of a bundle as a Parquet table of its name."""
    for name, df in bundle.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark, path: str, *names: str) -> dict[str, DataFrame]:  # noqa: ANN001
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, one column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def index_row(items: DataFrame, posts: DataFrame) -> DataFrame:
    """The headline fields of a report: posts, items, negatives, first and last collection."""
    p = posts.agg(F.count("*").alias("posts"), F.min("collected_at").alias("first"), F.max("collected_at").alias("last")).withColumn("k", F.lit(1))
    i = items.agg(F.count("*").alias("items"), F.count_if(F.col("sentiment") == "negative").alias("negative")).withColumn("k", F.lit(1))
    return p.join(i, "k").drop("k")


def post_sheet(posts: DataFrame) -> DataFrame:
    """Posts as a sheet shows them: masked text, counts as text."""
    return posts.select("post_seq", "platform", "keyword", T.mask(F.col("title")).alias("title"), T.shorten(T.mask(F.col("content")), 200).alias("content"), "url", F.concat_ws("/", F.col("likes").cast("string"), F.col("reposts").cast("string"), F.col("comments_count").cast("string")).alias("counts"))


def drop_sheet(drops: DataFrame) -> DataFrame:
    return drops.select("platform", "url", T.mask(F.col("title")).alias("title"), "step", "reason", "kind")


def review_snapshot(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments with the id under which reviewers exclude them: address of the post and place among its comments, from 0."""
    from pyspark.sql import Window as W

    urls = posts.groupBy("id").agg(F.min_by("url", "post_seq").alias("url"))
    n = F.row_number().over(W.partitionBy("post_id").orderBy("comment_seq")) - 1
    return comments.withColumn("n", n).join(urls, comments["post_id"] == urls["id"]).select("comment_seq", F.concat_ws("::", "url", F.col("n").cast("string")).alias("review_id"))


def append_history(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small result."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def run_folder(root: str, name: str) -> Path:
    """A new folder for a run: name, else name-2, name-3, .."""
    at, n = Path(root, name), 1
    while at.exists():
        n += 1
        at = Path(root, f"{name}-{n}")
    at.mkdir(parents=True)
    return at
