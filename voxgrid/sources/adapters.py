"""Records of collecting channels as post rows: JSON of each platform, search result pages, files.

Adapters parse a string column; unreadable records give null fields, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.functions import text as T

POST = ("id", "title", "content", "author", "url", "timestamp", "likes", "reposts", "comments_count")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def weibo(df: DataFrame, raw: str) -> DataFrame:
    """A micro-blog card: text without tags, counts, user."""
    j = F.from_json(raw, "mblog struct<id:string,text:string,created_at:string,attitudes_count:bigint,reposts_count:bigint,comments_count:bigint,user:struct<screen_name:string>>, card_type int, ad_marked boolean")
    b = df.withColumn("__j", j)
    return b.select(*df.columns, F.col("__j.mblog.id").alias("id"), F.lit("").alias("title"), T.squeeze(T.unescape(T.strip_tags(F.col("__j.mblog.text")))).alias("content"), F.col("__j.mblog.user.screen_name").alias("author"),
                    F.concat(F.lit("https://m.weibo.cn/detail/"), "__j.mblog.id").alias("url"), F.col("__j.mblog.created_at").alias("timestamp"), F.coalesce("__j.mblog.attitudes_count", F.lit(0)).alias("likes"),
                    F.coalesce("__j.mblog.reposts_count", F.lit(0)).alias("reposts"), F.coalesce("__j.mblog.comments_count", F.lit(0)).alias("comments_count"),
                    F.when(F.coalesce("__j.ad_marked", F.lit(False)), "advert").when(F.col("__j.card_type") != 9, "not a post").alias("drop_reason"))


def bilibili(df: DataFrame, raw: str) -> DataFrame:
    """A video: description, else desc, else title as content; epoch seconds as time."""
    b = df.withColumn("__j", F.from_json(raw, "bvid string, title string, description string, desc string, author string, pubdate bigint, like bigint, review bigint"))
    title = T.squeeze(T.unescape(T.strip_tags(F.col("__j.title"))))
    return b.select(*df.columns, F.col("__j.bvid").alias("id"), title.alias("title"), F.coalesce(_text(F.col("__j.description")), _text(F.col("__j.desc")), title).alias("content"), F.col("__j.author").alias("author"),
                    F.concat(F.lit("https://www.bilibili.com/video/"), "__j.bvid").alias("url"), F.timestamp_seconds("__j.pubdate").cast("string").alias("timestamp"), F.coalesce("__j.like", F.lit(0)).alias("likes"), F.lit(0).cast("bigint").alias("reposts"), F.coalesce("__j.review", F.lit(0)).alias("comments_count"))


def xiaohongshu(df: DataFrame, raw: str) -> DataFrame:
    """A note whose fields are a list of field and value, or plain members; counts like 1.2万."""
    b = df.withColumn("__j", F.from_json(raw, "id string, title string, author string, url string, likes string, time string, content string, fields array<struct<field:string,value:string>>"))
    pairs = F.filter(F.coalesce("__j.fields", F.array().cast("array<struct<field:string,value:string>>")), lambda x: x.field.isNotNull())
    last = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<field:string,value:string>>"), lambda a, x: F.concat(F.filter(a, lambda y: y.field != x.field), F.array(x))))
    at = lambda name: F.coalesce(F.try_element_at(last, F.lit(name)), F.col(f"__j.{name}"))
    url = at("url")
    return b.select(*df.columns, F.coalesce(F.col("__j.id"), T.note_id(url)).alias("id"), at("title").alias("title"), F.coalesce(_text(at("content")), at("title")).alias("content"), at("author").alias("author"), url.alias("url"),
                    at("time").alias("timestamp"), F.coalesce(T.chinese_count(at("likes")), F.lit(0)).alias("likes"), F.lit(0).cast("bigint").alias("reposts"), F.lit(0).cast("bigint").alias("comments_count"))


def result_links(df: DataFrame, page: str) -> DataFrame:
    """(.., ord, url, title) of a search page's headings: scheme added, redirectors skipped, a title required."""
    blocks = F.regexp_extract_all(page, F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), F.lit(1))
    rows = df.select(*df.columns, F.posexplode(blocks).alias("ord", "block"))
    href = F.regexp_extract("block", r"""(?i)<a[^>]*href=["']([^"']+)["']""", 1)
    url = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    rows = rows.withColumn("url", url).withColumn("title", T.squeeze(T.unescape(T.strip_tags(F.col("block"))))).drop("block")
    return rows.where((F.col("url") != "") & (F.col("title") != "") & ~F.col("url").rlike(r"so\.com/link|bing\.com|go\.microso"))


def page_title(page: Column) -> Column:
    return T.squeeze(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV, with or without a byte-order mark, its aspect column as a map."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if "dimension_sentiments" in df.columns:
        df = df.withColumn("dimension_sentiments", F.coalesce(F.from_json("dimension_sentiments", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank and broken ones."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def report_files(spark: SparkSession, root: str, name: str = "result.json", archived: bool = False) -> DataFrame:
    """(path, run_id, content) of all reports under a folder, each content once; the id is the start of its hash."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    if not archived:
        df = df.where(~F.col("path").contains("/archive/"))
    rows = df.select("path", F.concat(F.lit("sha256:"), F.substring(F.sha2("content", 256), 1, 12)).alias("run_id"), F.col("content").cast("string").alias("content"))
    return rows.groupBy("run_id").agg(F.min_by(F.struct("path", "content"), "path").alias("x")).select("run_id", "x.path", "x.content")


def new_reports(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("run_id").distinct(), "run_id", "left_anti")


def markdown_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Markdown table of (name, keywords), keywords split at commas."""
    t = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = t.select(F.try_element_at(cells, F.lit(1)).alias("name"), F.try_element_at(cells, F.lit(2)).alias("words"))
    return rows.select("name", F.filter(F.transform(F.split(F.coalesce("words", F.lit("")), "[,，、]"), lambda w: F.trim(w)), lambda w: w != "").alias("keywords"))


def merge_lexicons(spark: SparkSession, sources: list[dict[str, float]], context: list[str]) -> DataFrame:
    """(word, score) of several lists: 2 to 8 characters, lower case, the first list that has a word decides, context words left out."""
    rows = [(w.strip().lower(), float(s), i) for i, src in enumerate(sources) for w, s in src.items() if 2 <= len(w.strip()) <= 8]
    df = spark.createDataFrame(rows, "word string, score double, src int")
    return df.groupBy("word").agg(F.min_by("score", "src").alias("score")).where(~F.col("word").isin(context) if context else F.lit(True))


def merge_schemas(rows: DataFrame) -> DataFrame:
    """One row per aspect id over several schemas: the first name, keywords united in order. rows: (ord, dim_id, dim_name, keywords)."""
    words = rows.select("dim_id", "ord", F.posexplode("keywords").alias("pos", "k")).groupBy("dim_id", "k").agg(F.min(F.struct("ord", "pos")).alias("at"))
    kw = words.groupBy("dim_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "k"))), lambda x: x.k).alias("keywords"))
    return rows.groupBy("dim_id").agg(F.min("ord").alias("ord"), F.min_by("dim_name", "ord").alias("dim_name")).join(kw, "dim_id", "left")
