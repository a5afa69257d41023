"""Summaries of coded items: distributions, platforms, aspects, dates, keywords, narratives, voice.

The items that aren't advertisements (ad_flag false or null) are the population of every sentiment
figure; counts of collected material keep them. Empty tables give empty results, except where a row
per known value is promised: those have zeros.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C


def not_ad() -> Column:
    return ~F.coalesce(F.col("ad_flag"), F.lit(False))


def stat(items: DataFrame) -> DataFrame:
    """The population of sentiment figures."""
    return items.where(not_ad())


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.round(F.when(b != 0, a / b).otherwise(F.lit(0.0)), digits)


def mean4(c: Column | str) -> Column:
    """The mean to four digits, 0 for no rows. A hair is added first, so that ties don't depend on the order of summation."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)) + F.lit(1e-9), 4)


def day_text(c: str = "pub_date") -> Column:
    """A partly normalised date as yyyy-MM-dd where it has year, month and day, else its first ten characters; blank is unknown."""
    p = r"([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})"
    y, m, d = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
    full = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.coalesce(F.when(y != "", full).otherwise(F.nullif(F.substring(F.trim(c), 1, 10), F.lit(""))), F.lit(C.UNKNOWN_DATE))


def spine(like: DataFrame, name: str, values: Iterable) -> DataFrame:
    """A row per known value, in the session of another frame."""
    return like.sparkSession.createDataFrame([(v,) for v in values], f"{name} {'int' if all(isinstance(v, int) for v in values) else 'string'}")


def sentiment_distribution(items: DataFrame) -> DataFrame:
    """Count and share of each of the three sentiments."""
    n = stat(items).groupBy("sentiment").agg(F.count("*").alias("n"))
    rows = spine(items, "sentiment", C.SENTIMENTS).join(n, "sentiment", "left").select("sentiment", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.select("sentiment", "n", ratio(F.col("n"), F.sum("n").over(W.partitionBy())).alias("ratio"))


def platform_stats(items: DataFrame) -> DataFrame:
    """Items of a platform, and mean score and sentiment counts of those that aren't ads."""
    is_stat = not_ad()
    part = lambda s: F.count_if(is_stat & (F.col("sentiment") == s)).alias(s)
    avg = mean4(F.when(is_stat, F.col("sentiment_score")))
    return items.groupBy("platform").agg(F.count("*").alias("posts"), avg.alias("avg_score"), *[part(s) for s in C.SENTIMENTS])


def aspects(items: DataFrame, *keep: str) -> DataFrame:
    """A row per item and aspect with its sentiment; items without aspects give none."""
    return stat(items).select(*keep, F.explode("dimension_sentiments").alias("dim", "value"))


def aspect_grid(items: DataFrame, *by: Column) -> DataFrame:
    """Count, negatives and rate of each aspect, alone or with other keys."""
    rows = stat(items).select(*by, F.explode("dimension_sentiments").alias("dim", "value"))
    keys = [c for c in rows.columns if c != "value"]
    score = F.when(F.col("value") == "positive", 1.0).when(F.col("value") == "negative", -1.0).otherwise(0.0)
    neg = F.count_if(F.col("value") == "negative")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), neg.alias("negative"), ratio(neg, F.count("*")).alias("negative_rate"), mean4(score).alias("avg_score"))


def item_sets(items: DataFrame) -> DataFrame:
    """Sentiment, platform, date and intensity counts in one pass over the items, by grouping sets."""
    rows = stat(items).select("sentiment", "platform", day_text().alias("day"), "intensity", "sentiment_score")
    sets = rows.groupingSets([["sentiment"], ["platform"], ["day"], ["intensity"]], "sentiment", "platform", "day", "intensity")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), mean4("sentiment_score").alias("avg_score"))
    kind = F.when(F.col("g") == 7, "sentiment").when(F.col("g") == 11, "platform").when(F.col("g") == 13, "day").otherwise("intensity")
    key = F.when(F.col("g") == 7, F.col("sentiment")).when(F.col("g") == 11, F.col("platform")).when(F.col("g") == 13, F.col("day")).otherwise(F.col("intensity").cast("string"))
    return out.select(kind.alias("kind"), key.alias("key"), "n", "avg_score")


def date_trend(items: DataFrame) -> DataFrame:
    """Count, mean score and negatives of each day."""
    neg = F.count_if(F.col("sentiment") == "negative")
    return stat(items).groupBy(day_text().alias("day")).agg(F.count("*").alias("n"), mean4("sentiment_score").alias("avg_score"), neg.alias("negative"))


def weekly_trend(trend: DataFrame, span: int = C.WEEKLY_SPAN) -> DataFrame:
    """Weeks from Monday where the days of a trend span more than span days, else the days.

    A week is labelled by its first present day; its mean score is weighted by count.
    """
    days = trend.select(F.col("day").try_cast("date").alias("d"), "n", "avg_score", "negative").where("d is not null")
    long = F.datediff(F.max("d").over(W.partitionBy()), F.min("d").over(W.partitionBy())) > span
    rows = days.withColumn("k", F.when(long, F.trunc("d", "week")).otherwise(F.col("d")))
    total = F.sum(F.col("n") * F.col("avg_score")) / F.sum("n")
    return rows.groupBy("k").agg(F.min("d").cast("string").alias("day"), F.sum("n").alias("n"), F.round(total + F.lit(1e-9), 4).alias("avg_score"), F.sum("negative").alias("negative")).drop("k")


def intensity_histogram(items: DataFrame) -> DataFrame:
    """Items of each intensity from 1 to 5."""
    n = stat(items).groupBy("intensity").agg(F.count("*").alias("n"))
    return spine(items, "intensity", range(1, 6)).join(n, "intensity", "left").select("intensity", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_stats(items: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts, comments, coded items and sentiment of each search keyword; a blank keyword is unsorted.

    One union and one aggregation instead of a join of three aggregates.
    """
    key = lambda df: df.withColumn("keyword", F.coalesce(F.nullif(F.trim("keyword"), F.lit("")), F.lit(C.UNSORTED)))
    zero = F.lit(0)
    cols = ("posts", "comments", "coded", "stat", *C.SENTIMENTS)
    pick = lambda df, **v: key(df).select("keyword", *[v.get(c, zero).cast("long").alias(c) for c in cols])
    is_stat = not_ad()
    one = F.lit(1)
    part = {s: F.when(is_stat & (F.col("sentiment") == s), 1).otherwise(0) for s in C.SENTIMENTS}
    by_post = comments.select("post_id").join(posts.groupBy(F.col("id").alias("post_id")).agg(F.min("keyword").alias("keyword")), "post_id", "left").select("keyword")
    rows = pick(items, coded=one, stat=F.when(is_stat, 1).otherwise(0), **part).unionByName(pick(posts.select("keyword"), posts=one)).unionByName(pick(by_post, comments=one))
    out = rows.groupBy("keyword").agg(*[F.sum(c).alias(c) for c in cols])
    base = F.when(F.col("stat") > 0, F.col("stat")).otherwise(F.col("coded"))
    return out.withColumn("negative_rate", ratio(F.col("negative"), base))


def first_seen(df: DataFrame, keys: list[str], seq: str = "item_seq") -> DataFrame:
    """Counts of keys with the first row that holds each, for ties in order of first appearance."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(seq).alias("seq"))


def top_keywords(items: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent sentiment words; repeats in an item count, ties go to the first seen, then by name."""
    words = stat(items).select("item_seq", F.posexplode("keywords").alias("pos", "word")).where("word is not null")
    got = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("item_seq", "pos")).alias("first"))
    return got.orderBy(F.desc("n"), "first", "word").limit(k).select("word", "n")


def word_polarity_weight(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sum of absolute scores of the lexicon's words in items, by polarity. lexicon: (word, score), each word once."""
    words = stat(items).select("sentiment_score", F.explode("keywords").alias("word"))
    got = words.join(lexicon, "word").groupBy("word", F.when(F.col("score") > 0, "positive").otherwise("negative").alias("polarity"))
    return got.agg(F.round(F.sum(F.abs("sentiment_score")), 4).alias("weight"), F.count("*").alias("n"))


def worst_dimension(grid: DataFrame, least: int = C.N_RATED) -> DataFrame:
    """The aspect with the highest negative rate among those seen often enough; ties by name."""
    return grid.where(F.col("n") >= least).orderBy(F.desc("negative_rate"), "dim").limit(1)


def worst_per_platform(grid: DataFrame, least: int = C.N_RATED) -> DataFrame:
    """The worst aspect of each platform."""
    w = W.partitionBy("platform").orderBy(F.desc("negative_rate"), "dim")
    return grid.where(F.col("n") >= least).withColumn("k", F.row_number().over(w)).where("k = 1").select("platform", "dim", "n", "negative", "negative_rate")


def worst_days(grid: DataFrame, k: int = 3) -> DataFrame:
    """The k worst pairs of day and aspect."""
    return grid.where(F.col("day") != C.UNKNOWN_DATE).orderBy(F.desc("negative"), F.desc("negative_rate"), "day", "dim").limit(k).select("day", "dim", "n", "negative")


def radar(grid: DataFrame, least: int = C.N_RATED) -> DataFrame:
    """Best and worst aspect by mean score among those seen often enough."""
    rows = grid.where(F.col("n") >= least)
    return rows.agg(F.max_by("dim", F.struct("avg_score", "dim")).alias("best"), F.min_by("dim", F.struct("avg_score", "dim")).alias("worst"))


def overall_label(items: DataFrame, band: float = C.LABEL_BAND) -> DataFrame:
    """Mean score of all items and the label it stands for."""
    avg = F.coalesce(F.avg("sentiment_score"), F.lit(0.0))
    label = F.when(avg > band, "positive").when(avg < -band, "negative").otherwise("neutral")
    return stat(items).agg(F.count("*").alias("n"), F.round(avg + F.lit(1e-9), 4).alias("avg_score"), label.alias("label"))


def ads_block(items: DataFrame) -> DataFrame:
    """Advertisements and their share of all items."""
    ads = F.count_if(~not_ad())
    return items.agg(ads.alias("ads"), F.count("*").alias("total"), ratio(ads, F.count("*")).alias("ratio"))


def corrected_count(items: DataFrame) -> DataFrame:
    """Items whose label a model changed from the lexicon's."""
    changed = (F.col("method") == "llm") & (F.col("lexicon_sentiment") != "") & (F.col("lexicon_sentiment") != F.col("sentiment"))
    return stat(items).agg(F.count_if(F.col("method") == "llm").alias("model"), F.count_if(changed).alias("corrected"))


def quality_gate(items: DataFrame, by: str = "platform") -> DataFrame:
    """How far the number of usable items carries, by band."""
    n = F.count_if(not_ad())
    band = F.when(n == 0, "none").when(n < 10, "too few").when(n < 30, "indicative").when(n < 45, "small").when(n < 100, "usable").otherwise("ample")
    return items.groupBy(by).agg(n.alias("n"), band.alias("band"))


def narrative_cube(items: DataFrame, reference: int = C.NARRATIVE_REFERENCE) -> DataFrame:
    """Counts and negatives by actor, by frame, and by both, of items that a model coded; the unclear actor comes last.

    few marks cells under the reference number.
    """
    rows = stat(items).where((F.col("method") == "llm") & (F.col("narrative").isNotNull() | F.col("attribution").isNotNull()))
    rows = rows.select(F.coalesce("attribution", F.lit("不明确")).alias("actor"), F.coalesce("narrative", F.lit("none")).alias("frame"), "sentiment")
    out = rows.groupingSets([["actor"], ["frame"], ["actor", "frame"]], "actor", "frame").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("negative")
    )
    kind = F.when(F.col("g") == 1, "actor").when(F.col("g") == 2, "frame").otherwise("both")
    return out.select(kind.alias("kind"), "actor", "frame", "n", "negative", ratio(F.col("negative"), F.col("n")).alias("negative_rate"),
                      (F.col("n") < reference).alias("few"), F.when(F.col("actor") == "不明确", 1).otherwise(0).alias("last"))


def narrative_hotspots(cube: DataFrame, least: int = 10, rate: float = 0.6) -> DataFrame:
    """Cells of actor and frame that are frequent and mostly negative."""
    return cube.where((F.col("kind") == "both") & (F.col("n") >= least) & (F.col("negative_rate") >= rate)).select("actor", "frame", "n", "negative_rate")


def consumer_voice(posts: DataFrame, comments: DataFrame, items: DataFrame, target: int = 20, least_share: float = 0.1) -> DataFrame:
    """Collected N, usable E and their share per platform, with the tier of what can be said.

    ample: E reaches VOICE_ENOUGH of the target and both polarities their least; some: VOICE_SOME and one polarity.
    """
    n = posts.select("platform").unionByName(comments.select("post_id").join(posts.groupBy(F.col("id").alias("post_id")).agg(F.min("platform").alias("platform")), "post_id").select("platform"))
    n = n.groupBy("platform").agg(F.count("*").alias("collected"))
    e = stat(items).groupBy("platform").agg(F.count("*").alias("usable"), F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative"))
    out = n.join(e, "platform", "left").na.fill(0)
    low = F.greatest(F.lit(1), F.bround(F.lit(target * least_share)).cast("long"))
    both, one = (F.col("positive") >= low) & (F.col("negative") >= low), (F.col("positive") >= low) | (F.col("negative") >= low)
    tier = F.when((F.col("usable") >= C.VOICE_ENOUGH * target) & both, "ample").when((F.col("usable") >= C.VOICE_SOME * target) & one, "some").otherwise("little")
    return out.withColumn("share", ratio(F.col("usable"), F.col("collected"))).withColumn("tier", tier)


def trend_direction(trend: DataFrame, band: float = C.TREND_BAND) -> DataFrame:
    """Mean of the daily means of the first and the second half of the days, the way they go, and the days of most items and of most negative ones."""
    days = trend.where(F.col("day") != C.UNKNOWN_DATE)
    w = W.orderBy("day")
    rows = days.select("day", "n", "avg_score", "negative", F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy()).alias("m"))
    first = F.col("k") <= F.floor(F.col("m") / 2)
    a, b = F.round(F.avg(F.when(first, F.col("avg_score"))) + F.lit(1e-9), 3), F.round(F.avg(F.when(~first, F.col("avg_score"))) + F.lit(1e-9), 3)
    way = F.when(F.col("late") - F.col("early") > band, "up").when(F.col("early") - F.col("late") > band, "down").otherwise("flat")
    peak = F.min_by("day", F.struct(-F.col("n"), "day"))
    worst = F.min_by("day", F.struct(-F.col("negative"), "day"))
    return rows.agg(a.alias("early"), b.alias("late"), peak.alias("peak_day"), worst.alias("worst_day")).withColumn("direction", way)


def stages(posts: DataFrame, comments: DataFrame, items: DataFrame) -> DataFrame:
    """Rows left at each stage: collected posts, distinct posts, comments, coded items, usable items."""
    one = lambda df, name, o, e: df.agg(e.alias("n")).select(F.lit(o).alias("ord"), F.lit(name).alias("stage"), "n")
    parts = [one(posts, "collected", 1, F.count("*")), one(posts, "kept", 2, F.count_distinct("id")), one(comments, "comments", 3, F.count("*")), one(items, "coded", 4, F.count("*")), one(stat(items), "usable", 5, F.count("*"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
