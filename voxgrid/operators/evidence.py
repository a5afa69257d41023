"""Evidence cards, statistic cards and findings from coded items and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions.text import evidence_text
from voxgrid.operators.summary import day_text, ratio, stat


def card_order(strict: bool = True) -> list[Column]:
    """The order of cards: sentiment, then score, intensity, date and id.

    strict keeps the rule of descending score, which puts the mildest negative first; otherwise the
    strongest comes first. Blank dates come last unless strict.
    """
    rank = F.when(F.col("sentiment") == "negative", 0).when(F.col("sentiment") == "positive", 1).otherwise(2)
    score = F.desc("sentiment_score") if strict else F.desc(F.abs("sentiment_score"))
    return [rank, score, F.desc("intensity"), F.col("day"), F.col("text_id"), F.col("item_seq")]


def dimension_cards(items: DataFrame, k: int = 3, strict: bool = True) -> DataFrame:
    """At most k cards per aspect and polarity, each with the size of its group."""
    rows = stat(items).where("text is not null and text <> ''").select("item_seq", "text_id", "platform", day_text().alias("day"), "sentiment", "sentiment_score", "intensity", "text", F.explode("dimension_sentiments").alias("dim", "polarity"))
    group = W.partitionBy("dim", "polarity")
    rows = rows.withColumn("k", F.row_number().over(group.orderBy(*card_order(strict))))
    size = rows.groupBy("dim", "polarity").agg(F.count("*").alias("n"))
    top = rows.where(F.col("k") <= k)
    return top.join(size, ["dim", "polarity"]).select("dim", "polarity", "k", "n", "item_seq", "text_id", evidence_text(F.col("text")).alias("quote"))


def negative_cards(items: DataFrame, used: DataFrame, k: int = 5, strict: bool = True) -> DataFrame:
    """The first k negative items that no other card shows."""
    rows = stat(items).where("sentiment = 'negative' and text is not null and text <> ''").join(used.select("item_seq").distinct(), "item_seq", "left_anti")
    return rows.withColumn("day", day_text()).orderBy(*card_order(strict)).limit(k).select("item_seq", "text_id", "sentiment_score", evidence_text(F.col("text")).alias("quote"))


def topic_cards(items: DataFrame, words: list[str], k: int = 3) -> list[dict]:
    """One unused negative text for each source word in turn, k at most. The candidates per word are limited to k before they reach the driver."""
    if not words:
        return []
    rows = stat(items).where("sentiment = 'negative'").select("item_seq", "text_id", "text", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])).alias("x")).where(F.contains("text", "x.w"))
    near = rows.withColumn("k", F.row_number().over(W.partitionBy("x.i").orderBy("item_seq"))).where(F.col("k") <= k).orderBy("x.i", "item_seq").select("x.w", "item_seq", "text_id").collect()
    used, out, done = set(), [], set()
    for r in near:
        if len(out) < k and r.item_seq not in used and r.w not in done:
            used.add(r.item_seq)
            done.add(r.w)
            out.append({"word": r.w, "item_seq": r.item_seq, "text_id": r.text_id})
    return out


def numbered(cards: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """Cards with ids E1, E2, .. by an order over all of them; cards are few."""
    return cards.withColumn("card", F.concat(F.lit(prefix), F.row_number().over(W.orderBy(*order))))


def stat_cards(items: DataFrame) -> DataFrame:
    """Statistic cards as rows of (kind, key, n, value): overall negative share, and that of each platform and aspect."""
    s = stat(items)
    neg = F.count_if(F.col("sentiment") == "negative")
    a = s.agg(F.count("*").alias("n"), ratio(neg, F.count("*")).alias("value")).select(F.lit("overall").alias("kind"), F.lit("").alias("key"), "n", "value")
    b = s.groupBy("platform").agg(F.count("*").alias("n"), ratio(neg, F.count("*")).alias("value")).select(F.lit("platform").alias("kind"), F.col("platform").alias("key"), "n", "value")
    d = s.select(F.explode("dimension_sentiments").alias("key", "v")).groupBy("key").agg(F.count("*").alias("n"), ratio(F.count_if(F.col("v") == "negative"), F.count("*")).alias("value"))
    return a.unionByName(b).unionByName(d.select(F.lit("dimension").alias("kind"), "key", "n", "value"))


def findings(items: DataFrame, k: int = 4) -> DataFrame:
    """The aspects worth a finding: at least N_RATED mentions, those with N_NORMAL first, by negatives, then name."""
    neg = F.count_if(F.col("v") == "negative")
    d = stat(items).select(F.explode("dimension_sentiments").alias("dim", "v")).groupBy("dim").agg(F.count("*").alias("n"), neg.alias("negative"), ratio(neg, F.count("*")).alias("rate"))
    rows = d.where(F.col("n") >= C.N_RATED).withColumn("confident", F.col("n") >= C.N_NORMAL)
    return rows.orderBy(F.desc("confident"), F.desc(F.round(F.col("n") * F.col("rate"), 4)), "dim").limit(k)


def top_issues(items: DataFrame, k: int = 3) -> DataFrame:
    """The aspects with the highest negative rate among those seen often enough."""
    return findings(items, 10_000).orderBy(F.desc("rate"), "dim").limit(k).select("dim", "n", "rate")


def supported(found: DataFrame, cards: DataFrame, least_action: int = 12) -> DataFrame:
    """Findings (id, refs, action) all of whose references exist and whose action is long enough. cards: (card), a small list."""
    refs = found.select("id", F.explode(F.array_distinct("refs")).alias("card"))
    missing = refs.join(cards.select("card"), "card", "left_anti").select("id").distinct()
    return found.where((F.size("refs") > 0) & (F.length("action") >= least_action)).join(missing, "id", "left_anti")


def source_urls(items: DataFrame, posts: DataFrame) -> DataFrame:
    """item_seq with the address of its post: by exact text, then by text without white space (the last post wins), else by the post's id."""
    squeezed = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    p = posts.where("url is not null and url <> ''")
    exact = p.where("content is not null and content <> ''").groupBy(F.xxhash64("content").alias("h")).agg(F.max_by("url", "post_seq").alias("u1"))
    loose = p.where("content is not null and content <> ''").groupBy(F.xxhash64(squeezed(F.col("content"))).alias("h")).agg(F.max_by("url", "post_seq").alias("u2"))
    by_id = p.groupBy("id").agg(F.min_by("url", "post_seq").alias("u3"))
    rows = items.select("item_seq", F.xxhash64("text").alias("h1"), F.xxhash64(squeezed(F.col("text"))).alias("h2"), F.split("text_id", ":")[0].alias("id"), F.col("text").isNull().alias("none"))
    rows = rows.join(exact, F.col("h1") == exact["h"], "left").drop("h").join(loose, F.col("h2") == loose["h"], "left").drop("h").join(by_id, "id", "left")
    return rows.select("item_seq", F.coalesce(F.when(~F.col("none"), F.col("u1")), F.when(~F.col("none"), F.col("u2")), "u3").alias("url"))
