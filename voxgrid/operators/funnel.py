"""The keyword funnel across runs: what each query of a channel collected, kept, dropped and coded.

Input frames: kept(run_id, run_seq, channel, keyword, query, url), dropped(+reason, kind), coded(run_id,
channel, keyword, sentiment, ad_flag). Counts of coded items belong to a keyword and repeat on each of
its queries; they are never added up across queries. Empty frames give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.operators.summary import ratio


def backfill_query(drops: DataFrame, kept: DataFrame) -> DataFrame:
    """A drop without a query takes the only query of its channel and keyword, else the keyword."""
    only = kept.groupBy("channel", "keyword").agg(F.count_distinct("query").alias("k"), F.min("query").alias("only")).where("k = 1").drop("k")
    return drops.join(only, ["channel", "keyword"], "left").withColumn("query", F.coalesce(F.nullif("query", F.lit("")), "only", "keyword")).drop("only")


def extract(kept: DataFrame, dropped: DataFrame, coded: DataFrame) -> DataFrame:
    """Per channel, keyword and query: collected, kept, dropped, quality drops, reasons, coded, negatives, ads and rates."""
    key = ["channel", "keyword", "query"]
    drops = backfill_query(dropped, kept)
    rows = kept.select(*key, F.lit(1).alias("k"), F.lit(0).alias("d"), F.lit(0).alias("q")).unionByName(drops.select(*key, F.lit(0).alias("k"), F.lit(1).alias("d"), (F.col("kind") == "quality").cast("int").alias("q")))
    counts = rows.groupBy(*key).agg(F.sum("k").alias("kept"), F.sum("d").alias("dropped"), F.sum("q").alias("quality_dropped"))
    why = drops.groupBy(*key, "reason").agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    ad = F.coalesce("ad_flag", F.lit(False))
    said = coded.groupBy("channel", "keyword").agg(F.count("*").alias("coded"), F.count_if(F.col("sentiment") == "negative").alias("negative"), F.count_if(ad).alias("ads"))
    out = counts.join(why, key, "left").join(said, ["channel", "keyword"], "left").na.fill(0, ["coded", "negative", "ads"])
    return with_rates(out.withColumn("collected", F.col("kept") + F.col("dropped")))


def with_rates(df: DataFrame) -> DataFrame:
    """effective: kept of collected; quality: kept of kept and quality drops; negative: negatives of coded."""
    return df.withColumns({
        "effective_rate": ratio(F.col("kept"), F.col("kept") + F.col("dropped")),
        "quality_rate": ratio(F.col("kept"), F.col("kept") + F.col("quality_dropped")),
        "negative_rate": ratio(F.col("negative"), F.col("coded")) if "negative" in df.columns else F.lit(0.0),
    })


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Funnel rows of all runs per channel and query: sums, the keyword of the last run, reasons added up."""
    key = ["channel", "query"]
    sums = runs.groupBy(*key).agg(F.max_by("keyword", "run_seq").alias("keyword"), *[F.sum(c).alias(c) for c in ("collected", "kept", "dropped", "quality_dropped")], F.count_distinct("run_id").alias("runs"))
    why = runs.select(*key, F.explode("reasons").alias("reason", "n")).groupBy(*key, "reason").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return sums.join(why, key, "left")


def unique_urls(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Every address once per channel and query across runs: kept in any run beats dropped, the first drop's reason stays.

    Drops without an address are left out; kept ones without an address count once.
    """
    key = ["channel", "query", "url"]
    a = kept.select("channel", "query", F.coalesce("url", F.lit("")).alias("url"), F.lit(1).alias("kept"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("ord"))
    b = dropped.where(F.coalesce("url", F.lit("")) != "").select(*key, F.lit(0).alias("kept"), "reason", "kind", F.col("ord").cast("long"))
    one = a.unionByName(b).groupBy(*key).agg(F.max("kept").alias("kept"), F.min_by(F.struct("reason", "kind"), F.col("ord")).alias("first"))
    lost = F.col("kept") == 0
    out = one.groupBy("channel", "query").agg(F.count("*").alias("collected"), F.sum("kept").cast("long").alias("kept"), F.count_if(lost).alias("dropped"), F.count_if(lost & (F.col("first.kind") == "quality")).alias("quality_dropped"))
    return out.withColumn("effective_rate", ratio(F.col("kept"), F.col("collected"))).withColumn("quality_rate", ratio(F.col("kept"), F.col("kept") + F.col("quality_dropped")))


def total_rates(runs: DataFrame) -> DataFrame:
    """Rates per run; the quality rate falls back to the plain one where no run row has quality figures."""
    k, d, q = F.sum("kept"), F.sum("dropped"), F.sum("quality_dropped")
    any_q = F.max(F.when(F.col("quality_dropped").isNotNull(), 1).otherwise(0)) == 1
    return runs.groupBy("run_id").agg(k.alias("kept"), d.alias("dropped"), ratio(k, k + d).alias("rate"), F.when(any_q, ratio(k, k + q)).otherwise(ratio(k, k + d)).alias("quality_rate"))


def verdict(delta_pp: Column) -> Column:
    return F.when(delta_pp.isNull(), "first run").when(delta_pp >= 5, "reached").when(delta_pp > 0, "better").when(delta_pp == 0, "flat").otherwise("worse")


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run's rate against the run before it: difference in percentage points and verdict."""
    rates = total_rates(runs).join(runs.groupBy("run_id").agg(F.max("run_seq").alias("run_seq")), "run_id")
    w = W.orderBy("run_seq", "run_id")
    delta = F.round((F.col("rate") - F.lag("rate").over(w)) * 100, 1)
    return rates.withColumn("delta_pp", delta).withColumn("verdict", verdict(F.col("delta_pp")))


def low_efficiency(rows: DataFrame) -> DataFrame:
    """Queries that keep too little: strong with many collected, weak with some."""
    n, r = F.col("collected"), F.col("effective_rate")
    level = F.when((n >= C.STRONG_N) & (r < C.STRONG_RATE), "strong").when((n >= C.WEAK_N) & (r < C.WEAK_RATE), "weak")
    return rows.withColumn("level", level).where("level is not null").select("channel", "query", "collected", "effective_rate", "level")


def candidates(rows: DataFrame) -> DataFrame:
    """Queries worth preferring (many kept) or avoiding (few kept), by channel, query and keyword."""
    n, r = F.col("collected"), F.col("effective_rate")
    move = F.when((r >= 0.7) & (n >= C.STRONG_N), "prefer").when((F.col("channel") == "xiaohongshu") & (r < C.WEAK_RATE) & (n >= C.WEAK_N), "avoid")
    return rows.withColumn("move", move).where("move is not null").select("channel", "query", "keyword", "collected", "effective_rate", "move")


def new_queries(now: DataFrame, before: DataFrame) -> DataFrame:
    """Queries of a channel that weren't asked before."""
    return now.select("channel", "query").distinct().join(before.select("channel", "query").distinct(), ["channel", "query"], "left_anti")


def suffix_stats(rows: DataFrame, suffix: Column) -> DataFrame:
    """Collected and kept by what the queries of web search add to their keywords."""
    web = rows.where(F.col("channel").startswith("websearch")).withColumn("suffix", suffix)
    return web.groupBy("suffix").agg(F.sum("collected").alias("collected"), F.sum("kept").alias("kept")).withColumn("rate", ratio(F.col("kept"), F.col("collected")))


def subject_hints(docs: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """Tokens of texts that hold their subject, beside it: the k most frequent per subject. docs: (subject, text, tokens)."""
    rows = docs.where(F.contains("text", "subject")).select("subject", F.explode(F.array_distinct("tokens")).alias("word"))
    rows = rows.where(~F.contains("subject", "word") & ~F.contains("word", "subject"))
    n = rows.groupBy("subject", "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("k", F.row_number().over(W.partitionBy("subject").orderBy(F.desc("n"), "word"))).where(F.col("k") <= k).drop("k")


def alias_hints(docs: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """Short forms of a subject (its first or last two characters) in texts without the full name. docs: (subject, text)."""
    rows = docs.where((F.length("subject") >= 3) & ~F.contains("text", "subject"))
    forms = F.array_distinct(F.array(F.expr("left(subject, 2)"), F.expr("right(subject, 2)")))
    rows = rows.select("subject", F.explode(F.filter(forms, lambda f: F.contains(F.col("text"), f))).alias("alias"))
    n = rows.groupBy("subject", "alias").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("k", F.row_number().over(W.partitionBy("subject").orderBy(F.desc("n"), "alias"))).where(F.col("k") <= k).drop("k")


def expand_queries(keywords: DataFrame, strategy: dict[str, list[str]], most: int = 5) -> DataFrame:
    """The queries of a keyword: itself, then the additions of the first strategy entry that is the keyword or its first word."""
    out = F.lit(None).cast("array<string>")
    for name, words in reversed(list(strategy.items())):
        hit = (F.col("keyword") == name) | F.col("keyword").startswith(name + " ")
        out = F.when(hit, F.array(*[F.lit(w) for w in words])).otherwise(out)
    added = F.slice(F.array_distinct(F.transform(F.coalesce(out, F.array().cast("array<string>")), lambda w: F.concat("keyword", F.lit(" "), w))), 1, most)
    return keywords.select("keyword", F.posexplode(F.concat(F.array("keyword"), added)).alias("ord", "query"))


def gap_notes(requested: DataFrame, kept: DataFrame) -> DataFrame:
    """Requested against kept per channel and keyword, with what is missing. requested: (channel, keyword, wanted)."""
    n = kept.groupBy("channel", "keyword").agg(F.count("*").alias("kept"))
    out = requested.join(n, ["channel", "keyword"], "left").na.fill(0, ["kept"])
    return out.withColumn("missing", F.greatest(F.col("wanted") - F.col("kept"), F.lit(0))).withColumn("note", F.when(F.col("kept") == 0, "nothing kept").when(F.col("missing") > 0, "fewer than asked").otherwise("met"))
