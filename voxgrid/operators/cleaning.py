"""Cleaning of posts: rule chain, first-wins de-duplication over several keys, ledger, exclusions.

Every rule works on whole columns; de-duplication runs in rounds of aggregations, so a key that a third
of all rows share never has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions import text as T
from voxgrid.session import staged

#: Order of the keys of a post: a duplicate is named after the first that an earlier kept post holds.
KEY_ORDER = ("id", "url", "title", "body")
SALTS = 16


def rule_reasons(web: Column, title: Column, content: Column, score: Column) -> Column:
    """The reasons, in rule order, for which a post is dropped; empty for none.

    web: whether the post comes from web search. The relevance rule applies where no other does, the
    score isn't positive and the text is no content of its own.
    """
    body, head = T.clean_text(F.coalesce(content, F.lit(""))), T.clean_text(F.coalesce(title, F.lit("")))
    n, m = F.length(T.compact(body)), F.length(T.compact(head))
    web = F.coalesce(web, F.lit(False))
    limit = F.when(web, C.SHORT_WEB).otherwise(C.SHORT_OTHER)
    spared = web & ~T.boilerplate(head) & (n >= C.BOILERPLATE_EXEMPT)
    first = [
        F.when((body == "") & (head == ""), F.lit("empty")),
        F.when((T.boilerplate(body) | T.boilerplate(head)) & ~spared, F.lit("boilerplate")),
        F.when(web & T.official(title), F.lit("official page")),
        F.when((body != "") & (n < limit) & (m < limit), F.lit("too short")),
    ]
    got = F.array_compact(F.array(*first))
    own = (body != "") & (body != head) & (n >= 8)
    return F.when((F.size(got) == 0) & (score <= 0) & ~own, F.array(F.lit("not relevant"))).otherwise(got)


def tags(score: Column, content: Column, title: Column) -> Column:
    """weak where a post without a relevance score has content of its own, low where the score is low, else null."""
    body = T.clean_text(F.coalesce(content, F.lit("")))
    own = (body != "") & (body != T.clean_text(F.coalesce(title, F.lit("")))) & (F.length(T.compact(body)) >= 8)
    return F.when((score <= 0) & own, "weak").when((score > 0) & (score < C.LOW_CONFIDENCE), "low")


def capped(df: DataFrame, flag: str, score: str, seq: str, cap: int = C.LOW_CONFIDENCE_CAP) -> DataFrame:
    """(seq) of the flagged rows that keep their flag: those with the lowest scores, ties by seq."""
    return df.where(flag).orderBy(score, seq).limit(cap).select(seq)


def post_keys(id: str = "id", url: str = "url", title: str = "title", content: str = "content") -> Column:
    """The keys that a post registers: id and url even if blank, title and body prefixes only where they can tell posts apart."""
    t, b = T.strip(F.coalesce(F.col(title), F.lit(""))), T.strip(F.coalesce(F.col(content), F.lit("")))
    key = lambda name, v: F.struct(F.lit(KEY_ORDER.index(name)).alias("o"), v.alias("v"))
    return F.array_compact(F.array(
        key("id", F.coalesce(F.col(id), F.lit(""))),
        key("url", F.coalesce(F.col(url), F.lit(""))),
        F.when(t != "", key("title", F.substring(t, 1, C.KEY_PREFIX))),
        F.when((b != t) & (F.length(b) >= C.BODY_KEY_LEAST), key("body", F.substring(b, 1, C.KEY_PREFIX))),
    ))


def greedy_duplicates(df: DataFrame, seq: str, keys: Column) -> DataFrame:
    """(seq, kept, reason) of every row: rows are taken in order of seq, and one is dropped when a kept one before it holds one of its keys.

    keys: array of struct(o, v). seq is unique. Only kept rows register their keys, so a dropped row
    doesn't block others. A row without a seq has no place in the order: it is kept and registers nothing. Rounds: a row that is the first open one on all its keys is kept, open rows
    that share a key with it are dropped; chains of such decisions are short. A row without keys is kept.
    """
    pairs = df.where(F.col(seq).isNotNull()).select(F.col(seq).alias("s"), F.explode(keys).alias("k")).select("s", F.col("k.o").alias("o"), F.xxhash64("k.o", "k.v").alias("h1"), F.xxhash64(F.lit(3), "k.o", "k.v").alias("h2"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int"))
    on = ["h1", "h2", "salt"]
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    everything = open_ = staged(pairs, "keys")
    kept = None
    while not open_.isEmpty():
        first = open_.groupBy("h1", "h2").agg(F.min("s").alias("first")).withColumn("salt", spread)
        seen = open_.join(first, on).groupBy("s").agg(F.bool_and(F.col("s") == F.col("first")).alias("wins"))
        wins = staged(seen.where("wins").select("s"), "wins")
        held = open_.join(wins, "s").select("h1", "h2").distinct().withColumn("salt", spread)
        gone = open_.join(held, on).select("s").distinct()
        open_ = staged(open_.join(gone, "s", "left_anti"), "open")
        kept = wins if kept is None else kept.unionByName(wins)
    if kept is None:
        return df.select(F.col(seq), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason"))
    owner = everything.join(kept, "s").select("h1", "h2", F.col("s").alias("owner")).withColumn("salt", spread)
    names = F.create_map(*[F.lit(x) for i, k in enumerate(KEY_ORDER) for x in (i, k)])
    why = everything.join(kept, "s", "left_anti").join(owner, on).where("owner < s").groupBy("s").agg(F.min("o").alias("o"))
    return df.join(why, df[seq] == why["s"], "left").select(df[seq], F.col("o").isNull().alias("kept"), F.try_element_at(names, F.col("o")).alias("reason"))


def first_wins(df: DataFrame, seq: str, *keys: Column) -> DataFrame:
    """The first row of each key by seq, by aggregation. Rows with a null key are one group."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(F.col(seq).alias("__s"), F.struct(*df.columns).alias("__r")).alias("__x"))
    return rows.groupBy(*names).agg(F.min_by("__x", "__x.__s").alias("x")).select("x.__r.*")


def clean(posts: DataFrame, score: Column) -> DataFrame:
    """Every post with kept, reasons (array), kind and step of the drop, and tag: rules first, then de-duplication of the rest."""
    web = F.col("platform").startswith("websearch")
    rows = posts.withColumn("score", score).withColumn("why", rule_reasons(web, F.col("title"), F.col("content"), F.col("score"))).withColumn("tag", tags(F.col("score"), F.col("content"), F.col("title")))
    twice = greedy_duplicates(rows.where(F.size("why") == 0), "post_seq", post_keys()).where("not kept").select("post_seq", F.concat(F.lit("duplicate "), "reason").alias("twice"))
    out = rows.join(twice, "post_seq", "left")
    reasons = F.when(F.col("twice").isNotNull(), F.array("twice")).otherwise(F.col("why"))
    out = out.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)
    return out.withColumn("kind", drop_kind(F.try_element_at("reasons", F.lit(1)))).withColumn("step", drop_step(F.try_element_at("reasons", F.lit(1)))).drop("why", "twice")


def drop_kind(reason: Column) -> Column:
    return F.when(reason.startswith("duplicate"), "duplicate").when(reason.isNotNull(), "quality")


def drop_step(reason: Column) -> Column:
    return F.when(reason.startswith("duplicate"), "dedupe").when(reason == "not relevant", "relevance").when(reason.isNotNull(), "rules")


def is_quality_drop(kind: Column, reason: Column) -> Column:
    """By kind where it is known; else by the reason without its wrapper; no reason is none."""
    r = F.regexp_replace(F.coalesce(reason, F.lit("")), r"^(?:auto|manual|review):\s*", "")
    return F.when(kind.isin("collection", "duplicate", "quality"), kind == "quality").otherwise((r != "") & ~r.rlike("^(?:duplicate|collection|out of window|advert)"))


def ledger(cleaned: DataFrame) -> DataFrame:
    """The drop records of a cleaned set: fingerprint, step, kind, reasons as one text."""
    return cleaned.where("not kept").select("platform", "url", "title", "step", T.fingerprint(F.col("title"), F.col("content")).alias("fingerprint"), "keyword", F.array_join("reasons", "；").alias("reason"), "kind")


def balance(cleaned: DataFrame) -> DataFrame:
    """One row: input, kept and dropped, and whether they balance."""
    return cleaned.agg(F.count("*").alias("input"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")).withColumn("ok", F.col("input") == F.col("kept") + F.col("dropped"))


def balanced(cleaned: DataFrame) -> DataFrame:
    """The balance of a cleaned set; ValueError where kept and dropped don't add up to the input."""
    got = balance(cleaned)
    row = got.first()
    if not row.ok:
        raise ValueError(f"{row.input} rows in, {row.kept} kept, {row.dropped} dropped")
    return got


def reason_counts(cleaned: DataFrame) -> DataFrame:
    """How often each reason dropped a post, by kind."""
    return cleaned.where("not kept").select(F.explode("reasons").alias("reason"), "kind").groupBy("reason", "kind").agg(F.count("*").alias("n"))


def in_window(day: Column, lo: Column | None, hi: Column | None) -> Column:
    """Inclusive window; a missing day or border passes."""
    ok = day.isNull()
    a = F.lit(True) if lo is None else (lo.isNull() | (day >= lo))
    b = F.lit(True) if hi is None else (hi.isNull() | (day <= hi))
    return ok | (a & b)


def by_host(df: DataFrame, allowed: list[str], blocked: list[str]) -> DataFrame:
    """Rows whose address holds an allowed domain (any, if none is named) and whose host holds no blocked one."""
    host = F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))
    ok = T.any_of(F.coalesce(F.col("url"), F.lit("")), allowed) if allowed else F.lit(True)
    return df.where(ok & ~T.any_of(host, blocked)) if blocked else df.where(ok)


def split_cards(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason (null for none): kept ones and the ledger's."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def exclude(posts: DataFrame, comments: DataFrame, urls: DataFrame, comment_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without manually excluded posts (by url), their comments, and excluded comments (by id)."""
    left = posts.join(urls, "url", "left_anti")
    gone = posts.join(urls, "url", "left_semi").select(F.col("id").alias("post_id")).distinct()
    return left, comments.join(comment_ids, "id", "left_anti").join(gone, "post_id", "left_anti")


def unseen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key isn't among the seen ones; null keys stay."""
    return df.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def attach_drops(drops: DataFrame, originals: DataFrame) -> DataFrame:
    """(drop_seq, channel_id): a drop belongs to every channel that collected its address, and to the channel of its platform's name.

    The two ways are two equality joins, united; a drop may belong to several channels.
    """
    by_url = drops.join(originals.select("url", "channel_id").distinct(), "url").select("drop_seq", "channel_id")
    by_name = drops.join(originals.select("channel_id").distinct(), drops["platform"] == F.col("channel_id")).select("drop_seq", "channel_id")
    return by_url.unionByName(by_name).distinct()


def flatten_comments(comments: DataFrame, limit: int = 10) -> DataFrame:
    """Of each post its limit most liked comments, each followed by its single most liked reply.

    Repeated deliveries of an id count once (the first); ties go to the earlier. A reply belongs to the
    comment of the author it answers, the most liked of that author's under the post.
    """
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    once = first_wins(comments.withColumn("__id", F.when(blank, F.concat(F.lit("seq:"), F.col("comment_seq"))).otherwise(F.col("id"))), "comment_seq", F.col("__id")).drop("__id")
    rank = W.partitionBy("post_id").orderBy(F.desc(F.coalesce("likes", F.lit(0))), "comment_seq")
    top = once.where(~F.coalesce("is_reply", F.lit(False))).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= limit)
    best = once.where(F.coalesce("is_reply", F.lit(False)) & (F.coalesce("reply_to", F.lit("")) != "")).groupBy("post_id", F.col("reply_to").alias("author")).agg(
        F.max_by(F.struct("comment_seq", "text", "likes"), F.struct(F.coalesce("likes", F.lit(0)), -F.col("comment_seq"))).alias("r")
    )
    mine = top.groupBy("post_id", "author").agg(F.min("place").alias("place"))
    replies = best.join(mine, ["post_id", "author"]).select("post_id", "place", F.lit(1).alias("part"), F.col("r.comment_seq").alias("comment_seq"), F.col("r.likes").alias("likes"))
    return top.select("post_id", "place", F.lit(0).alias("part"), "comment_seq", "likes").unionByName(replies)
