"""Which rows count, unions of keys and counts, and what remains of answers that don't keep to their contract.

Nulls: a null channel, keyword or url belongs to no scope and no kept set; a null array or map is an empty one. Repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.operators.summary import ratio

#: Answers that mean a gold label was revised by the model.
REVISED = ("是", "yes", "true", "1")


def channel_rows(df: DataFrame, channel: str | None, column: str = "channel_id") -> DataFrame:
    """The rows of a channel; without one, those of every kind of web search."""
    return df.where(F.col(column) == channel if channel is not None else F.startswith(F.col(column), F.lit("websearch")))


def gold_rows(df: DataFrame, revised: bool = False) -> DataFrame:
    """The labelled rows (relevant, gold_revised_by_model) that are scored: relevant ones, and without revised those no model has revised."""
    said = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    out = df.where(said("relevant") == "yes")
    return out if revised else out.where(~said("gold_revised_by_model").isin(*REVISED))


def kept_rows(rows: DataFrame, kept: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose address is among those of the kept."""
    return rows.join(kept.select(url).where(F.col(url).isNotNull()).distinct(), url, "left_semi")


def worst_words(docs: DataFrame, dim: str | None, k: int = 30) -> DataFrame:
    """The k most frequent tokens, repeats included, of documents that are negative on an aspect. docs: (tokens, dimension_sentiments)."""
    rows = docs.where(F.try_element_at("dimension_sentiments", F.lit(dim)) == "negative") if dim is not None else docs.where(F.lit(False))
    return rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def report_rows(funnel: DataFrame, by: str) -> DataFrame:
    """Sums and rates of funnel rows by keyword or by query."""
    got = funnel.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("collected", "kept", "dropped", "quality_dropped")])
    return got.withColumn("effective_rate", ratio(F.col("kept"), F.col("collected"))).withColumn("quality_rate", ratio(F.col("kept"), F.col("kept") + F.col("quality_dropped")))


def hot_rows(df: DataFrame, group: str, likes: str, id: str, k: int = 5) -> DataFrame:
    """The k rows of each group with most likes, missing ones as none, ties by id."""
    w = W.partitionBy(group).orderBy(F.desc(F.coalesce(F.col(likes), F.lit(0))), id)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def key_union(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of either table."""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def max_union(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The union of two multisets (key, n): each key as often as in the one that has it more."""
    return a.select(key, n).unionByName(b.select(key, n)).groupBy(key).agg(F.max(n).alias(n))


def appended(old: Column, new: Column, most: int) -> Column:
    """Old values, then new ones that aren't there yet, in order, the first `most` of them."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)), 1, most)


def item_dimensions(lexicon: Column, answered: Column) -> Column:
    """The aspects that the lexicon or the answer names, sorted."""
    named = F.coalesce(F.map_keys(answered), F.array().cast("array<string>"))
    return F.array_sort(F.filter(F.array_union(F.coalesce(lexicon, F.array().cast("array<string>")), named), lambda x: x.isNotNull()))


def aspects_kept(answered: Column, known: list[str]) -> Column:
    """What an answer says about known aspects, positive or negative, in lower case without outer blanks; nothing else."""
    plain = F.transform_values(F.coalesce(answered, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(v)))
    return F.map_filter(plain, lambda k, v: k.isin(*known) & v.isin("positive", "negative") if known else F.lit(False))


def narrative_kept(value: Column, actor: bool = False) -> Column:
    """A frame of the narrative (or an actor) if it is one that the contract knows, else null."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(*(C.ACTORS if actor else C.FRAMES)), plain)


def logs_kept(logs: DataFrame, gone: DataFrame, key: str = "task_id") -> DataFrame:
    """The logs whose task wasn't deleted; logs without a task stay."""
    return logs.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def relevance_applied(rows: DataFrame, flags: DataFrame, key: str, review: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows kept and dropped by flags (key, relevant). Rows without a flag are kept; in review mode all are, with the flag beside them."""
    flag = flags.groupBy(key).agg(F.bool_and("relevant").alias("__flag"))
    joined = rows.join(flag, key, "left").withColumn("__flag", F.coalesce("__flag", F.lit(True)))
    if review:
        return joined.withColumnRenamed("__flag", "relevant"), joined.where(F.lit(False)).drop("__flag")
    return joined.where("__flag").drop("__flag"), joined.where("not __flag").drop("__flag")


def display_names(rows: DataFrame, key: str, custom: DataFrame, shipped: DataFrame) -> DataFrame:
    """rows with the name of their id: the custom one, else the shipped one, else the id. Both tables are (id, name)."""
    one = lambda df, name: df.groupBy(F.col("id").alias(key)).agg(F.min("name").alias(name))
    out = rows.join(one(custom, "__c"), key, "left").join(one(shipped, "__s"), key, "left")
    return out.withColumn("name", F.coalesce("__c", "__s", key)).drop("__c", "__s")
