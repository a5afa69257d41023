"""Flags on coded items: routing, review reasons, sampling features, error classes, label overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions.text import any_of


def route_to_model(confidence: Column, always: Column, available: bool = True, custom: bool = False) -> Column:
    """Whether an item goes to a model: one is available, and its domain always does, aspects are custom, or confidence is low."""
    return F.lit(available) & (F.coalesce(always, F.lit(False)) | F.lit(custom) | (F.coalesce(confidence, F.lit(0.0)) < C.ROUTE_UNDER))


def review_reasons(version: int = 3) -> Column:
    """Why an item needs review, as an array; version 1 and 2 by confidence alone, 3 with questions, short texts and changed labels.

    Reads text, confidence, method, sentiment, lexicon_sentiment. The direct prefix comes only before other reasons.
    """
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    if version < 3:
        return F.array_compact(F.array(F.when(conf < (C.REVIEW_V1 if version == 1 else C.REVIEW_V2), F.lit("low confidence"))))
    changed = F.col("lexicon_sentiment").isNotNull() & (F.col("lexicon_sentiment") != "") & (F.col("lexicon_sentiment") != F.col("sentiment"))
    text = F.coalesce(F.col("text"), F.lit(""))
    got = F.array_compact(F.array(
        F.when(conf < C.REVIEW_V2, F.lit("low confidence")), F.when(changed, F.lit("labels differ")),
        F.when(text.rlike(r"[?？]\s*$"), F.lit("question")), F.when((F.length(text) > 0) & (F.length(text) < 6), F.lit("short")),
    ))
    return F.when((F.size(got) > 0) & (F.col("method") != "llm"), F.concat(F.array(F.lit("direct")), got)).otherwise(got)


def shown_confidence(confidence: Column, method: Column) -> Column:
    """A lexicon's confidence is shown at most as DISPLAY_CAP."""
    return F.when(method == "lexicon", F.least(confidence, F.lit(C.DISPLAY_CAP))).otherwise(confidence)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "middle").otherwise("low")


def edge_features() -> Column:
    """The names of the features that make a text hard: long, mixed script, emoji, irony, several aspects."""
    t = F.coalesce(F.col("text"), F.lit(""))
    emoji = F.size(F.regexp_extract_all(t, F.lit(r"([\x{1F000}-\x{1FAFF}])"), F.lit(1)))
    return F.array_compact(F.array(
        F.when(F.length(t) > 100, F.lit("long")), F.when(t.rlike("[A-Za-z]{3,}") & t.rlike(r"\p{IsHan}"), F.lit("mixed")), F.when(emoji >= 2, F.lit("emoji")),
        F.when(any_of(t, C.IRONY), F.lit("irony")), F.when(F.size(F.coalesce("dimensions", F.array().cast("array<string>"))) >= 2, F.lit("aspects")),
    ))


def error_class(message: Column, classes: Sequence[tuple[str, str]] = C.ERROR_CLASSES) -> Column:
    """The first class whose pattern the message matches; a message that begins with [ is never the model's. Blank is unknown."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, pattern in reversed(classes):
        hit = m.rlike(pattern)
        out = F.when(hit & ~m.startswith("["), name).otherwise(out) if name == "llm" else F.when(hit, name).otherwise(out)
    return out


def fix_suggestions(messages: Column) -> Column:
    """The fixes of all classes of a list of messages, in the order of the classes; the default where there are none."""
    got = F.transform(F.coalesce(messages, F.array().cast("array<string>")), lambda m: error_class(m))
    names = F.array(*[F.lit(n) for n, _ in C.ERROR_CLASSES])
    table = F.create_map(*[F.lit(x) for kv in C.FIXES.items() for x in kv])
    found = F.filter(names, lambda n: F.array_contains(got, n))
    return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown"))), lambda n: F.element_at(table, n))


def override(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """Items with the last label that a user gave for their text_id (by id of the feedback); others keep theirs."""
    last = feedback.where("user_sentiment is not null and user_sentiment <> ''").groupBy("text_id").agg(F.max_by("user_sentiment", "id").alias("user"))
    out = items.join(last, "text_id", "left")
    return out.withColumn("label", F.coalesce("user", "sentiment")).withColumn("changed", F.coalesce(F.col("user") != F.col("sentiment"), F.lit(False)))


def reason_label() -> Column:
    """A short label of why an item has its sentiment, for the simple view."""
    return (
        F.when(F.coalesce("ad_flag", F.lit(False)), "advertisement").when(F.coalesce("need_review", F.lit(False)), "needs review")
        .when(F.col("method") == "llm", "by model").when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0, "by words").otherwise("no hits")
    )
