"""The pipelines end to end: analysis of posts, evaluation of labels, the keyword loop, review feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxgrid.functions import lexicon as L
from voxgrid.functions import text as T
from voxgrid.operators import cleaning, evaluation, evidence, review, summary, tokens
from voxgrid.session import staged


class OfflineAnalyzer:
    """Labels texts with the plain lexicon: what a model client falls back to."""

    def analyze(self, texts: Sequence[str]) -> list[str]:
        return [L.scan_text(t)[1] for t in texts]


def analyzed(texts: DataFrame, make: Callable[[], object], batch: int = 10) -> DataFrame:
    """(text, label) of distinct texts by an analyzer that is made once per task and asked in batches.

    A batch that fails is split in halves down to single texts; a text that fails alone keeps a null label.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def ask(xs: list[str]) -> list[str | None]:
            try:
                got = client.analyze(xs)
                if len(got) == len(xs):
                    return list(got)
            except Exception:  # noqa: BLE001, S110 - any failure of a client is handled alike
                pass
            if len(xs) == 1:
                return [None]
            return ask(xs[: len(xs) // 2]) + ask(xs[len(xs) // 2 :])

        for f in frames:
            xs = f["text"].tolist()
            out = [y for i in range(0, len(xs), batch) for y in ask(xs[i : i + batch])]
            yield pd.DataFrame({"text": xs, "label": out})

    return texts.where("text is not null").select("text").distinct().mapInPandas(run, "text string, label string")


def code(texts: DataFrame, dims: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Coded items of (item_seq, text_id, text, ..): sentiment, confidence, keywords, aspects, ad and review flags."""
    s = texts.withColumn("__s", L.scan(F.col("text")))
    out = s.select(
        *texts.columns, F.col("__s.sentiment").alias("sentiment"), F.col("__s.score").alias("sentiment_score"), L.intensity(F.col("__s.score")).alias("intensity"), F.col("__s.confidence").alias("confidence"),
        F.col("__s.keywords").alias("keywords"), F.lit("lexicon").alias("method"), F.lit(None).cast("string").alias("lexicon_sentiment"), L.mentions(F.col("text"), dims).alias("dimensions"), L.aspect_votes(F.col("text"), dims).alias("dimension_sentiments"),
        T.ad_marker(F.lit(""), F.col("text")).isNotNull().alias("ad_flag"),
    )
    return out.withColumn("review", review.review_reasons()).withColumn("need_review", F.size("review") > 0)


def analyse(posts: DataFrame, comments: DataFrame, dims: Sequence[tuple[str, Sequence[str]]]) -> dict[str, DataFrame]:
    """Clean, code and summarise: the frames of a report, by name.

    The cleaned posts and the coded items are staged once; everything else is computed from them.
    """
    cleaned = staged(cleaning.clean(posts, T.relevance_contains(F.concat_ws(" ", "title", "content"), F.array("keyword"))), "cleaned")
    kept = cleaned.where("kept")
    a = kept.select((F.col("post_seq") * 2).alias("item_seq"), F.concat("id", F.lit(":post")).alias("text_id"), F.col("content").alias("text"), "platform", "keyword", F.col("timestamp").alias("pub_date"))
    b = comments.join(kept.select(F.col("id").alias("post_id"), "platform", "keyword"), "post_id").select((F.col("comment_seq") * 2 + 1).alias("item_seq"), F.concat("post_id", F.lit(":comment")).alias("text_id"), "text", "platform", "keyword", F.col("time").alias("pub_date"))
    items = staged(code(a.unionByName(b).where("text is not null and text <> ''"), dims), "items")
    trend = summary.date_trend(items)
    grid = summary.aspect_grid(items)
    docs = items.select(F.col("item_seq").alias("doc"), tokens.segment(F.col("text")).alias("tokens"), "sentiment", F.col("sentiment_score").alias("score"))
    return {
        "cleaned": cleaned, "items": items, "ledger": cleaning.ledger(cleaned), "balance": cleaning.balance(cleaned), "sentiment": summary.sentiment_distribution(items), "platforms": summary.platform_stats(items),
        "aspects": grid, "trend": trend, "direction": summary.trend_direction(trend), "worst": summary.worst_dimension(grid), "words": tokens.word_freq(docs), "sources": tokens.sentiment_sources(docs),
        "pairs": tokens.cooccurrence(docs), "cards": evidence.dimension_cards(items), "findings": evidence.findings(items),
    }


def evaluate(gold: DataFrame, pred: DataFrame, *groups: str) -> dict[str, DataFrame]:
    """Accuracy, class figures, confusion and calibration of predictions against gold (both with text_id, ord)."""
    pairs = evaluation.aligned(gold, pred, "text_id", "ord")
    return {"accuracy": evaluation.accuracy(pairs, *groups), "classes": evaluation.class_prf(pairs), "confusion": evaluation.confusion(pairs), "calibration": evaluation.calibration(pairs)}


def after_review(items: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """The summary again after label overrides."""
    fixed = review.override(items, feedback).withColumn("sentiment", F.col("label"))
    return {"items": fixed, "sentiment": summary.sentiment_distribution(fixed), "platforms": summary.platform_stats(fixed), "findings": evidence.findings(fixed)}
