"""Evaluation of labels: accuracy, precision and recall, confusion, calibration, agreement, run comparison.

Pairs are rows of (gold, pred, ...). Empty input gives no rows, or zeros where a row per known value is
promised. Joins of gold and predictions go by id and ordinal, since ids alone may repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions import stats as S
from voxgrid.operators.summary import ratio, spine

BINS = ((0.0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0001))


def aligned(gold: DataFrame, pred: DataFrame, key: str, order: str) -> DataFrame:
    """Gold and predictions matched by key and by the ordinal among equal keys."""
    nth = lambda df: df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return nth(gold).join(nth(pred).drop(order), [key, "__n"]).drop("__n")


def accuracy(pairs: DataFrame, *groups: str) -> DataFrame:
    """n, accuracy and interval overall and by each group column on its own, by grouping sets: (grp, segment, ...)."""
    hit = F.avg((F.col("gold") == F.col("pred")).cast("double"))
    rows = pairs.select("gold", "pred", *[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in groups])
    sets = rows.groupingSets([[], *[[g] for g in groups]], *groups) if groups else rows.groupBy()
    out = sets.agg((F.grouping_id() if groups else F.lit(0)).alias("__g"), F.count("*").alias("__n"), hit.alias("__a"))
    n = len(groups)
    grp, seg = F.lit("all"), F.lit("")
    for i, g in enumerate(groups):
        only = (1 << n) - 1 - (1 << (n - 1 - i))
        grp = F.when(F.col("__g") == only, g).otherwise(grp)
        seg = F.when(F.col("__g") == only, F.col(g)).otherwise(seg)
    lo, hi = S.wilson(F.col("__a"), F.col("__n"))
    return out.select(grp.alias("grp"), seg.alias("segment"), F.col("__n").alias("n"), F.round("__a", 4).alias("accuracy"), F.round(lo, 4).alias("low"), F.round(hi, 4).alias("high"))


def class_prf(pairs: DataFrame, classes: Sequence[str] = C.SENTIMENTS) -> DataFrame:
    """Precision, recall and F1 of each class against the rest."""
    rows = pairs.select("gold", "pred", F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    out = rows.groupBy("label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return prf(out)


def prf(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pred", "gold").agg(F.count("*").alias("n"))


def aspect_prf(pairs: DataFrame, by_dim: bool = True) -> DataFrame:
    """Precision, recall and F1 of aspect maps (gold, pred); a wrong value is a false positive and a false negative.

    mention figures count the aspect alone, whatever its value.
    """
    keys = F.array_union(F.map_keys(F.coalesce("gold", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), F.map_keys(F.coalesce("pred", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    rows = pairs.select("gold", "pred", F.explode(keys).alias("dim")).select("dim", F.try_element_at("gold", "dim").alias("g"), F.try_element_at("pred", "dim").alias("p"))
    same = F.col("g").eqNullSafe(F.col("p"))
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    out = (rows.groupBy("dim") if by_dim else rows.groupBy()).agg(
        F.count_if(same).alias("tp"), F.count_if(p & ~same).alias("fp"), F.count_if(g & ~same).alias("fn"), F.count_if(g & p).alias("mention_tp"), F.count_if(p & ~g).alias("mention_fp"), F.count_if(g & ~p).alias("mention_fn")
    )
    return prf(out).withColumn("mention_f1", ratio(2 * F.col("mention_tp"), 2 * F.col("mention_tp") + F.col("mention_fp") + F.col("mention_fn")))


def exact_match(pairs: DataFrame) -> DataFrame:
    """Share of rows with a gold map whose prediction equals it."""
    entries = lambda c: F.sort_array(F.map_entries(F.coalesce(F.col(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    rows = pairs.where(F.size("gold") > 0)
    return rows.agg(F.count("*").alias("n"), ratio(F.count_if(entries("gold") == entries("pred")), F.count("*")).alias("exact"))


def bin_of(confidence: Column) -> Column:
    """The name of a confidence's bin, missing for null."""
    out = F.lit("missing")
    for lo, hi in BINS:
        out = F.when((confidence >= lo) & (confidence < hi), f"{lo:.1f}-{min(hi, 1.0):.1f}").otherwise(out)
    return out


def calibration(pairs: DataFrame) -> DataFrame:
    """n and accuracy in each bin of confidence and for missing ones; empty bins have 0 and null. pairs: (gold, pred, confidence)."""
    n = pairs.groupBy(bin_of(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 4).alias("accuracy"))
    names = [f"{lo:.1f}-{min(hi, 1.0):.1f}" for lo, hi in BINS]
    return spine(pairs, "bin", [*names, "missing"]).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def flag_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy by each of the comma-separated flags of a row."""
    rows = pairs.select("gold", "pred", F.explode(F.array_distinct(F.filter(F.transform(F.split("flags", "[,、]"), lambda x: F.trim(x)), lambda x: x != ""))).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 4).alias("accuracy"))


def has_flag(flags: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(F.transform(F.split(flags, "[,、]"), lambda x: F.trim(x)), F.array(*[F.lit(w) for w in wanted]))


def routing(items: DataFrame) -> DataFrame:
    """How many items went straight through, to a model, and were corrected there."""
    llm = F.col("method") == "llm"
    fixed = llm & F.col("lexicon_sentiment").isNotNull() & (F.col("lexicon_sentiment") != F.col("sentiment"))
    return items.agg(F.count_if(~llm).alias("direct"), F.count_if(llm).alias("model"), F.count_if(fixed).alias("corrected"), ratio(F.count_if(llm), F.count("*")).alias("model_rate"))


def review_backtest(pairs: DataFrame) -> DataFrame:
    """How well a review flag marks wrong labels. pairs: (gold, pred, flagged)."""
    wrong, f = F.col("gold") != F.col("pred"), F.coalesce("flagged", F.lit(False))
    return pairs.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(f).alias("flagged"), ratio(F.count_if(wrong & f), F.count_if(wrong)).alias("hit_rate"), ratio(F.count_if(~wrong & f), F.count_if(~wrong)).alias("false_alarm"), ratio(F.count_if(f), F.count("*")).alias("flag_rate"))


def kappa(pairs: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa of two annotators (gold, pred), overall or by group; complete chance agreement gives 1 or 0."""
    n = pairs.where("gold is not null and pred is not null").groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    rows = n.select(*by, F.col("gold").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("same"))
    rows = rows.unionByName(n.select(*by, F.col("pred").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("same")))
    side = rows.groupBy(*by, "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("same").alias("same"))
    tot = side.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("same").alias("same"), F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n").cast("double") * F.col("n"))
    k = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return tot.where("n > 0").select(*by, "n", F.round(po, 4).alias("agreement"), F.round(k, 4).alias("kappa"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Agreement of two annotations of (key, sentiment, intensity): n, both missing sides, exact and near intensity, disputes."""
    x = a.select(key, F.col("sentiment").alias("s1"), F.col("intensity").alias("i1"))
    y = b.select(key, F.col("sentiment").alias("s2"), F.col("intensity").alias("i2"))
    rows = x.join(y, key, "full_outer")
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    same = both & (F.col("s1") == F.col("s2"))
    return rows.agg(
        F.count_if(both).alias("n"), F.count_if(F.col("s2").isNull()).alias("missing_second"), F.count_if(F.col("s1").isNull()).alias("missing_first"), ratio(F.count_if(same), F.count_if(both)).alias("sentiment"),
        ratio(F.count_if(both & (F.col("i1") == F.col("i2"))), F.count_if(both)).alias("intensity"), ratio(F.count_if(both & (F.abs(F.col("i1") - F.col("i2")) <= 1)), F.count_if(both)).alias("intensity_near"), F.count_if(both & ~same).alias("disputes"),
    )


def resolved(primary: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """Final labels: a human's beats the primary one; without either the row is disputed. Neutral rows have intensity 1."""
    h = human.groupBy(key).agg(F.max("label").alias("human"))
    out = primary.join(h, key, "left").withColumn("final", F.coalesce(F.nullif("human", F.lit("")), F.nullif("sentiment", F.lit(""))))
    return out.withColumn("disputed", F.col("final").isNull()).withColumn("final_intensity", F.when(F.col("final") == "neutral", 1).otherwise(F.col("intensity")))


def previous_run(runs: DataFrame) -> DataFrame:
    """Every run with the run before it of the same mode and fingerprint, by (ts, run_id): an as-of join backwards."""
    w = W.partitionBy("mode", "fingerprint").orderBy("ts", "run_id")
    return runs.withColumn("previous", F.lag("run_id").over(w)).withColumn("previous_accuracy", F.lag("accuracy").over(w))


def compare_segments(now: DataFrame, before: DataFrame) -> DataFrame:
    """Accuracy of segments now against before: difference in points, its width, and what it means. (grp, segment, n, accuracy)."""
    b = before.select("grp", "segment", F.col("n").alias("n0"), F.col("accuracy").alias("a0"))
    rows = now.join(b, ["grp", "segment"], "left")
    delta = F.round((F.col("accuracy") - F.col("a0")) * 100, 2)
    width = S.delta_width(S.half_width_pp(F.col("accuracy"), F.col("n")), S.half_width_pp(F.col("a0"), F.col("n0")))
    return rows.select("grp", "segment", "n", "accuracy", delta.alias("delta_pp"), width.alias("width_pp"), S.change(delta, width).alias("status"))


def short_boards(segments: DataFrame) -> DataFrame:
    """Segments with enough rows and too low an accuracy."""
    return segments.where((F.col("n") >= C.EVAL_REFERENCE) & (F.col("accuracy") < C.SHORT_BOARD))


def gate(now: float, baseline: float, tolerance: float = 0.01) -> bool:
    """Whether an accuracy holds its baseline."""
    return now >= baseline - tolerance
