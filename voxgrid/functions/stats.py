"""Statistics and small arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C


def wilson(p: Column, n: Column, z: float = C.Z) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null where n is 0 or p is null."""
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = (n > 0) & p.isNotNull()
    return F.when(ok, F.greatest(mid - half, F.lit(0.0))), F.when(ok, F.least(mid + half, F.lit(1.0)))


def half_width_pp(p: Column, n: Column) -> Column:
    """The longer side of the interval, in percentage points."""
    lo, hi = wilson(p, n)
    return F.round(F.greatest(p - lo, hi - p) * 100, 2)


def delta_width(a: Column, b: Column) -> Column:
    """The width of a difference of two independent values; null where either is."""
    return F.round(F.hypot(a, b), 2)


def change(delta_pp: Column, width: Column, flat: float = C.FLAT_BAND) -> Column:
    """new, flat, within noise, better or worse."""
    return (
        F.when(delta_pp.isNull(), "new").when(F.abs(delta_pp) < flat, "flat").when(width.isNotNull() & (F.abs(delta_pp) <= width), "within noise")
        .when(delta_pp > 0, "better").otherwise("worse")
    )


def largest_remainder(df: DataFrame, weight: str, total: int, cap: str | None = None) -> DataFrame:
    """df with quota: total places dealt in proportion to weight, the rest to the largest fractions, ties by weight then key order.

    cap: a column that quotas may not exceed. df is a small table of strata with a unique column key.
    """
    whole = W.partitionBy()
    share = F.col(weight) * total / F.sum(weight).over(whole)
    base = F.floor(share).cast("long")
    rows = df.withColumn("__s", share).withColumn("__b", F.least(base, F.col(cap)) if cap else base)
    rows = rows.withColumn("__left", total - F.sum("__b").over(whole))
    open_ = F.col("__b") < F.col(cap) if cap else F.lit(True)
    rank = W.orderBy(F.when(open_, 0).otherwise(1), F.desc(F.round(F.col("__s") - F.floor("__s"), 9)), F.desc(weight), "key")
    return rows.withColumn("quota", F.col("__b") + F.when(open_ & (F.row_number().over(rank) <= F.col("__left")), 1).otherwise(0)).drop("__s", "__b", "__left")


def token_cost(prompt: Column, completion: Column) -> Column:
    """Cost of model tokens by the price of a million in and out."""
    return F.round((prompt * C.PRICE_IN + completion * C.PRICE_OUT) / 1e6, 4)


def cooldown_minutes(level: Column) -> Column:
    return F.least(F.lit(C.COOLDOWN_BASE) * F.pow(F.lit(2), level), F.lit(C.COOLDOWN_MOST)).cast("int")


def span(df: DataFrame, day: str) -> tuple[Column, Column]:
    """The first and the last day of a table, by one aggregation."""
    lo, hi = df.agg(F.min(day), F.max(day)).first()
    return F.lit(lo).cast("date"), F.lit(hi).cast("date")


def time_bucket(day: Column, lo: Column, hi: Column) -> Column:
    """Thirds of the span from lo to hi as 0, 1, 2; 0 where there is no span, unknown where there is no day."""
    days = F.datediff(hi, lo)
    third = F.least(F.lit(2), F.floor(F.datediff(day, lo) * 3 / F.when(days > 0, days))).cast("string")
    return F.when(day.isNull(), "unknown").when(days <= 0, "0").otherwise(third)


def percent(x: Column) -> Column:
    """0.1234 as 12.3%."""
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def rate_symbol(x: Column) -> Column:
    return F.when(x.isNull(), "-").when(x >= 0.6, "▲▲").when(x >= 0.3, "▲").otherwise("●")
