"""Analytics over the control tables of a pipeline: quota ledgers, tasks, durations, retention.

Ledgers are folds in order of time whose sums are clamped and reset daily; a fold is exact for any
number of events per key and day, and days are folded apart from each other, since each starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid import config as C


def quota_fold(events: DataFrame, limit: int) -> DataFrame:
    """Use of a quota per channel and day: consume adds, refund and settle never go below 0, a limit of 0 is none.

    events: (channel, ts, op in consume/refund/settle, est, actual). settle replaces the estimate by the
    actual number. A clamped running sum S' = max(S + d, 0) ends at sum - min(0, least prefix sum), so it
    is a window sum instead of a loop; a day's events of one channel are the window.
    """
    delta = F.when(F.col("op") == "consume", F.col("est")).when(F.col("op") == "refund", -F.col("est")).otherwise(F.col("actual") - F.col("est"))
    rows = events.withColumn("day", F.to_date("ts")).withColumn("d", delta.cast("long"))
    run = W.partitionBy("channel", "day").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.sum("d").over(run))
    got = rows.groupBy("channel", "day").agg(F.count("*").alias("events"), F.sum("d").alias("s"), F.min("p").alias("low"))
    used = F.col("s") - F.least(F.lit(0), "low")
    return got.select("channel", "day", "events", used.alias("used"), F.when(F.lit(limit) == 0, F.lit(False)).otherwise(used >= limit).alias("spent"))


def cooldown_fold(events: DataFrame) -> DataFrame:
    """The end of the cooldown of a channel and day: each failure in a row doubles it, a success clears it.

    events: (channel, ts, seq, ok). The level of a failure is the number of failures since the last success.
    """
    w = W.partitionBy("channel", F.to_date("ts")).orderBy("ts", "seq")
    rows = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("level", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("channel", F.to_date("ts"), "run").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)))
    last = rows.groupBy("channel", F.to_date("ts").alias("day")).agg(F.max_by(F.struct("ok", "level", "ts"), F.struct("ts", "seq")).alias("x"))
    minutes = F.least(F.lit(float(C.COOLDOWN_BASE)) * F.pow(F.lit(2.0), F.col("x.level") - 1), F.lit(float(C.COOLDOWN_MOST)))
    return last.select("channel", "day", F.col("x.level").cast("int").alias("level"), F.when(F.col("x.ok"), 0).otherwise(minutes).cast("int").alias("minutes"))


def task_state(events: DataFrame, key: str = "task_id") -> DataFrame:
    """The last status of each task by time; ties to the later event."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("since"), F.count("*").alias("events"))


def stale(heartbeats: DataFrame, now: Column, ttl_s: int = C.STALE_TASK_S) -> DataFrame:
    """Workers and how long they have been silent; stale beyond the time to live."""
    last = heartbeats.groupBy("worker").agg(F.max("ts").alias("last"))
    silent = F.unix_timestamp(now) - F.unix_timestamp("last")
    return last.select("worker", silent.alias("silent_s"), (silent > ttl_s).alias("stale"))


def duration_stats(tasks: DataFrame, k: int = 200, most: int = 1440) -> DataFrame:
    """Mean and median minutes of the last k finished tasks of a bucket; buckets with fewer than two use all."""
    rows = tasks.where((F.col("minutes") >= 0) & (F.col("minutes") <= most)).orderBy(F.desc("ended"), F.desc("task_id")).limit(k)
    one = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("minutes"), 1).alias("mean"), F.round(F.median("minutes"), 1).alias("median"))
    whole = rows.agg(F.count("*").alias("n_all"), F.round(F.avg("minutes"), 1).alias("mean_all"), F.round(F.median("minutes"), 1).alias("median_all")).withColumn("k", F.lit(1))
    out = one.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k")
    few = F.col("n") < 2
    return out.select("bucket", "n", F.when(few, F.col("mean_all")).otherwise(F.col("mean")).alias("mean"), F.when(few, F.col("median_all")).otherwise(F.col("median")).alias("median"))


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of an ordered listing, from 0."""
    return df.orderBy(*order).offset(size * number).limit(size)


def oldest_pending(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending'").orderBy("created", "task_id").limit(1)


def retention(files: DataFrame, now: Column, keep: int = 30, least_days: int = 7) -> DataFrame:
    """What a retention rule selects: beyond the newest `keep` of a category and older than least_days. Selection only."""
    age = F.datediff(now, F.to_date("modified"))
    rank = F.row_number().over(W.partitionBy("category").orderBy(F.desc("modified"), F.desc("name")))
    return files.withColumn("age", age).withColumn("rank", rank).withColumn("selected", (F.col("rank") > keep) & (F.col("age") > least_days))


def storage(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def task_reports(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Tasks with the report directory of the same last path part."""
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    return tasks.withColumn("tail", tail(F.col("path"))).join(reports.withColumn("tail", tail(F.col("dir"))), "tail").drop("tail")


def top_up(collect, clean, target: int, rounds: int = C.TOPUP_ROUNDS):
    """Collects again while too many rows are dropped for quality and too few are kept.

    collect(round) gives a frame or None; clean(frame) gives (kept, dropped) with a kind on dropped.
    Stops when a round keeps fewer than max(TOPUP_YIELD, TOPUP_RATIO of the target). Each round is staged.
    """
    from voxgrid.session import staged

    kept = dropped = None
    for r in range(rounds):
        got = collect(r)
        if got is None:
            break
        a, b = clean(got)
        a, b = staged(a, f"kept{r}"), staged(b, f"dropped{r}")
        kept = a if kept is None else kept.unionByName(a)
        dropped = b if dropped is None else dropped.unionByName(b)
        fresh, total = a.count(), kept.count()
        lost = dropped.where("kind = 'quality'").count()
        if total >= target or lost <= C.TOPUP_RATE * (total + lost) or fresh < max(C.TOPUP_YIELD, C.TOPUP_RATIO * target):
            break
    return kept, dropped
