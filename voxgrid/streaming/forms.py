"""Structured Streaming forms of the incremental parts: roll-ups, de-duplication, heartbeats, quotas, breakers.

Every form takes a streaming frame with a watermarkable event time and returns a streaming frame; the
same function runs on a batch frame where Spark allows it. Late rows beyond the watermark are dropped by
Spark; state is bounded by the watermark or by timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxgrid import config as C


def daily(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Events per key and day: the reset of a daily quota is the window's border."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").cast("string").alias("day"), key, "n")


def weekly(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Events per key and week from Monday (the epoch was a Thursday, hence the offset of four days)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").cast("string").alias("week"), key, "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(beats: DataFrame, gap_s: int = C.STALE_TASK_S, late: str = "10 minutes") -> DataFrame:
    """Spans in which a worker was alive: a gap beyond the time to live ends one."""
    rows = beats.withWatermark("ts", late) if beats.isStreaming else beats
    return rows.groupBy(F.session_window("ts", f"{gap_s} seconds").alias("w"), "worker").agg(F.count("*").alias("beats")).select("worker", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "beats")


def quota(events: DataFrame) -> DataFrame:
    """Use of a quota per channel after each batch, clamped at 0 and reset with the day of the event time.

    events: (channel, ts, seq, op, est, actual). Batches are folded in order of time; the state is one
    number and one day per channel.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, used = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for ts, op, est, actual in zip(rows.ts, rows.op, rows.est, rows.actual, strict=True):
            d = ts.strftime("%Y-%m-%d")
            if d < day:
                continue
            if d > day:
                day, used = d, 0
            used = max(used + (est if op == "consume" else -est if op == "refund" else actual - est), 0)
        state.update((day, int(used)))
        yield pd.DataFrame({"channel": [key[0]], "day": [day], "used": [int(used)]})

    return events.groupBy("channel").applyInPandasWithState(fold, "channel string, day string, used long", "day string, used long", "update", GroupStateTimeout.NoTimeout)


def breaker(results: DataFrame, most: int = 2) -> DataFrame:
    """Channels whose last results were empty `most` times in a row or more: (channel, empty, open)."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = state.get[0] if state.exists else 0
        for n in pd.concat(list(batches)).sort_values(["ts", "seq"])["n"]:
            empty = empty + 1 if n == 0 else 0
        state.update((int(empty),))
        yield pd.DataFrame({"channel": [key[0]], "empty": [int(empty)], "open": [empty >= most]})

    return results.groupBy("channel").applyInPandasWithState(count, "channel string, empty long, open boolean", "empty long", "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame) -> DataFrame:
    """The furthest progress of each channel: a running maximum."""
    return events.groupBy("channel").agg(F.max("progress").alias("progress"))


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str, trigger: dict | None = None):
    """Writes each batch's rows whose key isn't in the table yet: an append-only history that can be run again."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def poll_pending(tasks: DataFrame, handle, checkpoint: str, every: str = "2 seconds"):
    """Hands the pending tasks of each batch, oldest first, to a function."""

    def run(batch: DataFrame, _: int) -> None:
        handle(batch.where("status = 'pending'").orderBy("created", "task_id"))

    return tasks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
