"""Streaming forms with all input available, against the batch reading."""

import datetime as dt

from pyspark.sql import functions as F

from voxgrid.streaming import forms as S

EVENTS = "channel string, ts timestamp, seq int, op string, est int, actual int, n int"
ROWS = [("a", dt.datetime(2024, 1, 1, h), i, op, e, a, n) for i, (h, op, e, a, n) in enumerate([(1, "consume", 3, 0, 0), (2, "refund", 5, 0, 0), (3, "consume", 4, 0, 2), (4, "settle", 4, 1, 0)])] + [("b", dt.datetime(2024, 1, 7, 5), 9, "consume", 2, 0, 0), ("b", dt.datetime(2024, 1, 8, 5), 10, "consume", 7, 0, 0)]


def streamed(spark, tmp_path, name, make, mode):
    src = tmp_path / "in"
    if not src.exists():
        spark.createDataFrame(ROWS, EVENTS).coalesce(1).write.parquet(str(src))
    df = make(spark.readStream.schema(EVENTS).parquet(str(src)))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def test_windows(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, EVENTS)
    got = streamed(spark, tmp_path, "daily", lambda x: S.daily(x, "channel"), "complete")
    assert sorted(got) == sorted(tuple(r) for r in S.daily(batch, "channel").collect()) == [("2024-01-01", "a", 4), ("2024-01-07", "b", 1), ("2024-01-08", "b", 1)]
    got = streamed(spark, tmp_path, "weekly", lambda x: S.weekly(x, "channel"), "complete")
    assert sorted(got) == [("2024-01-01", "a", 4), ("2024-01-01", "b", 1), ("2024-01-08", "b", 1)]


def test_once_and_sessions(spark, tmp_path):
    got = streamed(spark, tmp_path, "once", lambda x: S.once(x, "channel").select("channel"), "append")
    assert sorted(got) == [("a",), ("b",)]
    got = streamed(spark, tmp_path, "sess", lambda x: S.sessions(x.withColumnRenamed("channel", "worker"), gap_s=7200).select("worker", "beats"), "complete")
    assert sorted(got) == [("a", 4), ("b", 1), ("b", 1)]


def test_states(spark, tmp_path):
    got = streamed(spark, tmp_path, "quota", S.quota, "update")
    assert sorted(got) == [("a", "2024-01-01", 1), ("b", "2024-01-08", 7)]
    got = streamed(spark, tmp_path, "breaker", S.breaker, "update")
    assert sorted(got) == [("a", 1, False), ("b", 2, True)]


def test_append_new(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "run_id string, v int").write.parquet(src)
    for i in range(2):
        S.append_new(spark.readStream.schema("run_id string, v int").parquet(src), out, "run_id", str(tmp_path / f"c{i}")).awaitTermination(120)
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["x", "y"]
    seen = []
    q = S.poll_pending(spark.readStream.schema("run_id string, v int").parquet(src).withColumn("status", F.lit("pending")).withColumn("created", F.col("v")).withColumn("task_id", F.col("run_id")), lambda b: seen.extend(r.run_id for r in b.collect()), str(tmp_path / "p"), every="100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert seen == ["x", "x", "y"]
