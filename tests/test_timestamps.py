"""The timestamp operator against hand-worked readings and an independent reading by zoneinfo."""

import datetime as dt
from zoneinfo import ZoneInfo

from voxgrid.operators.timestamps import iso_utc, normalised, with_instant

AT = dt.datetime(2026, 10, 1, 12, 0, 0, 500)
CASES = [
    ("2026-03-08 02:30:00", "America/New_York", "mdy", "2026-03-08T07:30:00Z"),  # never occurs
    ("2026-11-01 01:30:00", "America/New_York", "mdy", "2026-11-01T05:30:00Z"),  # occurs twice
    ("Wed Sep 30 02:37:18 +0800 2026", "Europe/Berlin", "dmy", "2026-09-29T18:37:18Z"),
    ("Mon, 03 Aug 2026 12:57:43 -0400", "Asia/Shanghai", "ymd", "2026-08-03T16:57:43Z"),
    ("2026年3月29日 上午12:36", "Asia/Shanghai", "ymd", "2026-03-28T16:36:00Z"),
    ("2026年3月29日 下午12:36", "Asia/Shanghai", "ymd", "2026-03-29T04:36:00Z"),
    ("昨天 07:18", "Asia/Shanghai", "ymd", "2026-09-29T23:18:00Z"),
    ("yesterday at 11:20", "Asia/Kolkata", "dmy", "2026-09-30T05:50:00Z"),
    ("3天前", "Asia/Shanghai", "ymd", "2026-09-28T12:00:00Z"),
    ("2 hours ago", "Europe/London", "dmy", "2026-10-01T10:00:00Z"),
    ("刚刚", "Asia/Shanghai", "ymd", "2026-10-01T12:00:00Z"),
    ("06.07.2025 15:26", "Europe/London", "dmy", "2025-07-06T14:26:00Z"),
    ("06/07/2025 3:26 PM", "America/New_York", "mdy", "2025-06-07T19:26:00Z"),
    ("25/07/2025 15:26", "America/New_York", "mdy", "2025-07-25T19:26:00Z"),  # no doubt here
    ("08/30/2026 12:48 AM", "America/Los_Angeles", "mdy", "2026-08-30T07:48:00Z"),
    ("12-31 23:00", "Asia/Shanghai", "ymd", "2025-12-31T15:00:00Z"),  # would be after the collection
    ("02-29 10:00", "Asia/Shanghai", "ymd", "2024-02-29T02:00:00Z"),
    ("2026-06-04 18:10:25 CST", "Asia/Shanghai", "ymd", "2026-06-04T10:10:25Z"),
    ("2026-06-04 18:10:25 CST", "America/Chicago", "mdy", "2026-06-05T00:10:25Z"),
    ("2026-01-20 00:59:10 IST", "Asia/Kolkata", "dmy", "2026-01-19T19:29:10Z"),
    ("2025-05-04 10:51 来自湖北", "Asia/Shanghai", "ymd", "2025-05-04T02:51:00Z"),
    ("1780195688418", "Asia/Shanghai", "ymd", "2026-05-31T02:48:08Z"),
    ("1780195688", None, None, "2026-05-31T02:48:08Z"),
    ("20260916T184741", "America/New_York", "mdy", "2026-09-16T22:47:41Z"),
    ("20260916184741", "America/New_York", "mdy", "2026-09-16T22:47:41Z"),
    ("2025-05-25T22:45:10.290258 UTC", None, None, "2025-05-25T22:45:10Z"),
    ("2025-05-25 22:45:10", None, None, None),
    ("2026-02-30 10:00", "Asia/Shanghai", "ymd", None),
    ("2025-13-07", "Asia/Shanghai", "ymd", None),
    ("0000-00-00 00:00:00", "Asia/Shanghai", "ymd", None),
    ("2025-01-07 25:00", "Asia/Shanghai", "ymd", None),
    ("5 May", "Europe/London", "dmy", "2026-05-04T23:00:00Z"),
    ("5 Nov 07:10", "Europe/London", "dmy", "2025-11-05T07:10:00Z"),
    ("March 5th, 2026", "America/New_York", "mdy", "2026-03-05T05:00:00Z"),
    ("the 5th", "America/New_York", "mdy", None),
    ("2nd of March 2026, 4:05 PM", "Europe/Berlin", "dmy", "2026-03-02T15:05:00Z"),
    ("2026年5月4日 10时30分", "Asia/Shanghai", "ymd", "2026-05-04T02:30:00Z"),
    ("2026年5月4日下午3点", "Asia/Shanghai", "ymd", "2026-05-04T07:00:00Z"),
    ("5月4日 8时5分9秒", "Asia/Shanghai", "ymd", "2026-05-04T00:05:09Z"),
    ("2026-05-04 10:00 Europe/Paris", "Asia/Shanghai", "ymd", "2026-05-04T08:00:00Z"),
    ("2026-05-04 America/New_York", None, None, "2026-05-04T04:00:00Z"),
    ("2026-05-04 10:00 Europe/Atlantis", "Asia/Shanghai", "ymd", "2026-05-04T02:00:00Z"),
    ("1780195688.75", None, None, "2026-05-31T02:48:08Z"),
    (" " * 220 + "2026-05-04 10:00" + "\u3000" * 300, "Asia/Shanghai", "ymd", "2026-05-04T02:00:00Z"),
    ("", "Asia/Shanghai", "ymd", None),
    ("  ", "Asia/Shanghai", "ymd", None),
    ("NaN", "Asia/Shanghai", "ymd", None),
    ("9" * 5000, "Asia/Shanghai", "ymd", None),
    (None, "Asia/Shanghai", "ymd", None),
]


def test_readings(spark):
    rows = [(i, raw, tz, order, AT, "kept") for i, (raw, tz, order, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, tz string, o string, at timestamp, y string")
    got = with_instant(df, "raw", "tz", "o", "at", "e", "day").withColumn("f", iso_utc("e")).collect()
    assert {r.i: r.f for r in got} == {i: c[3] for i, c in enumerate(CASES)}
    assert all(r.y == "kept" for r in got)


def test_local_times_against_zoneinfo(spark):
    """Every half hour around the changes of the clock, in every zone, against zoneinfo."""
    zones = ["America/New_York", "America/Los_Angeles", "Europe/Berlin", "Europe/London", "Australia/Sydney", "Asia/Kolkata"]
    days = ["2025-03-09", "2025-03-30", "2025-04-06", "2025-10-05", "2025-10-26", "2025-11-02", "2025-07-01"]
    rows = []
    for z in zones:
        for d in days:
            for k in range(-4, 52):
                w = dt.datetime.fromisoformat(d) + dt.timedelta(minutes=30 * k)
                before = w.replace(tzinfo=ZoneInfo(z), fold=0)
                rows.append((f"{w:%Y-%m-%d %H:%M:%S}", z, before.astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%dT%H:%M:%SZ"), AT))
    df = spark.createDataFrame(rows, "raw string, tz string, want string, at timestamp").selectExpr("*", "'ymd' as o")
    bad = with_instant(df, "raw", "tz", "o", "at", "e").withColumn("f", iso_utc("e")).where("f <> want or f is null").collect()
    assert not bad


def test_table_form(spark):
    ch = spark.createDataFrame([("a", "Asia/Shanghai", "ymd"), ("a", "Asia/Shanghai", "ymd")], "channel_id string, tz string, date_order string")
    rows = [(1, "a", "2026-09-29T21:47:32Z", AT), (1, "a", "2026-09-29T21:47:32Z", AT), (2, "a", "07-08", AT), (3, "b", "07-08", AT), (4, None, None, None), (5, "a", "3天前", None)]
    df = spark.createDataFrame(rows, "k long, channel_id string, t string, collected_at timestamp")
    got = normalised(df, ch, "k", "t", True, "x").collect()
    assert sorted((r.row_id, r.normal_form) for r in got) == [(1, "2026-09-30"), (1, "2026-09-30"), (2, "2026-07-08")]
    assert normalised(df.limit(0), ch, "k", "t", False, "x").count() == 0
