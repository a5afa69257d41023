"""Date functions of the pipeline that keep its exact, lenient rules; as_of is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def normalize_datetime(raw: Column, as_of: Column) -> Column:
    """Relative and partial forms as yyyy-MM-dd HH:mm or yyyy-MM-dd; anything else as it is. English mail dates keep their own day."""
    at = lambda secs: F.date_format(F.timestamp_seconds(F.unix_timestamp(as_of) - secs), "yyyy-MM-dd HH:mm")
    num = lambda p: F.regexp_extract(raw, p, 1).try_cast("bigint")
    mail = r"(?:[A-Z][a-z]{2},? )?(?:([0-9]{1,2}) ([A-Z][a-z]{2})|([A-Z][a-z]{2}) ([0-9]{1,2}))[ ,].*?([0-9]{4})"
    d = F.coalesce(F.nullif(F.regexp_extract(raw, mail, 1), F.lit("")), F.regexp_extract(raw, mail, 4))
    m = F.coalesce(F.nullif(F.regexp_extract(raw, mail, 2), F.lit("")), F.regexp_extract(raw, mail, 3))
    month = F.floor((F.position(m, F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")) + 2) / 3).cast("int").cast("string")
    md = r"^([0-9]{1,2})-([0-9]{1,2}) ([0-9]{2}:[0-9]{2})"
    return (
        F.when(raw.isNull(), None)
        .when(raw.contains("刚刚"), at(F.lit(0)))
        .when(raw.contains("昨天"), F.concat_ws(" ", F.date_format(F.date_sub(F.to_date(as_of), 1), "yyyy-MM-dd"), F.nullif(F.regexp_extract(raw, "([0-9]{1,2}:[0-9]{2})", 1), F.lit(""))))
        .when(num("([0-9]+) ?分钟前").isNotNull(), at(num("([0-9]+) ?分钟前") * 60))
        .when(num("([0-9]+) ?小时前").isNotNull(), at(num("([0-9]+) ?小时前") * 3600))
        .when(num("([0-9]+) ?天前").isNotNull(), at(num("([0-9]+) ?天前") * 86400))
        .when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), raw)
        .when(raw.rlike(md), F.concat(F.year(as_of), F.lit("-"), _two(F.regexp_extract(raw, md, 1)), F.lit("-"), _two(F.regexp_extract(raw, md, 2)), F.lit(" "), F.regexp_extract(raw, md, 3)))
        .when(raw.rlike("^" + mail), F.concat_ws("-", F.regexp_extract(raw, mail, 5), _two(month), _two(d)))
        .otherwise(raw)
    )


def normalize_pub_date(raw: Column, as_of: Column) -> Column:
    """The first year-month-day found, else month-day with the year of as_of, else the first ten characters of the date-time form."""
    ymd, md = r"([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})", r"([0-9]{1,2})[-/月]([0-9]{1,2})"
    part = lambda p, i: F.regexp_extract(raw, p, i)
    return (
        F.when(raw.isNull(), "")
        .when(part(ymd, 1) != "", F.concat_ws("-", part(ymd, 1), _two(part(ymd, 2)), _two(part(ymd, 3))))
        .when(part(md, 1) != "", F.concat_ws("-", F.year(as_of).cast("string"), _two(part(md, 1)), _two(part(md, 2))))
        .otherwise(F.substring(F.coalesce(normalize_datetime(raw, as_of), F.lit("")), 1, 10))
    )


def directory_age(by_name: Column, by_time: Column) -> Column:
    """Days since a directory's date, the younger of name and time stamp, never negative."""
    return F.greatest(F.lit(0), F.least(by_name, by_time))


def expired(iso: Column, now: Column, ttl_s: int) -> Column:
    """Whether an ISO time is older than its time to live; an unreadable one is."""
    at = iso.try_cast("timestamp")
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) > ttl_s, F.lit(True))
