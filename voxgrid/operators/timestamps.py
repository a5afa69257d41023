"""Mixed timestamp formats and time zones, brought to one instant (or calendar day) per row.

Method: every format is one branch of a single regular expression with named groups. A row is
matched once: the match is rewritten into its components, which are validated against the calendar
and put together by integer day arithmetic. Zones come from the text or from the row's channel.
Everything is a Catalyst expression; there is no Python on the rows.

Defined results: null, blank or unreadable text, impossible dates and times, and relative texts of
a row without a collection time give null. A text without a zone of a channel without one gives
null as well. Extra columns pass through untouched, since all work columns carry a prefix.
"""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.session import table

#: Offsets in minutes of zone abbreviations; "NAME@Region" holds where the channel's zone is in that region.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0,
    "CST@Asia": 480, "CST@America": -360, "CDT@America": -300, "EST@America": -300, "EDT@America": -240,
    "MST@America": -420, "MDT@America": -360, "PST@America": -480, "PDT@America": -420,
    "AKST@America": -540, "AKDT@America": -480,
    "WET@Europe": 0, "WEST@Europe": 60, "BST@Europe": 60, "CET@Europe": 60, "CEST@Europe": 120,
    "EET@Europe": 120, "EEST@Europe": 180, "MSK@Europe": 180,
    "IST@Asia": 330, "IST@Europe": 60, "BST@Asia": 360, "PKT@Asia": 300, "HKT@Asia": 480, "SGT@Asia": 480,
    "JST@Asia": 540, "KST@Asia": 540,
    "AEST@Australia": 600, "AEDT@Australia": 660, "ACST@Australia": 570, "ACDT@Australia": 630,
    "AWST@Australia": 480, "EST@Australia": 600, "EDT@Australia": 660, "NZST@Pacific": 720, "NZDT@Pacific": 780,
}
#: Abbreviations that have one meaning wherever the channel is.
ANYWHERE = {
    "EDT": -240, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CDT": -300, "EST": -300, "CET": 60,
    "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "BST": 60,
    "IST": 330,
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Seconds of one unit of a relative value.
UNITS = {
    "秒": 1, "second": 1, "sec": 1, "分": 60, "minute": 60, "min": 60, "小时": 3600, "hour": 3600,
    "天": 86400, "日": 86400, "day": 86400, "周": 604800, "星期": 604800, "week": 604800,
}
#: The components that a match is rewritten into; a group of the pattern is one of these plus a number.
PARTS = ("y", "m", "d", "a", "b", "mon", "h", "i", "s", "ap", "z", "zi", "e", "n", "u", "day", "md")
#: The names of zones that a text may give after a time.
ZONES = sorted(z for z in available_timezones() if re.fullmatch(r"[A-Z][a-z]+/[A-Z][A-Za-z_/+-]+", z))

_SEP = "\x01"
#: A zero that Catalyst takes for non-deterministic. Added to a result, it keeps filters on that result above the
#: projections that compute it; pushed down, they would repeat the whole nested expression at every use.
_STAY = "if(spark_partition_id() < 0, 1, 0)"


def _pattern() -> tuple[str, str]:
    """The alternation over all formats, and the replacement that lists its components."""
    count: dict[str, int] = {}

    def g(part: str, body: str) -> str:
        count[part] = count.get(part, 0) + 1
        return f"(?<{part}{count[part]}>{body})"

    def clock(seconds: bool = True) -> str:
        s = f"(?::{g('s', '[0-9]{2}')}(?:[.,][0-9]+)?)?" if seconds else ""
        return f"{g('h', '[0-9]{1,2}')}:{g('i', '[0-9]{2}')}{s}"

    def zone() -> str:
        named = g("zi", r"\b[A-Z][a-z]+/[A-Z][A-Za-z_/+-]+")
        return rf"(?:{named}|{g('z', r'(?:(?:UTC|GMT)?[+-][0-9]{1,2}(?::?[0-9]{2})?|Z|\b[A-Z]{2,5}\b)')})"

    def han_clock() -> str:
        return rf"(?:{clock()}|{g('h', '[0-9]{1,2}')}[时点](?:{g('i', '[0-9]{1,2}')}分?(?:{g('s', '[0-9]{1,2}')}秒?)?)?)"

    def ap() -> str:
        return g("ap", r"[AaPp]\.?[Mm]\.?")

    month = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    month = f"(?i:{month})"
    week = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
    nth = r"(?:(?i:st|nd|rd|th))?"
    place = r"(?:\s*(?:来自|发布于)?\s*[\p{IsHan}]+)?"
    units = "|".join(sorted((u for u in UNITS), key=len, reverse=True))
    branches = [
        # 2026-05-04, 2026/5/4, 2026.05.04 with or without clock, fraction, zone
        f"{g('y', '[0-9]{4}')}[-/.]{g('m', '[0-9]{1,2}')}[-/.]{g('d', '[0-9]{1,2}')}"
        + rf"(?:(?:T|\s+){clock()}(?:\s*{ap()})?(?:\s*{zone()})?|\s+{zone()})?{place}",
        f"{g('y', '[0-9]{4}')}年{g('m', '[0-9]{1,2}')}月{g('d', '[0-9]{1,2}')}日"
        + rf"(?:\s*{g('ap', '上午|下午|凌晨|早上|中午|晚上')}?\s*{han_clock()}(?:\s*{zone()})?)?{place}",
        # 20260504, 20260504T101112, 20260504101112
        f"{g('y', '[0-9]{4}')}{g('m', '[0-9]{2}')}{g('d', '[0-9]{2}')}"
        + f"(?:T?{g('h', '[0-9]{2}')}:?{g('i', '[0-9]{2}')}(?::?{g('s', '[0-9]{2}')}(?:[.,][0-9]+)?)?(?:{zone()})?)?",
        # epoch seconds, milliseconds, microseconds, nanoseconds
        rf"{g('e', '[0-9]{19}|[0-9]{16}|[0-9]{13}|[0-9]{10}')}(?:\.[0-9]+)?",
        # Mon, 03 Aug 2026 12:57:43 +0800
        rf"{week}{g('d', '[0-9]{1,2}')}{nth}\s+(?:of\s+)?{g('mon', month)}(?:,?\s+{g('y', '[0-9]{4}')})?"
        + rf"(?:,?\s+{clock()}(?:\s*{ap()})?(?:\s*{zone()})?)?",
        # Wed Sep 30 02:37:18 +0800 2026
        rf"{week}{g('mon', month)}\s+{g('d', '[0-9]{1,2}')}\s+{clock()}(?:\s+{zone()})?\s+{g('y', '[0-9]{4}')}",
        # Apr 12, 19:28 / Jan 20, 2025 / Jan 20, 2025, 10:11 PM
        rf"{week}{g('mon', month)}\s+{g('d', '[0-9]{1,2}')}{nth}(?:,?\s+{g('y', '[0-9]{4}')})?"
        + rf"(?:,?\s+(?:at\s+)?{clock()}(?:\s*{ap()})?(?:\s*{zone()})?)?",
        # 08/30/2026 6:48 PM, 06.07.2025 15:26
        f"{g('a', '[0-9]{1,2}')}[-/.]{g('b', '[0-9]{1,2}')}[-/.]{g('y', '[0-9]{4}')}"
        + rf"(?:,?\s+{clock()}(?:\s*{ap()})?(?:\s*{zone()})?)?{place}",
        # 01-21 04:30, 10-16 and a place; 1月21日
        f"{g('a', '[0-9]{1,2}')}[-/]{g('b', '[0-9]{1,2}')}"
        + rf"(?:\s+{clock()}(?:\s*{ap()})?(?:\s*{zone()})?)?{place}",
        f"{g('m', '[0-9]{1,2}')}月{g('d', '[0-9]{1,2}')}日"
        + rf"(?:\s*{g('ap', '上午|下午|凌晨|早上|中午|晚上')}?\s*{han_clock()})?{place}",
        rf"{g('n', '[0-9]{1,9}')}\s*(?:个\s*)?{g('u', f'(?i:{units})')}s?(?:钟)?\s*(?:之?前|(?i:ago))",
        g("md", r"刚刚|刚才|(?i:just now|now)"),
        rf"{g('day', '今天|昨天|前天|(?i:today|yesterday)')}(?:,?\s*(?:at\s+)?(?:{clock()}(?:\s*{ap()})?)?)",
    ]
    pattern = rf"^[\s\p{{Z}}]*(?:{'|'.join(branches)})[\s\p{{Z}}]*$"
    rep = _SEP + _SEP.join("".join(f"${{{p}{k}}}" for k in range(1, count.get(p, 0) + 1)) for p in PARTS)
    return pattern, rep


PATTERN, REPLACEMENT = _pattern()


def _days(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 of a proleptic Gregorian date, as an SQL expression over integers."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    era = f"({yy} div 400)"
    yoe = f"({yy} - {era} * 400)"
    doy = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    return f"({era} * 146097 + {yoe} * 365 + {yoe} div 4 - {yoe} div 100 + {doy} - 719468)"


def _month_length(y: str, m: str) -> str:
    leap = f"(({y} % 4 = 0 and {y} % 100 <> 0) or {y} % 400 = 0)"
    return f"(case when {m} = 2 then if({leap}, 29, 28) when {m} in (4, 6, 9, 11) then 30 else 31 end)"


def _to_utc(seconds: str, tz: str) -> str:
    """Epoch seconds of a wall clock (as seconds since 1970) in a zone.

    A time that occurs twice is the earlier one; one that never occurs has the offset from before.
    """
    return f"unix_seconds(to_utc_timestamp(timestamp_seconds({seconds}), {tz}))"


def _to_local(seconds: str, tz: str) -> str:
    return f"unix_seconds(from_utc_timestamp(timestamp_seconds({seconds}), {tz}))"


def _lookup(entries: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def with_instant(
    df: DataFrame, text: str, tz: str, order: str, as_of: str, out: str = "epoch_s", out_day: str | None = None
) -> DataFrame:
    """df with the epoch seconds (and, as out_day, the calendar day in the zone) that text stands for.

    tz, order (ymd, mdy or dmy) and as_of (a timestamp) are the names of the columns with the row's
    zone, its order of day and month in doubt, and the moment that relative values count back from.
    """
    p = "__ts_"
    raw = F.col(text)
    got = F.split(F.regexp_replace(F.translate(raw, _SEP, ""), PATTERN, REPLACEMENT), _SEP, -1)
    df = df.withColumn(p + "c", F.when(raw.isNotNull(), got))
    df = df.withColumn(p + "c", F.when(F.size(p + "c") == len(PARTS) + 1, F.col(p + "c")))
    part = {k: f"{p}c[{i + 1}]" for i, k in enumerate(PARTS)}
    num = lambda k: f"try_cast(nullif({part[k]}, '') as bigint)"
    months = "".join(MONTHS)
    df = df.selectExpr(
        "*",
        f"{num('y')} as {p}y",
        f"coalesce({num('m')}, if({part['mon']} <> '', (instr('{months}', lower(left({part['mon']}, 3))) + 2) div 3, null)) as {p}m0",
        f"{num('d')} as {p}d0",
        f"{num('a')} as {p}a",
        f"{num('b')} as {p}b",
        f"coalesce({num('h')}, 0) as {p}h0",
        f"coalesce({num('i')}, 0) as {p}i",
        f"coalesce({num('s')}, 0) as {p}s",
        f"case when {part['ap']} in ('下午', '晚上', '中午') or lower({part['ap']}) like 'p%' then 'p' when {part['ap']} <> '' then 'a' end as {p}ap",
        f"nullif({part['z']}, '') as {p}z",
        f"case when {part['zi']} in ({', '.join(repr(z) for z in ZONES)}) then {part['zi']} end as {p}zi",
        f"nullif({part['e']}, '') as {p}e",
        f"{num('n')} as {p}n",
        f"lower({part['u']}) as {p}u",
        f"case when {part['day']} in ('昨天') or lower({part['day']}) = 'yesterday' then 1 when {part['day']} = '前天' then 2 when {part['day']} <> '' then 0 end as {p}back",
        f"{part['md']} <> '' as {p}now",
        f"unix_seconds({as_of}) as {p}at",
        f"coalesce({tz}, 'UTC') as {p}tz",
        f"{tz} is not null as {p}known",
    )
    day_first = f"coalesce({order}, 'ymd') = 'dmy'"
    swap = f"if({day_first}, not ({p}b > 12 and {p}a <= 12), ({p}a > 12 and {p}b <= 12))"
    hour = (
        f"case when {p}ap is null then {p}h0 when {p}h0 > 12 then {p}h0"
        f" when {p}ap = 'p' then {p}h0 % 12 + 12 else {p}h0 % 12 end"
    )
    df = df.selectExpr(
        "*",
        f"coalesce({p}m0, if({swap}, {p}b, {p}a)) as {p}m",
        f"coalesce({p}d0, if({swap}, {p}a, {p}b)) as {p}d",
        f"{hour} as {p}h",
        f"{_to_local(p + 'at', p + 'tz')} as {p}at_local",
    )
    # the zone written in the text: a signed offset, or an abbreviation as it is meant in the channel's region
    z = F.upper(F.col(p + "z"))
    sign = F.regexp_extract(z, "([+-])([0-9]{1,2}):?([0-9]{2})?$", 1)
    hours = F.regexp_extract(z, "([+-])([0-9]{1,2}):?([0-9]{2})?$", 2).try_cast("bigint")
    mins = F.regexp_extract(z, "([+-])([0-9]{1,2}):?([0-9]{2})?$", 3).try_cast("bigint")
    signed = F.when(sign == "-", -1).otherwise(1) * (hours * 60 + F.coalesce(mins, F.lit(0)))
    region = F.substring_index(F.col(p + "tz"), "/", 1)
    table_ = _lookup({**ABBREVIATIONS, **{f"{k}@": v for k, v in ANYWHERE.items()}})
    named = F.coalesce(
        F.try_element_at(table_, F.concat(z, F.lit("@"), region)),
        F.try_element_at(table_, z),
        F.try_element_at(table_, F.concat(z, F.lit("@"))),
    )
    df = df.withColumn(p + "off", F.when(sign != "", F.when(F.abs(signed) <= 1080, signed)).otherwise(named.cast("bigint")))

    # a missing year is the latest that puts the value not after the collection time; 29 February needs a leap year
    feb = f"({p}m = 2 and {p}d = 29)"
    floor4 = lambda y: f"if({feb}, ({y}) - ({y}) % 4 - if((({y}) - ({y}) % 4) % 100 = 0 and (({y}) - ({y}) % 4) % 400 <> 0, 4, 0), {y})"
    year_at = f"year(date_add(date'1970-01-01', cast(floor({p}at_local / 86400) as int)))"
    df = df.selectExpr("*", f"cast({floor4(year_at)} as bigint) as {p}y1")
    df = df.selectExpr("*", f"cast({floor4(f'{p}y1 - 1')} as bigint) as {p}y2")
    clock = f"({p}h * 3600 + {p}i * 60 + {p}s)"
    at_zone = lambda secs: f"if({p}off is not null, {secs} - {p}off * 60, {_to_utc(secs, f'coalesce({p}zi, {p}tz)')})"
    first = f"({_days(p + 'y1', p + 'm', p + 'd')} * 86400 + {clock})"
    yearless = f"({p}y is null and {p}m is not null and {p}d is not null)"
    df = df.selectExpr("*", f"coalesce({p}y, if({yearless}, if({at_zone(first)} <= {p}at, {p}y1, {p}y2), null)) as {p}yy")
    valid = (
        f"{p}yy between 1 and 9999 and {p}m between 1 and 12 and {p}d between 1 and {_month_length(p + 'yy', p + 'm')}"
        f" and {p}h between 0 and 23 and {p}i between 0 and 59 and {p}s between 0 and 59"
    )
    wall = f"({_days(p + 'yy', p + 'm', p + 'd')} * 86400 + {clock})"
    unit = "case " + " ".join(f"when {p}u = '{k}' then {v}" for k, v in UNITS.items()) + " end"
    back = f"(floor({p}at_local / 86400) - {p}back) * 86400 + {clock}"
    clock_ok = f"{p}h between 0 and 23 and {p}i between 0 and 59 and {p}s between 0 and 59"
    df = df.selectExpr(
        "*",
        f"""cast(case
            when {p}c is null then null
            when {p}e is not null then try_cast(left({p}e, 10) as bigint)
            when {p}now then {p}at
            when {p}n is not null then {p}at - {p}n * {unit}
            when {p}back is not null then if({clock_ok} and {p}known, {_to_utc(back, p + 'tz')}, null)
            when not ({valid}) then null
            when {p}off is null and {p}zi is null and not {p}known then null
            else {at_zone(wall)} end as bigint) + {_STAY} as {out}""",
        f"({p}e is not null or {p}now or {p}n is not null or {p}off is not null or {p}zi is not null) as {p}instant",
        f"if({valid}, {_days(p + 'yy', p + 'm', p + 'd')}, null) as {p}plain",
    )
    if out_day:
        local = f"cast(floor({_to_local(out, p + 'tz')} / 86400) as int)"
        df = df.selectExpr(
            "*",
            f"""(case when {out} is null then null
                when {p}instant or {p}back is not null then if({p}known, date_add(date'1970-01-01', {local}), null)
                else date_add(date'1970-01-01', cast({p}plain as int)) end) + {_STAY} as {out_day}""",
        )
    return df.drop(*[c for c in df.columns if c.startswith(p)])


def iso_utc(epoch_s: str) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of epoch seconds, whatever the session's zone."""
    day = f"date_add(date'1970-01-01', cast(floor({epoch_s} / 86400) as int))"
    sec = f"pmod({epoch_s}, 86400)"
    two = lambda e: f"lpad(cast({e} as string), 2, '0')"
    return F.expr(
        f"concat(cast({day} as string), 'T', {two(f'{sec} div 3600')}, ':', {two(f'{sec} div 60 % 60')}, ':', {two(f'{sec} % 60')}, 'Z')"
    )


#: Table, its key, its text of a time, and whether the result is a calendar day.
FIELDS = (
    ("posts", "post_seq", "timestamp", False),
    ("comments", "comment_seq", "time", False),
    ("coded_items", "item_seq", "pub_date", True),
)


def normalised(df: DataFrame, channels: DataFrame, key: str, text: str, day: bool, src: str) -> DataFrame:
    """(src, row_id, normal_form) of each row whose text can be read as a real date.

    channels has one row per channel; it is a reference table of fixed size, and Spark broadcasts it
    where its size is under the broadcast threshold. Repeated channel ids count once.
    """
    ref = channels.groupBy("channel_id").agg(F.min(F.struct("tz", "date_order")).alias("r"))
    ref = ref.select("channel_id", F.col("r.tz").alias("tz"), F.col("r.date_order").alias("date_order"))
    rows = df.select(
        F.col(key).cast("bigint").alias("row_id"), "channel_id", F.col(text).alias("raw"), F.col("collected_at").alias("at")
    ).where(F.col("raw").isNotNull())
    rows = rows.join(ref, "channel_id", "left")
    rows = with_instant(rows, "raw", "tz", "date_order", "at", "epoch_s", "day")
    form = F.col("day").cast("string") if day else iso_utc("epoch_s")
    return rows.where(F.col("day" if day else "epoch_s").isNotNull()).select(
        F.lit(src).alias("src"), "row_id", form.alias("normal_form")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unambiguous instant or day of every readable time of posts, comments and coded items."""
    channels = table(spark, sf_dir, "channels", "channel_id", "tz", "date_order")
    out = None
    for name, key, text, day in FIELDS:
        part = normalised(table(spark, sf_dir, name, key, "channel_id", text, "collected_at"), channels, key, text, day, name)
        out = part if out is None else out.unionByName(part)
    return out
