"""Text, lexicon, date and statistics functions against plain readings and hand-worked values."""

import difflib
import math
import random

from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions import dates as D
from voxgrid.functions import lexicon as L
from voxgrid.functions import stats as S
from voxgrid.functions import text as T


def values(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_scan_against_reading(spark):
    rng = random.Random(4)
    parts = [*C.LEXICON, *C.DEGREES, *C.NEGATIONS, *C.CONTEXT_WORDS, *C.STRONG_NEGATIVE, "看", "了", "x", "，", " ", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "不好用", "非常好用", "没卡顿"]
    got = values(spark, [(t,) for t in texts], "t string", s=L.scan(F.col("t")))
    for t, r in zip(texts, got, strict=True):
        score, label = L.scan_text(t)
        assert math.isclose(r.s.score, score, abs_tol=2e-4) and (r.s.sentiment == label or abs(abs(score) - C.NEUTRAL_BAND) < 1e-3), (t, r.s, score)
    assert got[-5].s.confidence <= C.NO_HIT_CAP


def test_aspects(spark):
    dims = [("sound", ["音质"]), ("ship", ["物流"])]
    rows = [("音质好用，但是物流失望",), ("音质好用，音质失望",), ("音质一般",), (None,), ("物流不好用",)]
    got = [r.a for r in values(spark, rows, "t string", a=L.aspect_votes(F.col("t"), dims))]
    assert got == [{"sound": "positive", "ship": "negative"}, {}, {}, {}, {"ship": "negative"}]


def spec_relevance(text, signal):
    t, s = "".join((text or "").lower().split()), "".join((signal or "").lower().split())
    if not s:
        return 0.0
    if s in t:
        return 1.0
    if len(s) < 4:
        return 0.0
    m = difflib.SequenceMatcher(None, s, t, autojunk=False).find_longest_match()
    least = 3 if all(c.isascii() and (c.isalnum() or c in " _-") for c in s) else 2
    return round(m.size / len(s), 4) if m.size >= least and m.a == 0 else 0.0


def test_relevance_against_difflib(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("砾光G7音箱ab") for _ in range(rng.randint(0, 14))), "".join(rng.choice("砾光G7音箱ab") for _ in range(rng.randint(0, 7)))) for _ in range(500)] + [(None, "砾光音箱"), ("砾光", None), ("velmora lam", "Velmora Lamp")]
    got = values(spark, rows, "t string, s string", r=T.relevance(F.col("t"), F.col("s")))
    for (t, s), r in zip(rows, got, strict=True):
        assert math.isclose(r.r, spec_relevance(t, s), abs_tol=1e-9), (t, s, r.r)


def test_text_functions(spark):
    one = lambda v, c: values(spark, [(v,)], "t string", r=c(F.col("t")))[0].r
    assert one(" <b>好</b> https://a.b/c @小明 棒！！！！ ", T.clean_text) == "好 棒！"
    assert one("！！！", T.clean_text) == "" and one(None, T.clean_text) is None
    assert one("电话13812345678，信箱 a.b@c.com 找我", T.mask) == "电话 ，信箱 找我"
    assert one("1.2万", T.chinese_count) == 12000 and one("300", T.chinese_count) == 300 and one("x", T.chinese_count) == 0 and one(None, T.chinese_count) is None
    assert one("a" * 90, T.evidence_text) == "a" * 80 + "…" and one("你个混蛋", T.evidence_text) == "（含不当用语）"
    assert one("https://x.com/a/64ab12?y=1", T.note_id) == "64ab12"
    assert one("一，二但是三。", T.clauses) == ["一", "二", "三"]
    assert values(spark, [("Ｇ７ ﬁ", "a&amp;b&nbsp;")], "t string, h string", n=T.nfkc(F.col("t")), u=T.unescape(F.col("h")))[0][:] == ("G7 fi", "a&b\xa0")
    assert values(spark, [("同款音箱", "音箱测评"), ("甲", "乙"), ("甲乙丙丁", "戊己庚辛")], "a string, b string", r=T.consistent(F.col("a"), F.col("b")))[2].r is False


def test_dates(spark):
    import datetime as dt

    at = dt.datetime(2024, 5, 20, 12, 0)
    rows = [("2小时前", "2024-05-20 10:00"), ("昨天 08:30", "2024-05-19 08:30"), ("05-03 10:11", "2024-05-03 10:11"), ("Mon, 06 May 2024 10:00:00 +0800", "2024-05-06"), ("2024-05-01 x", "2024-05-01 x"), ("???", "???")]
    got = values(spark, [(r, at) for r, _ in rows], "t string, at timestamp", r=D.normalize_datetime(F.col("t"), F.col("at")))
    assert [g.r for g in got] == [w for _, w in rows]
    rows = [("发布于2024年5月3日", "2024-05-03"), ("5-3", "2024-05-03"), (None, ""), ("2024/13/45", "2024-13-45")]
    got = values(spark, [(r, at) for r, _ in rows], "t string, at timestamp", r=D.normalize_pub_date(F.col("t"), F.col("at")))
    assert [g.r for g in got] == [w for _, w in rows]


def test_intervals(spark):
    lo, hi = S.wilson(F.col("p"), F.col("n"))
    got = values(spark, [(0.5, 100.0), (0.0, 10.0), (1.0, 10.0), (0.5, 0.0), (None, 5.0)], "p double, n double", lo=F.round(lo, 3), hi=F.round(hi, 3))
    assert got[0][:] == (0.404, 0.596) and got[1].lo == 0.0 and got[2].hi == 1.0 and got[3][:] == (None, None) == got[4][:]
    got = values(spark, [(3.0, 4.0), (3.0, None)], "a double, b double", r=S.delta_width(F.col("a"), F.col("b")))
    assert [g.r for g in got] == [5.0, None]


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 50, 2), ("b", 30, 99), ("c", 20, 99)], "key string, w long, cap long")
    got = {r.key: r.quota for r in S.largest_remainder(df, "w", 7).collect()}
    assert got == {"a": 4, "b": 2, "c": 1}
    assert {r.key: r.quota for r in S.largest_remainder(df, "w", 7, cap="cap").collect()}["a"] == 2
