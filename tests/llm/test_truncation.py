"""Cut texts made from whole ones with known limits, and length hazards against a plain loop."""

import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa

from voxgrid.llm.truncation import CONTEXTS, NEAR, Clauses, context_ends, cuts, ends, last_contexts, length_hazards

WHO, WHAT, HOW = ["我", "同事", "邻居", "朋友"], ["音箱", "背包", "键盘", "台灯", "水杯"], ["结实", "轻巧", "好看", "费电", "安静"]
SENTENCES = ["{w}上个月买了一个{t}，用下来觉得很{h}。", "{t}放在家里一直没坏，{w}也说{h}。", "要是{t}再{h}一些就更完美了，{w}这么想。", "店家答应给{w}换新的{t}，结果还是{h}。"]


def text(rng, n):
    return "".join(rng.choice(SENTENCES).format(w=rng.choice(WHO), t=rng.choice(WHAT), h=rng.choice(HOW)) for _ in range(n))


def test_cuts(spark):
    rng = random.Random(5)
    rows, bad, doubtful = [], set(), set()
    for i in range(3000):
        t = text(rng, rng.randint(1, 9))
        source = f"s/post/{i % 2}"
        if i % 2 and len(t) > 120:
            whole, t = t, t[:120] + rng.choice(["", "…", "...", "……全文"])
            # a text that stops where a clause is complete doesn't stop inside a sentence
            (doubtful if whole[119] in "。，" or whole[120] in "。，" else bad).add(i)
        elif rng.random() < 0.1:
            t = t[:-1] + rng.choice(["", "……", "！"])  # the writer's own ends
        rows.append((i, source, t))
    for j, tail in enumerate(["�", "<b", "&nbs", "…[more]"]):
        rows.append((9000 + j, "s/post/0", text(rng, 2) + "店家答应给我换新的键" + tail))
        bad.add(9000 + j)
    rows += [(9100, "s/post/0", None), (9101, "s/post/0", ""), (9102, "s/post/0", " \n"), (9103, "s/post/1", text(rng, 3000))]
    df = spark.createDataFrame([("x", *r, "z") for r in rows], "src string, row_id long, source string, text string, length string").drop("length")
    got = {r.row_id for r in cuts(df).collect()}
    missed, extra = bad - got, got - bad - doubtful
    assert len(missed) <= 0.05 * len(bad) and len(extra) <= 0.02 * len(bad), (len(bad), [rows[i][2][-20:] for i in sorted(missed) if i < 3000][:9], [rows[i][2][-20:] for i in sorted(extra) if i < 3000][:9])
    assert cuts(df.limit(0)).count() == 0


def test_hazards_against_loop(spark):
    rng = random.Random(6)
    data = [("a", min(int(rng.expovariate(0.02)) + 1, 140)) for _ in range(1500)] + [("b", rng.randint(1, 60)) for _ in range(300)]
    got = {(r.source, r.length): r for r in length_hazards(spark.createDataFrame(data, "source string, length int")).collect()}
    count = Counter(data)
    for (s, n), r in got.items():
        near = sum(k for (t, m), k in count.items() if t == s and m != n and abs(m - n) <= NEAR)
        expected = max((near + 0.5) / (NEAR + min(n - 1, NEAR)), 0.02)
        assert r.n == count[s, n] and r.reach == sum(k for (t, m), k in count.items() if t == s and m >= n)
        assert math.isclose(r.expected, expected) and math.isclose(r.p, math.exp(-(r.n * math.log(r.n / expected) - r.n + expected)))
    assert [k for k, r in got.items() if r.significant] == [("a", 140)]


def test_ends(spark):
    rows = ["很好。", "很好……", "试一下键", "abc<br", "a &amp", "第一眼……全文", "好#话题#", "好👍", "  "]
    got = {r.text: r for r in ends(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    assert [t for t in rows if t in got and got[t].broken] == ["abc<br", "a &amp"]
    assert [t for t in rows if t in got and got[t].more] == ["第一眼……全文"]
    assert [t for t in rows if t in got and got[t].closed] == ["很好。", "好#话题#", "好👍"] and got["很好……"].dots


def test_long_ends(spark):
    """Addresses, tags and code fragments of any length at the end are seen whole; names with an ampersand are no entities."""
    rows = ["看这里https://shop.example/" + "a" * 300, "好#" + "话" * 60, "字<a href=\"https://x.example/" + "b" * 200, "ask R&D", "call AT&T", "x&nbs", "y&#12"]
    got = {r.text: r for r in ends(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    assert [got[t].closed for t in rows[:2]] == [True, True]
    assert [got[t].broken for t in rows] == [False, False, True, False, False, True, True]


def test_copies_have_one_vote(spark):
    """A text copied often makes no length significant, and its words prove nothing about others."""
    rng = random.Random(8)
    rows = [(i, f"s/post/{i % 3}", text(rng, rng.randint(1, 6))) for i in range(900)]
    rows += [(5000 + i, "s/post/1", "这套花瓶摆在窗台边上刚刚好，颜色像雨后的青苔一样耐看又安静") for i in range(450)]
    rows += [(9000, "s/post/2", "邻居说水杯刚刚好")]
    df = spark.createDataFrame([("x", *r) for r in rows], "src string, row_id long, source string, text string")
    assert not [r for r in cuts(df).collect() if r.row_id >= 5000]


def plain(t):
    return re.sub("(?:[A-Z]{2,3}(?=[0-9]{3}))?[0-9]+", "0", t)


def pieces(t):
    so = "".join(chr(c) for c in range(0xA6, 0x20000) if unicodedata.category(chr(c)) == "So")
    return [p.lstrip(" ") for p in re.split(rf"(?:[\u3001\u3002\uFF01-\uFF0F\uFF1A-\uFF1F\uFF5E\u2026!?;,~#\r\n{so}]|\]|\.(?=[ \t\n\x0b\f\r.]|$)|(?<=\.)\.)+", plain(t))]


def contexts(c, at):
    """The contexts that end at a place of a clause, by level."""
    got = {}
    for level, k in enumerate(CONTEXTS):
        w = c[at - k + 1 : at + 1]
        if at >= k - 1 and (k != 14 or re.fullmatch("[A-Za-z0-9' -]{14}", w)) and (k != 3 or not re.match("[A-Za-z ]", w[-1])):
            got[level] = w
    if at < CONTEXTS[-1] - 1:
        got[len(CONTEXTS) - 1] = "^" + c[: at + 1]
    return got


TEXTS = ["  第一句很好，AB1234型号。第二句, and so it goes on for a while. v2.0 is out.. end", "a.b。 ok", "", "X12345。ABCD123;Q99 键盘", "好👍，再见~~", "...", "价格100000元。x", "no sign at all here 12"]


def test_contexts_against_loop(spark):
    places, final, last = Counter(), Counter(), set()
    for i, t in enumerate(TEXTS):
        *done, end = pieces(t)
        for c in done:
            for at in range(len(c)):
                for level, w in contexts(c, at).items():
                    places[level, w] += 1
                    final[level, w] += at == len(c) - 1
        if end:
            short = len(end) < CONTEXTS[-1]
            last |= {(i, level, w) for level, w in contexts(end, len(end) - 1).items() if not (level == len(CONTEXTS) - 1 and not short and w[0] == "^")}
    got = Clauses(pa.array(TEXTS))
    ours, ends_ = Counter(), Counter()
    name = lambda i, k: "".join(map(chr, got.cps[i - k + 1 : i + 1].tolist()))
    codes = {}
    for n, (level, c, spot) in enumerate(got.contexts()):
        for code, i in zip(c.tolist(), spot.tolist(), strict=True):
            w = ("^" if n >= len(CONTEXTS) else "") + name(i, CONTEXTS[level] if n < len(CONTEXTS) else n - len(CONTEXTS) + 1)
            codes[level, w] = code
            if got.finished[i]:
                ours[level, w] += 1
                ends_[level, w] += bool(got.last[i])
    assert ours == places and +ends_ == +final
    assert len(set(codes.values())) == len(codes)
    rows = last_contexts(spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "h1 long, h2 long, base string"))
    assert {(r.h1, r.level, r.c) for r in rows.collect()} == {(i, level, codes[level, w]) for i, level, w in last}
    shares = context_ends(spark.createDataFrame([(t,) for t in TEXTS], "text string"), spark.createDataFrame([(c,) for c in codes.values()], "c long"))
    assert {r.c: (r.places, r.share) for r in shares.collect()} == {codes[k]: (n, final[k] / n) for k, n in places.items()}
