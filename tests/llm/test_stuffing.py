"""Stuffed pages: term counts and fits against Python, and made-up pages of known kinds."""

import math
import random
import re
from collections import Counter

import numpy as np

from voxgrid.llm.stuffing import LEAST, pages, scored

WHO = ["我", "同事", "邻居", "朋友", "妹妹", "老师"]
WHAT = ["音箱", "背包", "键盘", "台灯", "水杯", "雨伞", "耳机", "相机"]
HOW = ["结实", "轻巧", "好看", "费电", "安静", "厚重", "顺手", "普通"]
SENTENCES = ["{w}上个月买了一个{t}，用下来觉得很{h}。", "{t}放在家里一直没坏，{w}也说{h}。", "要是{t}再{h}一些就更好了，{w}这么想。", "周末{w}带着{t}出门，路上感觉{h}。",
             "店家答应给{w}换新的{t}，结果还是{h}。", "说实话{t}的样子有点{h}，不过{w}喜欢。", "下雨那天{w}把{t}落在车上，回来还是{h}。"]


def prose(rng, n):
    return "".join(rng.choice(SENTENCES).format(w=rng.choice(WHO), t=rng.choice(WHAT), h=rng.choice(HOW)) for _ in range(n))


ENGLISH = ["{w} bought the {t} last month and it feels {h}.", "The {t} stayed at home all week, {w} found it {h}.", "If only the {t} were less {h}, said {w}.", "On the way back {w} dropped the {t}, yet it is still {h}."]


def english(rng, n):
    pick = lambda s: rng.choice(s.split())
    return " ".join(rng.choice(ENGLISH).format(w=pick("I we they someone"), t=pick("lamp bag keyboard cup phone"), h=pick("solid light quiet heavy plain")) for _ in range(n))


def terms(text):
    text = re.sub("[0-9]+", "0", text.lower())
    out = []
    for m in re.finditer(r"[一-鿿]+|[^\W\d_一-鿿]+|0", text):
        s = m.group()
        out += [s[i : i + 2] for i in range(len(s) - 1)] if "一" <= s[0] <= "鿿" else [s]
    return out


def test_curves_against_python(spark):
    rng = random.Random(1)
    texts = [prose(rng, k) for k in (3, 5, 8)] + ["Some English words, some more words and 12 numbers 13 " * 4, "短", "", None]
    got = {r.doc_id: r for r in pages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        c = Counter(terms(t or ""))
        n = sum(c.values())
        assert (i in got) == (n >= LEAST)
        if n < LEAST:
            continue
        assert {(x.w, x.k) for x in got[i].terms} == set(c.items()) and got[i].n == n
        y = np.log(sorted(c.values(), reverse=True))
        x = np.log(np.arange(1, len(y) + 1))
        slope, at = np.polyfit(x, y, 1)
        assert math.isclose(got[i].slope, slope, abs_tol=1e-9)
        assert math.isclose(got[i].residual, np.sqrt(np.mean((y - at - slope * x) ** 2)), abs_tol=1e-6)


def test_kinds(spark):
    rng = random.Random(2)
    rows, bad = [], set()
    for i in range(500):
        rows.append((i, (english if i % 4 == 0 else prose)(rng, rng.randint(3, 25))))
    tails = ["哪家强", "低价", "直销", "现货", "榜单", "测试版", "折扣码"]
    for i in range(500, 530):
        t = rng.choice(WHAT)
        kind = i % 3
        body = [t + rng.choice(tails) for _ in range(40)] if kind == 0 else [f"http://a{rng.randint(1, 99)}.example/tag-{rng.randint(1, 9999)}" for _ in range(30)] if kind == 1 else [f"#{rng.choice(WHAT)}{rng.choice(tails)}#" for _ in range(40)]
        rows.append((i, (prose(rng, 1) if i % 2 else "") + "，".join(body)))
        bad.add(i)
    rows.append((600, prose(rng, 6) + "冲啊冲啊，别停下，" * 8 + prose(rng, 6)))
    rows += [(601, None), (602, ""), (603, " \n"), (604, "好"), (605, prose(rng, 3000)), (500, rows[500][1])]
    got = [r.doc_id for r in scored(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("found").collect()]
    assert set(got) == bad
    assert scored(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
