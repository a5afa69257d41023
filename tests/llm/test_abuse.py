"""The machine against its definition, and made-up labelled texts whose labels need pairs of terms."""

import random

import numpy as np
import pyarrow as pa  # noqa: F401

from voxgrid.llm import abuse

GROUPS, INSULTS, THINGS = ["新手", "外乡客", "左撇子", "高个子"], ["笨蛋", "傻瓜", "饭桶"], ["音箱", "背包", "键盘", "台灯"]
PLAIN = ["{t}用了三天很顺手", "店家说{t}明天发货", "我把{t}放在家里", "这个{t}的颜色不错", "{g}也能用{t}", "推荐{g}先看说明", "给{g}的建议都写在里面", "有人骂我{i}，已经举报了", "剧情里喊了句{i}，配音很稳"]
BAD = ["{g}都是{i}", "让{g}闭嘴，一群{i}", "你就是个{i}，快走开"]


def made(rng, n):
    out = []
    for _ in range(n):
        fill = lambda f: f.format(t=rng.choice(THINGS), g=rng.choice(GROUPS), i=rng.choice(INSULTS))
        parts = [fill(rng.choice(PLAIN)) for _ in range(rng.randint(1, 4))]
        bad = rng.random() < 0.25
        if bad:
            parts.insert(rng.randint(0, len(parts)), fill(rng.choice(BAD)))
        out.append(("。".join(parts) + "。", int(bad)))
    return out


def test_logit_against_definition():
    m = abuse.Machine()
    rng = np.random.default_rng(1)
    m.linear[:] = rng.normal(size=m.linear.shape)
    start, feat = abuse.terms(["笨蛋 abc", "x", "", "左撇子都是笨蛋"])
    got = m.raw(start, feat)
    for i in range(4):
        f = feat[start[i] : start[i + 1]]
        x = 1 / np.sqrt(max(len(f), 1))
        want = m.bias + x * m.linear[f].sum() + x * x * sum(m.pair[a] @ m.pair[b] for k, a in enumerate(f) for b in f[k + 1 :])
        assert np.isclose(got[i], want if len(f) else -30.0, atol=1e-3)
        assert len(set(f.tolist())) == len(f)


def test_held_out_with_wrong_labels():
    rng = random.Random(2)
    train, held = made(rng, 1500), made(rng, 500)
    y = np.array([1 - v if rng.random() < 0.03 else v for _, v in train])
    got = abuse.Scorer(abuse.fitted([t for t, _ in train], y)).scores([t for t, _ in held]) >= abuse.CASE
    want = np.array([v for _, v in held], bool)
    assert (got & want).sum() / want.sum() > 0.97 and (got & want).sum() / got.sum() > 0.97


def test_disguises():
    for a, b in [("下*三 滥", "下三滥"), ("渣　渣", "渣渣"), ("ＩＤＩＯＴ", "idiot"), ("1d10t", "idiot"), ("n*ked", "nked"), ("dаmn", "damn")]:
        assert abuse.plain(a) == b


def test_frame(spark, monkeypatch):
    rng = random.Random(3)
    m = made(rng, 800)
    machine = abuse.fitted([t for t, _ in m], np.array([v for _, v in m]))
    rows = [(1, "左撇子都是饭桶", "z"), (2, None, "z"), (3, "", "z"), (4, "👍🔥", "z"), (5, "我把台灯放在家里。" * 5000, "z"), (1, "左撇子都是饭桶", "z")]
    df = spark.createDataFrame(rows, "row_id long, text string, score_of string")
    got = abuse.scored(df, "text", machine).collect()
    assert sorted(r.row_id for r in got if r.score >= abuse.CASE) == [1, 1]
    assert {r.score for r in got if r.row_id in (2, 3)} == {0.0}
    assert abuse.scored(df.limit(0), "text", machine).count() == 0
    assert {r.score for r in abuse.scored(df, "text", None).collect()} == {0.0}
    assert abuse.fitted([], np.array([])) is None and abuse.fitted(["a"], np.array([1])) is None
    monkeypatch.setattr(abuse, "KEPT", 2)
    small = abuse.Scorer(machine).scores([r[1] for r in rows])
    assert np.allclose(small, abuse.Scorer(machine).scores([r[1] for r in rows]))
