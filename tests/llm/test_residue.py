"""Template residue on small tables whose cases are known."""

from voxgrid.llm.residue import flagged

TEMPLATES = ["欢迎来到{}的主页。", "您好{}，您关注的商品已到货。", "Only {} left in stock."]
FILLS = ["{{ user.city }}", "undefined", "%nick_name%", "${价格}", "[价格]", "[object Object]", "#REF!", "&lt;price&gt;", "<!-- YOUR NAME HERE -->"]
NOTICES = ["系统繁忙，请稍后再试", "502 - Bad Gateway\nGo back", "Please enable JavaScript to view this page.", '{"code":-7,"message":"网络连接异常，请检查网络设置后重试","data":null}',
           "<html><head><title>出错了</title></head><body><center>出错了</center><hr></body></html>", "请在此处输入正文", "Lorem ipsum dolor sit amet, elit sed magna.", "占位文本" * 9, "test " * 8]
PEOPLE = ["写模板的时候大括号{{ }}渲染不出来。", "表格里显示NaN原来是我公式写错。", "抽奖页要开JavaScript才能点，折腾了半天。", "好看[笑哭]", "好看[点赞]", "No one here, None of us.", "到手很满意，音质不错。", "哈哈哈哈哈哈哈哈", "用的是[RT1234]这款"]


def test_cases(spark):
    bad = [t.format(f) for t in TEMPLATES for f in FILLS] + NOTICES
    bad += ["音质很好。" + TEMPLATES[0].format("null")]
    good = [p + extra for p in PEOPLE for extra in ("", "昨天又用了一次。", "物流很快！")]
    rows = [(i, t, None, "x") for i, t in enumerate(bad + good)]
    rows += [(9000, None, "", "x"), (9001, "  ", None, "x"), (9002, "很好，" * 20000, None, "x"), (0, bad[0], None, "x")]
    df = spark.createDataFrame(rows, "k long, title string, content string, field string")
    got = {(r.k, r.field) for r in flagged(df, "k", ["title", "content"]).collect()}
    assert got == {(i, "title") for i in range(len(bad))}
    assert flagged(df.limit(0), "k", ["title", "content"]).count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, content string")
    return {r.k for r in flagged(df, "k", ["content"]).collect()}


def test_constant_fills(spark):
    once = ["Dear {{username}} of the shop"]
    assert found(spark, once) == {0} and found(spark, once * 3) == {0, 1, 2}  # copies
    whole = [f"Dear {{{{username}}}} thanks for order {i}. " for i in range(5)]
    assert found(spark, whole) == set(range(5))
    leaks = [f"Welcome back {{{{username}}}} to the shop. {x}" for x in ("It rains.", "Nice lamp.", "No news.")] + ["亲爱的用户undefined您的包裹已到，请取件"]
    ordinary = ["Welcome back Anna to the shop. Hi.", "Welcome back Bob to the shop. Ok.", "亲爱的用户小王您的包裹已到，好", "亲爱的用户小李您的包裹已到，好"]
    assert found(spark, leaks + ordinary) == set(range(4))
    quotes = [f"My template kept printing {{{{ name }}}} until I fixed the config. {x}" for x in ("It rains.", "Nice lamp.")] + ["表格里显示NaN原来是我公式写错。好"]
    assert found(spark, quotes + ordinary) == set()


def test_induced_slots(spark):
    """Slots from aligned records, whatever their syntax: blanks, names of fields, signed names; and repeated pages of errors."""
    blank = ["尊敬的张三，您的订单8812已发货。", "尊敬的李四，您的订单990已发货。", "尊敬的，您的订单已发货。"]
    assert found(spark, blank + PEOPLE) == {2}
    english = ["Dear Anna, your parcel 77 has left the depot.", "Dear , your parcel has left the depot."]
    assert found(spark, english + PEOPLE) == {1}
    names = [f"亲爱的{n}，感谢您购买{p}，欢迎再来。" for n, p in (("王小明", "台灯"), ("赵一", "背包"), ("孙丽", "水杯"), ("用户姓名", "商品名称"), ("用户姓名", "商品名称"), ("用户姓名", "商品名称"))]
    assert found(spark, names + PEOPLE) == {3, 4, 5}
    signed = [f"Your ticket for {x} is confirmed" for x in ("Lisbon", "Oslo", "Rome", "*|DESTINATION|*")]
    assert found(spark, signed + PEOPLE) == {3}
    pages = ["当前线路拥堵，资源节点暂未就绪"] * 50 + ["真的太好看了"] * 50 + ["服务器又异常了，我登录失败三次"] * 50
    assert found(spark, pages + PEOPLE) == set(range(50))


def test_alike_people(spark):
    """Sentences of people that share their beginnings and ends are no templates."""
    likes = [f"我觉得{a}{b}不错" for a in ("音质", "物流", "做工", "价格", "包装") for b in ("真的", "", "也")] * 3
    likes += [f"这个{t}用了{n}天，{a}很好" for t in ("键盘", "台灯") for n in (3, 12) for a in ("手感", "价格", "")]
    assert found(spark, likes) == set()
