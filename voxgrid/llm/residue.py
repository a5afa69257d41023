"""Template residue and error-page text in place of what a person wrote.

Method: texts are cut into units, and the units of all records are aligned. Units that share their
first or last characters form a group; what all units of a group have in common at their beginning
and at their end is its frame, and what lies between, where the units differ, is an induced slot. The
common parts come from the least and the greatest unit of a group and of the units reversed, so a group
is never gathered. A slot that others fill with ordinary values is residue where it holds a raw missing
value, a name in signs, the name of a field, or nothing at all. Error pages are found the same way as
whole pages: a page that many records repeat word for word, in the impersonal words of a system.

An exact check of single records follows: placeholders whose syntax no one writes by chance in a frame
that no other record shares, and the wording of notices, where the unit stands, wherever it occurs,
alone on its page and not inside a person's text. p3_evidence counts the fields of each.

Defined results: null and blank fields are no cases; a row with both fields bad gives two rows;
repeated rows are judged alike. Counts cover all rows, a text that recurs counts once except where
repetition is the sign, and nothing is gathered in one task.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.llm.codepoints import points_of, slices, strings_of
from voxgrid.session import staged, table

_NAME = r"[\p{L}_][\p{L}\p{N}_. ]{0,40}"
#: Placeholder syntaxes that no one writes by chance.
STRICT = (
    r"\{\{[^{}]{0,60}\}\}|[$#]\{[^{}]{0,60}\}|\{%[^{}%]{0,60}%\}|<%=?[^<>%]{0,60}%>|<!--[^<>]{0,60}-->|\[\[[^\[\]]{0,60}\]\]"
    rf"|@@[^@\s]{{1,40}}@@|__\p{{L}}[\p{{L}}\p{{N}}_. ]{{0,40}}?__|%{_NAME}%|\${_NAME}\$|\{{[\p{{L}}\p{{N}}_. ]{{0,40}}\}}|&lt;{_NAME}&gt;"
)
#: A name in square brackets may be an emote or a label; it counts where the same name stands in a strict syntax.
BARE = r"\[[\p{L}_][\p{L}\p{N}_.]{0,40}\]"
#: What a missing value or an unfilled format prints.
RAW = r"\[object Object\]|#(?:REF|VALUE|NAME|DIV/0|N/A)[!?]?|(?<![0-9])%[sd](?![A-Za-z0-9])|(?<![A-Za-z0-9_.])(?:undefined|null|None|NaN|nan|nil)(?![A-Za-z0-9_])"
SLOT = rf"(?=[\[%$#{{<@_&uNn])(?:{RAW}|{STRICT}|{BARE})"

#: A frame needs so many characters besides its slot, so many of them in one piece, to be aligned with other units; a slot's value
#: is no longer than LONGEST_VALUE, and one other value may be chance.
LITERAL, ANCHOR, LONGEST_VALUE, FILLS = 6, 4, 40, 2
#: Up to so many frames are broadcast after being counted; more are joined by shuffle.
BROADCAST_FRAMES = 50_000

#: Wording of notices by servers, programs and access checks, and of editing prompts.
_ZH_NOTICES = [
    r"页面(?:不存在|走丢|已?失效|已?被?删除|找不到)", r"访问的(?:页面|内容|网页)", r"秒后(?:自动)?(?:返回|跳转)", r"服务器(?:开小差|错误|繁忙|异常|内部)",
    r"系统(?:繁忙|维护|异常|错误)", r"稍[后候]再?(?:试|重试)", r"请稍[候等]", r"正在(?:加载|跳转|验证)", r"网络(?:连接)?(?:异常|错误|超时|不给力)",
    r"检查(?:您的)?网络", r"(?:没有|无)权限(?:查看|访问)", r"访问(?:过于)?频繁", r"完成验证", r"(?:不是|非)机器人", r"拖动滑块", r"验证码",
    r"请(?:先)?登录", r"登录后(?:查看|继续|访问|可见)", r"(?:启用|开启|打开|支持|禁用了?)\s*(?i:Java\s?Script|脚本|Cookies?)", r"浏览器(?:版本|不支持|过低)",
    r"升级(?:您的)?(?:浏览器|后访问)", r"在(?i:客户端|App)内?打开", r"违反(?:规定|法规)", r"暂时?无法(?:查看|访问|显示)", r"(?:帖子|内容|文章)已?(?:被)?(?:作者|管理员)?(?:删除|下架)",
    r"请求参数", r"(?:代码|错误码)\s*[:：]?\s*-?\d", r"服务(?:超时|不可用|异常)", r"(?:数据库|网关)(?:错误|超时|连接)",
    r"占位(?:文本|文字|内容)?", r"示例(?:文本|文字|内容)", r"(?:这里|此处)是?(?:正文|标题|内容)", r"(?:此处|这里)(?:输入|填写)", r"填写使用感受",
    r"待(?:补充|完善|填写)", r"补充(?:正文|内容)", r"(?:上线|发布)前(?:删除|替换|修改)", r"标题待定",
]
_EN_NOTICE = "|".join([
    r"(?-i:TODO|FIXME|TBD)\b",
    r"page (?:not found|you requested|cannot be|could not be)", r"not found\b", r"could not be located", r"access (?:is )?denied", r"permission denied", r"forbidden",
    r"internal server error", r"unexpected condition", r"bad gateway", r"gateway time-?out", r"service (?:temporarily )?unavailable", r"temporarily unavailable",
    r"too many requests", r"slow down and try", r"try again later", r"establishing a database", r"(?:site|page) can.?t be reached", r"connection was (?:reset|refused)",
    r"isn.?t available right now", r"log ?in to (?:see|view|continue)", r"sign in to (?:see|view|continue)", r"loading,? please wait", r"please wait", r"checking your browser",
    r"verify (?:that )?you are (?:a )?human", r"completing the action below", r"enable (?:java ?script|cookies|scripts)", r"(?:java ?script|cookies) (?:is|are|must be) (?:disabled|required|enabled)",
    r"turn it on and reload", r"browser is (?:out of date|not supported)", r"update it to continue", r"^reference [\d-]+$", r"traceback", r"keyerror|typeerror|nullpointer|stack trace|exception in",
    r"upstream [\d-]+", r"render line \d", r"text goes here", r"insert \w+ here", r"type something", r"replace before publishing", r"placeholder text", r"sample text", r"your \w+ here",
])


def _by_first(branches: list[str], buckets: int = 8) -> str:
    """One pattern whose branches are tried only where their bucket's range of first characters allows.

    A branch that begins with a group of alternatives is one branch for each of them.
    """
    flat = []
    for b in branches:
        if b.startswith("(?:"):
            end = b.index(")")
            flat += [x.rstrip("?") + ("?" if x.endswith("?") else "") + b[end + 1 :] for x in b[3:end].split("|")]
        else:
            flat.append(b)
    flat.sort()
    size = -(-len(flat) // buckets)
    parts = [flat[i : i + size] for i in range(0, len(flat), size)]
    return "|".join(f"(?=[{p[0][0]}-{p[-1][0]}])(?:{'|'.join(p)})" for p in parts)


NOTICE = rf"{_by_first(_ZH_NOTICES)}|(?=[A-Za-z])(?<![A-Za-z])(?i:{_EN_NOTICE})"
#: What pages put around their notices.
CHROME = r"^(?:返回上一页|返回首页|刷新|重试|下载客户端|下载App|Go back|Home|Help|Terms|Retry|Reload|Refresh|Back|Home \| Help \| Terms|[-\d\s.:#|]*|Error \d+|HTTP \d+)$"
#: Words of the usual filler passage.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum"
)
FILLER = "占位 示例 样例 文字 文本 正文 内容 标题 测试 text test sample dummy xxx"
FILLER_WORDS = f"(?:{FILLER.replace(' ', '|')})"
#: Ends of sentences, and of the parts of a sentence. A dot inside a name is neither, nor is a mark of a slot's syntax.
_SENTENCE = r"(?:[。！？；…\r\n]|(?<!&lt|&gt);|(?<!#REF|#VALUE|#DIV/0)!(?!--)|(?<!#NAME)\?)+|\.(?=\s|$)|\.{2,}"
_PART = rf"[，,]|{_SENTENCE}"
_TAG = r"</?(?i:html|head|title|body|center|h[1-6]|hr|p|div|span|br|script|noscript)\b[^<>]*/?>"
_ENVELOPE = r'^\s*\{\s*"(?:code|status|errno|error)"\s*:.*?"(?:message|msg|error)"\s*:\s*"(.*)"\s*,\s*"data"\s*:\s*(?:null|\{\}|\[\])\s*\}[。.]?\s*$'


def _units(text: Column, cut: str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "(?is)" + _ENVELOPE, "$1"), _TAG, "\n")
    units = F.transform(F.split(plain, cut), lambda u: F.regexp_replace(u, r"^[\s\p{Z}【】]+|[\s\p{Z}【】]+$", ""))
    return F.filter(units, lambda u: u != "")


def _key(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(u), "[0-9]+", "0"), r"^0 -? ?", "")


def _lorem(u: Column) -> Column:
    words = F.filter(F.split(F.lower(u), r"[^\p{L}]+"), lambda w: w != "")
    known = F.array(*[F.lit(w) for w in LOREM.split()])
    return (F.size(words) >= 4) & (F.size(F.filter(words, lambda w: F.array_contains(known, w))) >= 0.7 * F.size(words))


def _plain(u: Column) -> Column:
    return F.regexp_replace(F.lower(u), "[0-9]+", "0")


def _filled(units: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames whose slot holds FILLS different ordinary values in units of (u). frames: (frame, raw), of one slot each.

    Units and frames meet by the first or the last ANCHOR characters.
    """
    before, after = F.substring_index("frame", "□", 1), F.substring_index("frame", "□", -1)
    sides = frames.where(F.size(F.split("frame", "□")) == 2).select("frame", before.alias("before"), after.alias("after"), "raw")
    sides = sides.where((F.length("before") + F.length("after") >= LITERAL) & (F.greatest(F.length("before"), F.length("after")) >= ANCHOR) & (~F.col("raw") | ((F.col("before") != "") & (F.col("after") != ""))))
    head = F.length("before") >= ANCHOR
    sides = staged(sides.select("frame", "before", "after", F.when(head, F.concat(F.lit("<"), F.left("before", F.lit(ANCHOR)))).otherwise(F.concat(F.lit(">"), F.right("after", F.lit(ANCHOR)))).alias("at")), "frames")
    n = sides.count()
    if not n:
        return sides.select("frame")
    units = units.select("u", _plain(F.col("u")).alias("plain"))
    units = units.select("u", "plain", F.explode(F.array(F.concat(F.lit("<"), F.left("plain", F.lit(ANCHOR))), F.concat(F.lit(">"), F.right("plain", F.lit(ANCHOR))))).alias("at"))
    near = units.join(F.broadcast(sides) if n <= BROADCAST_FRAMES else sides, "at")
    near = near.where(F.startswith("plain", F.col("before")) & F.endswith("plain", F.col("after")) & ~F.col("u").rlike(SLOT))
    room = F.length("plain") - F.length("before") - F.length("after")
    value = F.trim(F.substring(F.col("plain"), F.length("before") + 1, F.greatest(room, F.lit(0))))
    values = near.where((room > 0) & (room <= LONGEST_VALUE)).select("frame", value.alias("value")).where("value <> ''")
    return values.groupBy("frame").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= FILLS).select("frame")


#: Blanks, and signs that end a unit; a dot does at the end of a word or doubled.
_SPACES = np.array([9, 32, 0xA0, 0x3000, *range(0x2000, 0x200B)])
_SIGNS = np.array([ord(c) for c in "，,。！？；…;!?\r\n"])
#: Lengths of the first or last characters by which units meet, longest values of a slot and least characters of its frame.
ANCHORS, SLOT_VALUE, FRAME = (3, 6, 11), 24, 3
#: A raw missing value needs so many characters of frame, on both of its sides.
RAW_FRAME = 6
#: Words for fields of a form or a record, of which a variable's name is made.
FIELD_WORDS = (
    "用户 姓名 昵称 名称 名字 账号 商品 产品 品牌 型号 价格 金额 数量 单价 日期 时间 地址 城市 省份 地区 电话 手机 号码 邮箱 订单 编号 单号 快递 公司 店铺 标题 内容 作者 链接 收件人 客户 会员 变量 字段 默认值 占位 名 号 "
    "user name username first last full nickname customer client member product item brand model price amount total quantity date time year city state country address phone mobile number email order id company store title subject author link url value field default variable placeholder your"
)
_FIELD = "|".join(sorted(FIELD_WORDS.split(), key=lambda w: (-len(w), w)))
#: The name of a field: of two words or more, or of one that readers don't talk about.
FIELD_NAME = rf"^(?:(?:(?:{_FIELD})[\s_.-]*){{2,}}|姓名|昵称|收件人|变量|字段|默认值|占位|username|firstname|lastname|placeholder)$"
#: A name in signs, whatever the signs, and the signs that people don't write around a word.
CODED = r"[{}<>%$|&=\\^]|^[^\p{L}\p{N}\s#!！?？~～。.…—-]{2}"
SIGNED = r"^[^\p{L}\p{N}\s,，、'’.-]{1,4}\s*[\p{L}_][\p{L}\p{N}_. |-]*\s*[^\p{L}\p{N}\s,，、'’.-]{1,4}$"
#: Places where a reader sees that a value is missing: a blank before a mark, two blanks in a line, empty brackets.
HOLE = r"(?=[ (（“「【《:：])(?:(?<=[\p{L}\p{N}]) [,，。;；!！?？](?:\s|$)|(?<=[\p{L}\p{N},]) {2,}[\p{L}\p{N}]|\(\s*\)|（\s*）|“\s*”|「\s*」|【\s*】|《\s*》|(?<=\p{L})[:：]\s*(?:[,，。;；]|\n))"
#: Units of a template that fill their slot mostly with values of their own: records of a unit, on average.
OWN_VALUES = 1.5
#: A page repeated so often, in so many words of a system and none of a person's, is an error page.
REPEATED, SYSTEM_WORDS = 5, 2
_SYSTEM = (
    r"错误|失败|异常|失效|无法|页面|访问|请求|加载|服务|服务器|系统|网络|登录|验证|权限|浏览器|资源|节点|线路|超时|中断|拥堵|维护|刷新|重试|跳转|响应|连接|会话|过期|就绪|状态|编号|代码|接口|终端|稍[后候]|请|您"
    r"|(?i)\b(?:error|failed|failure|page|request(?:ed)?|server|access|browser|session|expired|unavailable|time(?:d )?out|denied|invalid|loading|load|resource|gateway|connection|network|unable|could not|cannot|please|refresh|retry|code|status|node|response)\b"
)
_PERSON = r"我|俺|咱|他|她|吧|啊|呢|呀|哈|嘛|又|老是|真|太|觉得|感觉|(?i)\b(?:i|my|me|we|our|he|she|really|just|lol|love|hate|nice|great)\b"


def _common(a: Column, b: Column) -> Column:
    """The length of the common beginning of two strings."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(differ, False)
    return F.when(at > 0, at - 1).otherwise(F.length(a)).cast("int")


def _anchored(units: DataFrame) -> DataFrame:
    """units with the keys by which they meet, one row each."""
    u = F.col("u")
    keys = [F.when(F.length(u) >= k, F.concat(F.lit("<"), F.left(u, F.lit(k)))) for k in ANCHORS] + [F.when(F.length(u) >= k, F.concat(F.lit(">"), F.right(u, F.lit(k)))) for k in ANCHORS]
    return units.select("*", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("at"))


def slots(units: DataFrame) -> DataFrame:
    """(u, kind): the units of (u, n) whose induced slot holds residue; n is the number of records of a unit.

    kind: raw, signed, name, or blank; blanks need a look at their record.
    """
    group = _anchored(units).groupBy("at").agg(
        F.min("u").alias("a"), F.max("u").alias("b"), F.min(F.reverse("u")).alias("ra"), F.max(F.reverse("u")).alias("rb"),
        F.min(F.length("u")).alias("short"), F.max(F.length("u")).alias("long"), F.count("*").alias("units"), F.sum("n").alias("records"), F.max("n").alias("most"),
    ).where("units > 1")
    group = group.withColumn("head", F.least(_common(F.col("a"), F.col("b")), F.col("short"))).withColumn("tail", F.least(_common(F.col("ra"), F.col("rb")), F.col("short") - F.col("head")))
    group = group.where((F.col("head") + F.col("tail") >= FRAME) & (F.col("long") - F.col("head") - F.col("tail") <= SLOT_VALUE) & (2 * (F.col("head") + F.col("tail")) >= F.col("long") - F.col("head") - F.col("tail")))
    group = staged(group.select("at", "a", "ra", "short", "head", "tail", "units", "records", "most"), "groups")
    own = (F.col("records") - F.col("n")) / (F.col("units") - 1) <= OWN_VALUES
    # blank: the unit that is nothing but the frame
    frame = F.when(F.length("a") == F.col("short"), F.col("a")).otherwise(F.reverse("ra"))
    blank = group.where((F.col("head") + F.col("tail") == F.col("short"))).select(F.concat(F.left("a", F.col("head")), F.reverse(F.left("ra", F.col("tail")))).alias("u"), "records", "units")
    blank = blank.where(F.length("u") >= FRAME).join(units, "u").where(own & (F.col("n") < F.col("units"))).select("u", F.lit("blank").alias("kind"))
    # the others hold the sign of it somewhere, whatever their frame
    some = units.where(F.col("u").rlike(rf"(?i)(?:{RAW})|[\[\]{{}}<>%$#@_=&^|~]|{_FIELD}"))
    near = _anchored(some).join(group, "at")
    value = F.trim(F.substring(F.col("u"), F.col("head") + 1, F.length("u") - F.col("head") - F.col("tail")))
    near = near.withColumn("value", value).where("value <> ''").withColumn("others", F.col("units") - 1)
    raw = F.col("value").rlike(f"(?i)^(?:{RAW})$") & (F.col("head") > 0) & (F.col("tail") > 0) & (F.col("head") + F.col("tail") >= RAW_FRAME)
    name = F.col("value").rlike(FIELD_NAME) & (F.col("n") == F.col("most")) & own
    kind = F.when(raw, "raw").when(F.col("value").rlike(SIGNED) & F.col("value").rlike(CODED) & ~F.col("value").rlike(f"^{BARE}$") & (F.col("head") + F.col("tail") >= RAW_FRAME), "signed").when(name, "name")
    held = near.where("others >= 2").select("u", kind.alias("kind")).where("kind is not null")
    return held.unionByName(blank).groupBy("u").agg(F.collect_set("kind").alias("kinds"))


def parts(texts: DataFrame) -> DataFrame:
    """(k, field, hole, size, u): the units of (k, field, text) as they are aligned, in lower case and without blanks between Han
    characters; hole: whether the text shows one, size: its units. Whole batches are cut at once."""
    ids = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in ("k", "field"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 3):
                cps, row = points_of(part.column(3))
                n = len(cps)
                if not n:
                    continue
                at = np.arange(n)
                change = np.append(True, row[1:] != row[:-1])
                space = np.isin(cps, _SPACES)
                last = np.append(change[1:], True)
                follow = np.append(cps[1:], 32)
                sign = np.isin(cps, _SIGNS) | ((cps == 46) & (last | np.isin(follow, _SPACES) | (follow == 46)))
                sign |= (cps == 46) & np.append(False, (cps[:-1] == 46) & ~change[1:])
                unit = np.cumsum(change | np.append(False, sign[:-1])) - 1
                content = np.flatnonzero(~space & ~sign & (cps != 0x3010) & (cps != 0x3011))
                units, first = np.unique(unit[content], return_index=True)
                if not len(units):
                    continue
                begin, end = np.full(unit[-1] + 1, n), np.full(unit[-1] + 1, -1)
                begin[units] = content[first]
                end[units] = content[np.append(first[1:], len(content)) - 1]
                han = (cps >= 0x3400) & (cps <= 0x9FFF)
                before = np.maximum.accumulate(np.where(space, 0, at))
                after = np.minimum.accumulate(np.where(space, n - 1, at)[::-1])[::-1]
                keep = ~sign & (at >= begin[unit]) & (at <= end[unit]) & ~(space & han[before] & han[after])
                number = np.full(unit[-1] + 1, 0)
                number[units] = np.arange(len(units))
                u = strings_of(cps[keep], number[unit[keep]], pa.array(np.zeros(len(units), np.int8)))
                of = row[begin[units]]
                size = np.bincount(of, minlength=part.num_rows)[of]
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(of) for i in range(3)], pa.array(size.astype(np.int32)), u], ["k", "field", "hole", "size", "u"])

    rows = texts.select("k", "field", F.col("text").rlike(HOLE).alias("hole"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, f"{ids}, hole boolean, size int, u string")


def induced(pieces: DataFrame, units: DataFrame) -> DataFrame:
    """(k, field) of the fields with residue in an induced slot.

    pieces: the units of the fields, as parts() gives them. units: (u, n), the distinct ones and how many there are.

    A blank counts where the reader sees the hole, or in a record that is nothing but template: two blank slots or more
    in half of its units, and for the rest units that other records hold as well.
    """
    held = staged(slots(units).join(units, "u"), "held")
    rows = pieces.join(held, "u").groupBy("k", "field").agg(
        F.max(F.size(F.array_except("kinds", F.array(F.lit("blank")))) > 0).alias("full"), F.max("hole").alias("hole"), F.sum(F.array_contains("kinds", "blank").cast("int")).alias("blanks"), F.max("size").alias("size"),
    )
    sure = F.col("full") | ((F.col("blanks") > 0) & F.col("hole"))
    rows = staged(rows.where(sure | ((F.col("blanks") > 1) & (2 * F.col("blanks") >= F.col("size")))).withColumn("sure", sure), "blanks")
    fixed = pieces.join(rows.where("not sure").select("k", "field"), ["k", "field"], "left_semi").join(units, "u").join(held.select("u", F.lit(True).alias("slot")), "u", "left")
    fixed = fixed.groupBy("k", "field", "size").agg(F.count_if(F.col("slot") | (F.col("n") > 1)).alias("known")).where("known = size").select("k", "field")
    return rows.where("sure").select("k", "field").unionByName(fixed)


def repeated_pages(texts: DataFrame) -> DataFrame:
    """(k, field) of the fields of (k, field, text) that are a page which many repeat word for word, in a system's words."""
    rows = texts.select("k", "field", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    many = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED).select("h1", "h2")
    page = _plain(F.col("text"))
    words = F.size(F.array_distinct(F.regexp_extract_all(page, F.lit(f"({_SYSTEM})"), F.lit(1))))
    return rows.join(many, ["h1", "h2"]).where((words >= SYSTEM_WORDS) & ~page.rlike(_PERSON)).select("k", "field")


def evidence(df: DataFrame, key: str, fields: list[str], bare: bool = False) -> DataFrame:
    """(key, field, evidence) of the fields of df that hold residue, filler, an error message or a notice.

    evidence: slot and page come from aligned records, filler, notice and syntax from the exact check of single ones.
    bare: leave out slots that show as residue by alignment alone (blanks, names of fields, repeated pages).
    """
    texts = df.select(F.col(key).alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"))
    texts = texts.select("k", "x.field", "x.text").where(F.col("text").rlike(r"[^\s\p{Z}]"))
    notice, chrome = NOTICE, f"(?i){CHROME}"
    pieces = staged(parts(texts), "parts")
    units = staged(pieces.groupBy("u").agg(F.count("*").alias("n")), "alignable")
    aligned = [] if bare else [induced(pieces, units).withColumn("evidence", F.lit("a slot")), repeated_pages(texts).withColumn("evidence", F.lit("b page"))]
    # the exact check: most fields hold no sign of any of this, and patterns over the whole text spare them the cutting into units
    low = F.lower("text")
    holds = lambda words: functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in words.split()])
    lorem = holds("lorem ipsum dolor amet consectetur adipiscing incididunt aliqua nostrud ullamco commodo")
    texts = texts.where(holds(FILLER) | lorem | F.contains(low, F.lit("<html")) | F.startswith(F.ltrim("text"), F.lit("{")) | F.col("text").rlike(notice) | F.col("text").rlike(SLOT))
    seen = texts.select("k", "field", "text", _units(F.col("text"), _SENTENCE).alias("ss"), _units(F.col("text"), _PART).alias("us"))
    page = F.col("text").rlike(r"(?is)^\s*<html\b.*</html>") | F.col("text").rlike("(?is)" + _ENVELOPE)
    repeated = F.col("text").rlike(r"(?s)^\s*(\S.{0,12}?\S\s{0,3})\1{3,}.{0,14}$") & F.col("text").rlike(f"(?i){FILLER_WORDS}")
    rows = seen.select(
        "k", "field", page.alias("page"), repeated.alias("repeated"),
        F.exists("ss", _lorem).alias("lorem"),
        F.forall("ss", lambda u: u.rlike(notice) | u.rlike(chrome)).alias("alone"),
        F.forall("ss", lambda u: u.rlike(SLOT)).alias("template"), F.sha2("text", 256).alias("hash"),
        F.concat(
            F.transform(F.filter("ss", lambda u: u.rlike(notice)), lambda u: F.struct(u.alias("u"), F.lit(True).alias("cue"))),
            F.transform(F.filter("us", lambda u: u.rlike(SLOT)), lambda u: F.struct(u.alias("u"), F.lit(False).alias("cue"))),
        ).alias("us"),
    ).where("page or repeated or lorem or size(us) > 0")
    rows = rows.select("k", "field", "page", "repeated", "lorem", "alone", "template", "hash", F.explode_outer("us").alias("x"))
    rows = staged(rows.select("k", "field", "page", "repeated", "lorem", "alone", "template", "hash", F.col("x.u").alias("u"), F.coalesce("x.cue", F.lit(False)).alias("cue"), F.col("x.cue").eqNullSafe(False).alias("slot")), "units")

    whole = rows.where("page or repeated or lorem").select("k", "field", F.when(F.col("page"), "d notice").otherwise("c filler").alias("evidence"))

    # notices: the unit stands on a page of its own in most of the fields that hold it
    cues = rows.where("cue").select("k", "field", "alone", _key(F.col("u")).alias("key")).distinct()
    pages = cues.groupBy("key").agg(F.avg(F.col("alone").cast("int")).alias("rate"))
    notices = cues.join(pages.where("rate >= 0.5"), "key").select("k", "field", F.lit("d notice").alias("evidence"))

    # slots: aligned records fill the same slot differently
    marks = rows.where("slot").select("k", "field", "template", "hash", F.lower(F.regexp_replace("u", SLOT, "□")).alias("frame"), F.explode(F.regexp_extract_all("u", F.lit(f"({SLOT})"), F.lit(1))).alias("fill"))
    marks = marks.withColumn("frame", F.regexp_replace(F.regexp_replace("frame", "[0-9]+", "0"), r"(?<=\p{IsHan})[\s\p{Z}]+(?=\p{IsHan})", "")).withColumn("strict", F.col("fill").rlike(f"^(?:{STRICT})$")).withColumn("bare", F.col("fill").rlike(f"^{BARE}$") & (F.col("fill") != "[object Object]"))
    marks = marks.withColumn("name", F.regexp_replace("fill", r"^[\[\]{}<>%$#@_=!&;\-\s]+(?:lt;)?|\|[^|]*$|(?:&gt;)?[\[\]{}<>%$#@_=!&;\-\s]+$", ""))
    names = marks.where("strict and name <> ''").select("name").distinct().withColumn("known", F.lit(True))
    marks = marks.join(names, "name", "left").where("not bare or known")
    marks = staged(marks, "marks")
    raw = F.max((~F.col("strict")).cast("int")) == 1
    by_text = marks.groupBy("frame", "hash").agg(F.min("fill").alias("lo"), F.max("fill").alias("hi"), F.max(F.col("template").cast("int")).alias("template"), raw.alias("raw"))
    frames = by_text.groupBy("frame").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.avg("template").alias("whole"), F.bool_or("raw").alias("raw"))
    filled = _filled(units, frames.where("lo = hi and frame <> '□' and (n > 1 or raw)").select("frame", "raw")).withColumn("filled", F.lit(True))
    held = marks.join(frames.drop("raw"), "frame").join(filled, "frame", "left")
    by_others = F.coalesce((F.col("lo") != F.col("hi")) | (F.col("filled") & ~F.col("bare")), F.lit(False))
    held = held.where(by_others | F.expr("((n = 1 or whole >= 0.5) and strict and name <> '') or frame = '□'")).select("k", "field", F.when(by_others, "a slot").otherwise("e syntax").alias("evidence"))
    found = functools.reduce(DataFrame.unionByName, [*aligned, whole, notices, held]).groupBy("k", "field").agg(F.min("evidence").alias("evidence"))
    return found.select(F.col("k").alias(key), "field", F.substring("evidence", 3, 10).alias("evidence"))


def flagged(df: DataFrame, key: str, fields: list[str], bare: bool = False) -> DataFrame:
    """(key, field) of the fields of df that hold residue, filler, an error message or a notice. bare: see evidence."""
    return evidence(df, key, fields, bare).select(key, "field")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles and contents of posts that are a template's, a server's or an access check's."""
    return flagged(table(spark, sf_dir, "posts", "post_seq", "title", "content"), "post_seq", ["title", "content"])


def p3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found fields per field and evidence: how many come from aligned records, how many from single ones."""
    got = evidence(table(spark, sf_dir, "posts", "post_seq", "title", "content"), "post_seq", ["title", "content"])
    return got.groupBy("field", "evidence").agg(F.count("*").alias("fields"))
