"""Personal information inside free text, found and replaced by typed placeholders.

Method: a linear-chain conditional random field over word-shape features. It is trained on a small
labelled table (labelled.py) once per driver process and travels to the workers as a broadcast of
fixed size. Texts are cut into clauses; the clauses of a batch become arrays of tokens (single Han
characters, words, numbers, signs), their features are hashed with array operations, and the best
label paths of all clauses are decoded together by Viterbi, one numpy step per token position. Numbers
count by their length only, so clauses that differ only in digits are decoded once.

An exact check follows on the spans: digits and dates of numbers, the parts of an email address, and
toll-free numbers. Defined results: null and empty texts hold nothing; repeated rows are judged alike;
texts of any length are read whole, and what isn't private stays as it is, character by character.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.llm import labelled
from voxgrid.session import table

TAGS = "EPIAN"
KINDS = {"E": "email", "P": "phone", "I": "id_number", "A": "address", "N": "person_name"}
LABELS = ["O", *[p + t for t in TAGS for p in "BI"]]
#: Feature space, training passes, step size and weight decay.
SPACE, PASSES, STEP, DECAY = 1 << 17, 12, 0.25, 2e-6
#: Clauses whose spans a worker keeps; when full it starts over.
KEPT = 200_000

#: Words and characters by the role they often play.
ROLES = {
    "street": "路 街 道 巷 弄 里 苑 村 镇 乡 区 县 市 省 road street lane avenue close court drive ave st rd way place terrace falls hill",
    "unit": "号 栋 幢 室 楼 单 元 组 院 层 座 flat unit apt floor box po apartment suite",
    "count": "一 二 三 四 五 六 七 八 九 十 百 零 幺 〇",
    "mail": "at dot com org net cn example test",
    "title": "女 先 小 师 老 同 ms mr mrs dear",
}
_SIGN = {c: i for i, c in enumerate("@.-_()+:[]/,'#！，。：*&", 1)}
_SPLIT = re.compile(r"([。！？～；…\n\r]+|，|(?<=[A-Za-z0-9]{2})[!?;]+\s|(?<=[a-z0-9]{2})\.\s(?=[A-Z])|,\s(?=(?:and|but|so|still|while|which|then)\b))")
_DIGIT = re.compile(r"[0-9]")
_CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2,3}(?=[0-9]{3})")


@functools.cache
def _fold_table() -> dict[int, str | None]:
    """One-to-one replacements of wide forms, spaces and look-alike letters; invisible characters go."""
    from voxgrid.llm.lookalike import SAME_SHAPE

    out: dict[int, str | None] = {ord(x[0]): x[1] for x in SAME_SHAPE.split()}
    for cp in [*range(0x80, 0x3100), *range(0xFE00, 0x10000)]:
        ch = chr(cp)
        if unicodedata.category(ch) == "Zs":
            out[cp] = " "
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            out[cp] = None
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) and ch not in "！，？；：（）～":
            new = unicodedata.normalize("NFKC", ch)
            if len(new) == 1:
                out[cp] = new
        elif 0x2F00 <= cp <= 0x2FD5:
            out[cp] = unicodedata.normalize("NFKC", ch)
    return out


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and the place of each in the original where places differ."""
    t = _fold_table()
    new = text.translate(t)
    if len(new) == len(text):
        return new, None
    return new, [i for i, ch in enumerate(text) if t.get(ord(ch), ch) is not None]


class Tokens:
    """The tokens of many clauses as arrays."""

    def __init__(self, clauses: list[str]):
        whole = "\n".join(clauses)
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
        digit = (cps >= 48) & (cps <= 57)
        letter = ((low >= 97) & (low <= 122)) | ((cps >= 0xC0) & (cps < 0x250))
        han = (cps >= 0x3400) & (cps < 0xA000)
        space = (cps == 32) | (cps == 9)
        kind = np.select([digit, letter, han, space, cps == 10], [1, 2, 3, 4, 5], 6)
        start = np.ones(len(cps), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3) | (kind[1:] >= 5)
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(cps)))
        k = kind[at]
        keep = (k != 4) & (k != 5)
        place = np.arange(len(cps)) - np.repeat(at, size)
        power = np.cumprod(np.full(64, 1_000_003, np.uint64))
        value = np.where(digit, 48, low).astype(np.uint64) * power[np.minimum(place, 63)]
        word = np.add.reduceat(value, at) if len(at) else value
        upper = (cps[at] >= 65) & (cps[at] <= 90)
        last_upper = (cps[np.maximum(at + size - 1, 0)] >= 65) & (cps[np.maximum(at + size - 1, 0)] <= 90) if len(at) else upper
        shape = np.select(
            [k == 1, k == 3, (k == 2) & upper & (size == 1), (k == 2) & upper & last_upper, (k == 2) & upper, k == 2],
            [10 + np.minimum(size, 25), 1, 2, 3, 4, 5], 6,
        )
        for c, i in _SIGN.items():
            shape[(k == 6) & (cps[at] == ord(c))] = 60 + i
        order, ids = _roles()
        if len(at):
            hit = np.minimum(np.searchsorted(order, word), len(order) - 1)
            role = np.where(order[hit] == word, ids[hit], 0)
        else:
            role = np.zeros(0, np.int64)
        self.clause = np.cumsum(k == 5)[keep]
        first = np.concatenate(([0], np.cumsum([len(c) + 1 for c in clauses])[:-1])) if clauses else np.zeros(0, np.int64)
        self.begin = at[keep] - first[self.clause] if len(at) else at
        self.end = self.begin + size[keep]
        spaced = np.concatenate(([False], (k == 4)[:-1]))[keep] if len(at) else keep
        self.word, self.shape, self.role = word[keep], (shape[keep] * 2 + spaced).astype(np.uint64), role[keep].astype(np.uint64)
        self.n = len(clauses)
        self.length = np.bincount(self.clause, minlength=self.n)

    def features(self) -> np.ndarray:
        """The hashed features of each token: one row of places in the feature space per token."""
        n = len(self.word)
        pad = np.uint64(0)

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            out = np.full(n, pad)
            if by < 0 and n > -by:
                out[-by:] = np.where(self.clause[-by:] == self.clause[:by], x[:by], pad)
            elif by > 0 and n > by:
                out[:-by] = np.where(self.clause[:-by] == self.clause[by:], x[by:], pad)
            elif by == 0:
                out = x
            return out

        w = {i: shifted(self.word, i) for i in range(-3, 4)}
        s = {i: shifted(self.shape + np.uint64(1), i) for i in range(-3, 4)}
        c = {i: shifted(self.role + np.uint64(1), i) for i in range(-2, 4)}
        mix = lambda *xs: functools.reduce(lambda a, b: (a ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9), xs)
        f = [
            w[0], w[-1], w[1], w[-2], w[2], mix(w[-1], w[0]), mix(w[0], w[1]), mix(w[-2], w[-1]), mix(w[1], w[2]), mix(w[-3], w[-2], w[-1]),
            mix(s[0], c[0]), mix(s[-1], s[0], s[1]), mix(s[-2], s[-1], s[0]), mix(s[0], s[1], s[2]), mix(c[-1], c[0], c[1]), mix(c[0], c[1], c[2]),
            mix(w[-1], c[0], s[1]), mix(w[-1], s[0]), mix(s[0], w[1]), mix(s[-2], s[-1], s[0], s[1], s[2]), mix(c[-2], c[-1], c[0], s[0]), mix(c[0], c[1], c[2], c[3]), mix(s[-3], s[-2], s[-1], s[0]), mix(s[0], s[1], s[2], s[3]),
            mix(w[-2], w[-1], c[0]),
        ]
        return np.stack([(mix(np.full(n, np.uint64(i + 1)), x) >> np.uint64(40)) % np.uint64(SPACE) for i, x in enumerate(f)], 1).astype(np.int32)


@functools.cache
def _roles() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with a role, sorted, and the role of each."""
    power = np.cumprod(np.full(64, 1_000_003, np.uint64))
    h = lambda s: np.sum(np.array([ord(ch) for ch in s], np.uint64) * power[: len(s)])
    named = {"surname": [x for x in labelled.SURNAMES if len(x) == 1], "double": [x[0] for x in labelled.SURNAMES if len(x) > 1]}
    words = [(h(x), i) for i, xs in enumerate([*(v.split() for v in ROLES.values()), named["surname"], named["double"]], 1) for x in xs]
    best = {int(a): b for a, b in words}
    keys = np.array(sorted(best), np.uint64)
    return keys, np.array([best[int(k)] for k in keys])


class Field:
    """The conditional random field: weights of hashed features, and of moves between labels."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.weight = np.zeros((SPACE, n), np.float32)
        self.move = np.zeros((n, n), np.float32)
        bad = [(i, j) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS) if b[0] == "I" and a[1:] != b[1:]]
        self.banned = np.zeros((n, n), np.float32)
        self.banned[tuple(zip(*bad, strict=True))] = -1e4
        self.first = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)

    def scores(self, tokens: Tokens) -> np.ndarray:
        f = tokens.features()
        out = np.zeros((len(f), len(LABELS)), np.float32)
        for j in range(f.shape[1]):
            out += self.weight[f[:, j]]
        return out

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best label of each token; clauses of like length step together."""
        emit, out = self.scores(tokens), np.zeros(len(tokens.word), np.int8)
        first = np.concatenate(([0], np.cumsum(tokens.length)[:-1]))
        order = np.argsort(-tokens.length, kind="stable")
        order = order[tokens.length[order] > 0]
        move = (self.move + self.banned).T[None]
        at, size = first[order], tokens.length[order]
        if not len(order):
            return out
        best = emit[at] + self.first
        back = []
        for t in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -t, "left"))  # clauses longer than t
            total = best[:m, None, :] + move
            k = total.argmax(2)
            back.append(k.astype(np.int8))
            best[:m] = np.take_along_axis(total, k[:, :, None], 2)[:, :, 0] + emit[at[:m] + t]
        label = best.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, "left"))
            out[at[:m] + t] = label[:m]
            if t:
                label[:m] = np.take_along_axis(back[t - 1], label[:m, None], 1)[:, 0]
        return out

    def train(self, tokens: Tokens, gold: np.ndarray) -> None:
        """Conditional likelihood by forward and backward sums, in small batches of clauses of like length."""
        f, n = tokens.features(), len(LABELS)
        first = np.concatenate(([0], np.cumsum(tokens.length)[:-1]))
        rng = np.random.default_rng(5)
        grown = np.full((SPACE, n), 1e-3, np.float32)
        moved = np.full((n, n), 1e-3, np.float32)
        clauses = np.flatnonzero(tokens.length > 0)
        for _ in range(PASSES):
            by = clauses[np.argsort(tokens.length[clauses] + rng.random(len(clauses)) * 4, kind="stable")]
            batches = [by[i : i + 48] for i in range(0, len(by), 48)]
            for b in rng.permutation(len(batches)):
                rows = batches[b]
                size = tokens.length[rows]
                width = int(size.max())
                idx = first[rows][:, None] + np.minimum(np.arange(width)[None], size[:, None] - 1)
                live = np.arange(width)[None] < size[:, None]
                feats = f[idx]
                emit = self.weight[feats].sum(2)
                move = self.move + self.banned
                fwd = np.zeros_like(emit)
                fwd[:, 0] = emit[:, 0] + self.first
                for t in range(1, width):
                    x = fwd[:, t - 1, :, None] + move[None]
                    top = x.max(1, keepdims=True)
                    fwd[:, t] = np.where(live[:, t, None], np.log(np.exp(x - top).sum(1)) + top[:, 0] + emit[:, t], fwd[:, t - 1])
                bwd = np.zeros_like(emit)
                for t in range(width - 2, -1, -1):
                    x = move[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :]
                    top = x.max(2, keepdims=True)
                    bwd[:, t] = np.where(live[:, t + 1, None], np.log(np.exp(x - top).sum(2)) + top[:, :, 0], 0)
                end = fwd[np.arange(len(rows)), size - 1]
                z = np.log(np.exp(end - end.max(1, keepdims=True)).sum(1)) + end.max(1)
                p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
                y = gold[idx]
                grad = p.copy()
                np.subtract.at(grad, (np.arange(len(rows))[:, None], np.arange(width)[None], y), live)
                places, inverse = np.unique(feats[live].ravel(), return_inverse=True)
                g = np.zeros((len(places), n), np.float32)
                np.add.at(g, inverse, np.repeat(grad[live], feats.shape[2], 0))
                g += DECAY * self.weight[places] * len(tokens.word)
                grown[places] += g * g
                self.weight[places] -= STEP * g / np.sqrt(grown[places])
                pair = np.exp(fwd[:, :-1, :, None] + move[None, None] + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
                gm = pair.sum((0, 1))
                np.subtract.at(gm, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
                moved += gm * gm
                self.move -= STEP * gm / np.sqrt(moved)


def labelled_tokens(rows: list[list[tuple[str, str]]]) -> tuple[Tokens, np.ndarray]:
    """Tokens and gold labels of rows of (piece, label)."""
    texts = [folded("".join(p for p, _ in r))[0] for r in rows]
    tokens = Tokens(texts)
    gold = np.zeros(len(tokens.word), np.int64)
    for i, r in enumerate(rows):
        at = 0
        lo, hi = np.searchsorted(tokens.clause, i, "left"), np.searchsorted(tokens.clause, i, "right")
        begin = tokens.begin[lo:hi]
        for piece, tag in r:
            n = len(folded(piece)[0])
            if tag != "O":
                inside = np.flatnonzero((begin >= at) & (begin < at + n)) + lo
                gold[inside] = LABELS.index("I" + tag)
                gold[inside[:1]] = LABELS.index("B" + tag)
            at += n
    return tokens, gold


@functools.cache
def trained(copies: int = 12) -> Field:
    """The field trained on the labelled table, once per process."""
    field = Field()
    field.train(*labelled_tokens(labelled.rows(copies)))
    field.weight = field.weight.astype(np.float16).astype(np.float32)
    return field


_MAIL = re.compile(r"^[A-Za-z0-9][\w.+-]*\s*(?:@|\(at\)|\[at\]|\bat\b)\s*[\w-]+(?:\s*(?:\.|\[dot\]|\(dot\)|\bdot\b)\s*[\w-]+)+$", re.I)
_TOLL = re.compile(r"^(?:\+?86)?(?:400|800)\d{5,7}$|^1?(?:800|888|877|866)\d{7}$")


_HAN_DIGITS = str.maketrans("零〇幺一二三四五六七八九", "001123456789")


def valid(tag: str, text: str) -> bool:
    """Whether a span can be what it is labelled as."""
    digits = re.sub(r"\D", "", text.translate(_HAN_DIGITS))
    if tag == "E":
        return bool(_MAIL.match(text))
    if tag == "P":
        bare = re.fullmatch(r"\d{11}", text)  # eleven digits in a row are a mobile number, or one with its area code
        return 7 <= len(digits) <= 15 and not _TOLL.match(digits) and (not bare or bool(re.match(r"1[3-9]|0", text)))
    if tag == "I":
        compact = re.sub(r"[\s-]", "", text)
        if re.fullmatch(r"\d{17}[\dXx]", compact):
            return 1900 <= int(compact[6:10]) <= 2030 and 1 <= int(compact[10:12]) <= 12 and 1 <= int(compact[12:14]) <= 31
        return bool(re.fullmatch(r"\d{9}|[A-Za-z]\d{8}", compact))
    if tag == "A":
        return bool(re.search(r"\d|[一二三四五六七八九十百零]", text)) and not re.fullmatch(r"[\d零〇幺一二三四五六七八九]+", text)
    return (2 <= len(text) <= 4 if "一" <= text[0] <= "鿿" else bool(re.fullmatch(r"[^\W\d_]+(?: [^\W\d_]\.?)? [^\W\d_'-]+", text)))


_MAIL_IN = re.compile(_MAIL.pattern[1:-1], re.I)
#: Characters that make a preposition of the family name 于.
_BEFORE_YU = set("属由关对终等在大小至高低善过便基")
_ARTICLE = re.compile(r"(?<![A-Za-z])(?:the|an?|my|your|our|this|that|these|those)\s+$", re.I)


def checked(tag: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The part of a span that can be what it is labelled as: an address without the words beside it, a name without an article."""
    if tag == "E":
        m = _MAIL_IN.search(text, a, b)
        return m.span() if m else None
    if tag == "N" and (_ARTICLE.search(text, max(a - 8, 0), a) or (text[a] == "于" and text[max(a - 1, 0) : a] in _BEFORE_YU)):
        return None
    return (a, b) if valid(tag, text[a:b]) else None


class Finder:
    """Finds the spans of texts with a trained field, keeping what it knows of clauses."""

    def __init__(self, field: Field):
        self.field = field
        self.kept: dict[str, list[tuple[int, int, str]]] = {}

    def _learn(self, keys: list[str]) -> dict[str, list[tuple[int, int, str]]]:
        """The spans of new clauses; as many of them as fit are kept for later batches."""
        learnt: dict[str, list[tuple[int, int, str]]] = {}
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            tokens = Tokens(part)
            label = self.field.decode(tokens)
            got: dict[int, list[tuple[int, int, str]]] = {}
            for i in np.flatnonzero(label).tolist():
                x = LABELS[label[i]]
                spans = got.setdefault(int(tokens.clause[i]), [])
                if x[0] == "I" and spans and spans[-1][2] == x[1] and label[i - 1]:
                    spans[-1] = (spans[-1][0], int(tokens.end[i]), x[1])
                else:
                    spans.append((int(tokens.begin[i]), int(tokens.end[i]), x[1]))
            for j, k in enumerate(part):
                learnt[k] = got.get(j, [])
        if len(self.kept) + len(learnt) > KEPT:
            self.kept.clear()
        self.kept.update(itertools.islice(learnt.items(), KEPT))
        return learnt

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, tag) in each original text, after the exact check."""
        cut, new = [], {}
        known: dict[str, list[tuple[int, int, str]]] = {}  # the batch's own: what is kept may be forgotten meanwhile
        for t in texts:
            if not t:
                cut.append(None)
                continue
            plain, places = folded(t)
            clauses = _SPLIT.split(plain)
            keys = [_CODE.sub(lambda m: "X" * len(m.group()), _DIGIT.sub("0", c)) for c in clauses[::2]]
            cut.append((plain, places, clauses, keys))
            for k in keys:
                if k in self.kept:
                    known[k] = self.kept[k]
                else:
                    new[k] = None
        if new:
            known.update(self._learn(list(new)))
        out = []
        for c in cut:
            got: list[tuple[int, int, str]] = []
            if c:
                plain, places, clauses, keys = c
                at = 0
                for i, k in enumerate(keys):
                    for a, b, tag in known[k]:
                        span = checked(tag, plain, at + a, at + b)
                        if span:
                            x, y = span
                            got.append((places[x], places[y - 1] + 1, tag) if places else (x, y, tag))
                    at += len(clauses[2 * i]) + (len(clauses[2 * i + 1]) if 2 * i + 1 < len(clauses) else 0)
            out.append(got)
        return out


_workers: dict[int, tuple[Finder, object]] = {}


class SharedFinder:
    """A finder whose trained field travels to the workers as a broadcast."""

    def __init__(self, spark: SparkSession):
        field = trained()
        used = np.flatnonzero(np.abs(field.weight).max(1) > 0).astype(np.int32)
        self.sent = spark.sparkContext.broadcast((used, field.weight[used].astype(np.float16), field.move))

    def get(self) -> Finder:
        value = self.sent.value
        if id(value) not in _workers:
            field = Field()
            field.weight[value[0]] = value[1]
            field.move = value[2]
            _workers.clear()
            _workers[id(value)] = (Finder(field), value)
        return _workers[id(value)][0]


def with_private(df: DataFrame, text: str) -> DataFrame:
    """df with kinds (array of the kinds present) and masked (the text with placeholders) in place of the text."""
    shared = SharedFinder(df.sparkSession)
    names = [c for c in df.columns if c != text]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.get()
        for b in batches:
            texts = b.column(at).to_pylist()
            kinds, masked = [], []
            for t, spans in zip(texts, finder.spans(texts), strict=True):
                kinds.append(sorted({KINDS[x] for _, _, x in spans}))
                for a, e, x in reversed(spans):
                    t = f"{t[:a]}[{KINDS[x].upper()}]{t[e:]}"
                masked.append(t)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(kinds, pa.list_(pa.string())), pa.array(masked, pa.string())], [*names, "kinds", "masked"])

    schema = df.drop(text).select("*", F.array().cast("array<string>").alias("kinds"), F.lit(None).cast("string").alias("masked")).schema
    return df.mapInArrow(run, schema)


FIELDS = (("posts", "post_seq", "content"), ("comments", "comment_seq", "text"), ("coded_items", "item_seq", "text"), ("feedback", "id", "text_snippet"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, text in FIELDS:
        df = table(spark, sf_dir, name, key, text).select(F.lit(name).alias("src"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of private data in every text."""
    return with_private(_texts(spark, sf_dir), "text").select("src", "row_id", F.explode("kinds").alias("kind"))


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of private data."""
    return with_private(_texts(spark, sf_dir), "text").select("src", "row_id", "masked")
