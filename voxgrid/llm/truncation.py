"""Texts cut off by a field limit or in mid-transfer, and how often each source cuts.

Method: lengths of a source are read as a discrete lifetime. Window functions give the hazard of each
length (distinct texts that end there, of those that reach it) and of its neighbours; lengths whose
hazard is far above theirs are significant by a Chernoff bound with Benjamini-Hochberg control over all
lengths of all sources. A source is a table, kind and channel; all channels of a table and kind together,
and all texts of a table that end in dots, are sources as well. A text is cut where its end is incomplete
and its length significant.

Additions, since a cut in mid-transfer has no length of its own: a broken character, tag or entity at the
end, a reader's "more" after an ellipsis, and an end that the corpus practically never takes for one.
p5_evidence counts the rows of each.

Whether an end is complete is learned from the corpus: how often the last characters of a text are the
last of a clause wherever else they stand, by the longest context seen often enough. A writer's own dots
after a complete end are none. Every distinct text has one vote in all statistics, so copies prove nothing.

Defined results: null and blank texts and texts with template residue or notices are no cases (those whose only sign is a
blank slot or a field's name aren't looked up among all records again); an item coded
from a cut content (the same post and the same words) is one, whatever its own end; repeated rows are
judged alike. All rows and whole texts count.
"""

from __future__ import annotations

import functools
import math
import operator
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid.llm.codepoints import points_of, slices
from voxgrid.llm.residue import flagged
from voxgrid.session import staged, table

#: Half-width of the neighbourhood of a length, false-discovery rate, least texts and least excess of a hazard.
NEAR, RATE, LEAST, TIMES = 12, 0.01, 4, 3.0
#: Context lengths in characters, longest first, and how often a context must be seen. Letters say little until they
#: are many, Han characters soon say enough: 14 are of letters, 3 don't end in one. A clause of one or two characters
#: is its own context, marked as the start of a clause.
CONTEXTS, SEEN = (14, 6, 3), 6
#: Share of clause ends among a context's places: under it an end is incomplete; without any other sign, under NEVER.
ENDS, NEVER = 0.2, 0.01
#: The same for an end with dots at a length of no significance: writers put dots after complete ends.
DOTTED = 0.05
#: Places that a context must have to show a cut by itself.
SURE = 12
#: Bits of the filter of wanted contexts that travels to the tasks (8 MB); an exact join follows it.
FILTER_BITS = 26
#: Steps of the p values' logarithms in the false-discovery control, and the last step.
STEP, LAST_STEP = 50, 20_000
#: Copies of a text may be a third of all rows: joins on texts are spread over so many parts.
SALTS = 8

_BLANKS = " \\t\\n\\r　 "
#: Names of character entities, of which the beginning may be left.
ENTITIES = "nbsp amp lt gt quot apos hellip mdash ndash ldquo rdquo lsquo rsquo middot copy reg trade yen deg times"
_STARTS = "|".join(sorted({e[:i] for e in ENTITIES.split() for i in range(1, len(e) + 1)}, key=lambda x: (-len(x), x)))
_TAG = r"""</?(?:[A-Za-z][A-Za-z0-9]*+(?:\s++[A-Za-z-]++=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))*+(?:\s++[A-Za-z-]*+(?:=(?:"[^"<>]*+|'[^'<>]*+)?)?)?/?)?"""
_BROKEN = rf"(?:\x{{FFFD}}|{_TAG}|&(?:#[0-9A-Fa-fx]*|{_STARTS}))\z"
_MORE = r"(?:…+|\.{2,}|。{2,})\s*[\[(（【]?\s*(?:全文|展开(?:全文)?|查看(?:全文|更多)|阅读(?:全文|更多)|(?i:(?:read |see |show )?more))\s*[\])）】]?\z"
_MORE_LAST = r"[文开多eE\])）】]"
_DOTS = r"\s*(?:…+|\.{2,}|。{3,})\z"
#: Ends that a writer leaves: closing marks, symbols and emotes, emoji, tags, addresses.
_CLOSED = r"[。．！？!?～~.；;：:\])】）」』”\"'》>*^_=|/\\\-\p{So}\p{Sk}\p{Cs}\x{FE0F}\x{200D}]"
_CLOSED_WORD = r"(?:#[^#\s]++#?|(?:https?://|www\.)[!-~]+|[A-Za-z0-9._+-]@[A-Za-z0-9.-]+)\z"


def _hashes(text: Column) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(F.lit(i), text).alias(f"h{i}") for i in (1, 2)]


def _holds(c: str, *signs: str) -> Column:
    """Whether a text has one of the signs that a pattern needs: cheaper than the pattern."""
    return functools.reduce(operator.or_, [F.contains(F.col(c), F.lit(x)) for x in signs])


def ends(df: DataFrame) -> DataFrame:
    """df with what the end of its text looks like: broken, more, dots, base (the text before such marks), length and closed."""
    df = df.withColumn("t", F.expr(f"trim(trailing '{_BLANKS}' from text)")).where("t <> ''").withColumn("z", F.expr("right(t, 1)"))
    df = df.withColumn("broken", _holds("t", "<", "&", "\ufffd") & F.col("t").rlike(_BROKEN)).withColumn("more", F.col("z").rlike(_MORE_LAST) & F.col("t").rlike(_MORE)).withColumn("dots", F.col("z").isin("…", ".", "。") & F.col("t").rlike(_DOTS))
    base = F.when(F.col("more"), F.regexp_replace("t", _MORE, "")).when(F.col("dots"), F.regexp_replace("t", _DOTS, "")).otherwise(F.col("t"))
    df = df.withColumn("base", base).withColumn("length", F.length("base")).withColumn("base", F.expr(f"trim(trailing '{_BLANKS}' from base)"))
    closed = (F.col("base") == "") | F.expr("right(base, 1)").rlike(_CLOSED) | (_holds("base", "#", "http", "www.", "@") & F.col("base").rlike(_CLOSED_WORD))
    return df.withColumn("closed", closed).drop("t", "z")


@functools.cache
def _signs() -> np.ndarray:
    """Which code points end a clause: marks and symbols (a dot does only at the end of a word, or doubled)."""
    table = np.zeros(0x110000, bool)
    for a, b in ((0x1F000, 0x20000), (0xA6, 0x10000)):
        table[a:b] = [unicodedata.category(chr(c)) == "So" for c in range(a, b)]
    for a, b in ((0x3001, 0x3003), (0xFF01, 0xFF10), (0xFF1A, 0xFF20)):
        table[a:b] = True
    table[[ord(c) for c in "～…!?;,~#]\r\n"]] = True
    return table


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    h = (h + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Clauses:
    """The clauses of a batch of texts as code points, numbers and codes as one sign."""

    def __init__(self, texts: pa.Array):
        cps, row = points_of(texts)
        n = len(cps)
        first = np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        digit = (cps >= 48) & (cps <= 57)
        run = digit.copy()
        run[1:] &= ~(digit[:-1] & ~first[1:])  # the first digit of a number stands for all
        keep = run | ~digit
        at = np.flatnonzero(run)
        three = np.ones(len(at), bool)
        for j in (1, 2):
            k = np.minimum(at + j, n - 1)
            three &= (at + j < n) & digit[k] & (row[k] == row[at])
        upper = (cps >= 65) & (cps <= 90)
        before = three.copy()
        drops = []
        for j in (1, 2, 3):  # two or three capitals before three digits belong to the code
            k = np.maximum(at - j, 0)
            before = before & (at >= j) & upper[k] & (row[k] == row[at])
            drops.append((before, k))
        for ok, k in drops:
            keep[k[ok & drops[1][0]]] = False
        cps, row = np.where(digit, 48, cps)[keep], row[keep]
        n = len(cps)
        first = np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        sign = _signs()[cps]
        dot = cps == 46
        after = np.zeros(n, bool)
        if n:
            last = np.append(first[1:], True)
            nxt = np.append(cps[1:], 0)
            after = last | (((nxt == 32) | ((nxt >= 9) & (nxt <= 13))) & ~last) | ((nxt == 46) & ~last)
        prev = np.zeros(n, bool)
        prev[1:] = dot[:-1] & ~first[1:]
        sign |= dot & (after | prev)
        start = first.copy()
        start[1:] |= sign[:-1]
        clause = np.cumsum(start) - 1
        word = np.cumsum(~sign & (cps != 32))
        begin = np.flatnonzero(start)
        lead = word - (word[begin] - (~sign & (cps != 32))[begin])[clause] == 0 if n else np.empty(0, bool)
        inside = ~sign & ~lead
        # a clause is finished where a sign follows it in the same text
        finish = np.zeros(len(begin), bool)
        finish[clause[sign]] = True
        self.cps, self.row, clause = cps[inside].astype(np.uint64), row[inside], clause[inside]
        n = len(self.cps)
        head = np.ones(n, bool)
        head[1:] = clause[1:] != clause[:-1]
        self.last = np.append(head[1:], True)[:n]
        self.place = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.empty(0, np.int64)
        self.finished = finish[clause] if n else np.empty(0, bool)
        self.letter = np.isin(self.cps, np.array([*range(65, 91), *range(97, 123), 32], np.uint64))
        self.plain = self.letter | np.isin(self.cps, np.array([*range(48, 58), 39, 45], np.uint64))

    def contexts(self, where: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, hashes, positions) of the contexts that end at each position, or at those of where."""
        n = len(self.cps)
        at = np.arange(n) if where is None else where
        for level, k in enumerate(CONTEXTS):
            ok = self.place[at] >= k - 1
            if k == 14:
                count = np.concatenate(([0], np.cumsum(self.plain)))
                ok &= count[at + 1] - count[np.maximum(at - k + 1, 0)] == k
            if k == 3:
                ok &= ~self.letter[at]
            spot = at[ok]
            h = np.zeros(len(spot), np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + self.cps[spot - j]
            yield level, _mixed(h, k), spot
        for k in range(1, CONTEXTS[-1]):  # the first characters of a clause, as the contexts of a clause so short
            spot = at[self.place[at] == k - 1]
            h = np.zeros(len(spot), np.uint64)
            for j in range(k):
                h = h * np.uint64(0x100000001B3) + self.cps[spot - j]
            yield len(CONTEXTS) - 1, _mixed(h, 100 + k), spot


def last_contexts(open_: DataFrame) -> DataFrame:
    """(h1, h2, level, c): the contexts of the ends of (h1, h2, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                got = Clauses(part.column(2))
                final = np.flatnonzero(got.last & ~got.finished)
                final = final[np.append(got.row[final][1:] != got.row[final][:-1], True)] if len(final) else final
                for level, c, spot in got.contexts(final):
                    short = got.place[spot] < CONTEXTS[-1] - 1
                    ok = short if len(c) and short.any() and level == len(CONTEXTS) - 1 else np.ones(len(c), bool)
                    rows = got.row[spot][ok]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), level, np.int32)), pa.array(c[ok])], ["h1", "h2", "level", "c"])

    return open_.select("h1", "h2", "base").mapInArrow(run, "h1 long, h2 long, level int, c long")


def _filter(wanted: DataFrame) -> np.ndarray:
    """A filter of 2 ** FILTER_BITS bits that every c of wanted passes."""
    at = F.shiftrightunsigned("c", 64 - FILTER_BITS)
    words = wanted.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(c, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def context_ends(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, places, share): of the wanted contexts, how often they stand in finished clauses of (text) and how often they end one."""
    bits = texts.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                got = Clauses(part.column(0))
                codes, final = [], []
                for _, c, spot in got.contexts():
                    at = c.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                    hit = (bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 != 0
                    hit &= got.finished[spot]
                    codes.append(c[hit])
                    final.append(got.last[spot[hit]])
                code, e = np.concatenate(codes), np.concatenate(final)
                if len(code):
                    code, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64)), pa.array(np.bincount(inverse, weights=e).astype(np.int64))], ["c", "places", "ends"])

    found = texts.select("text").mapInArrow(run, "c long, places long, ends long")
    found = found.groupBy("c").agg(F.sum("places").alias("places"), F.sum("ends").alias("ends"))
    return found.join(wanted.select("c").distinct(), "c", "left_semi").select("c", "places", (F.col("ends") / F.col("places")).alias("share"))


def length_hazards(df: DataFrame) -> DataFrame:
    """The conspicuous lengths of every source of (source, length): hazard, texts expected, p bound, and whether they are significant among all."""
    n = df.groupBy("source", "length").agg(F.count("*").alias("n"))
    by = W.partitionBy("source").orderBy("length")
    n = n.withColumn("reach", F.sum("n").over(by.rowsBetween(0, W.unboundedFollowing)))
    sides = [by.rangeBetween(-NEAR, -1), by.rangeBetween(1, NEAR)]
    near = F.coalesce(F.sum("n").over(sides[0]), F.lit(0)) + F.coalesce(F.sum("n").over(sides[1]), F.lit(0))
    n = n.withColumn("near", near).withColumn("steps", NEAR + F.least(F.col("length") - 1, F.lit(NEAR)))
    # texts that end nearby, for each step that texts of this length could have taken
    expected = F.greatest((F.col("near") + 0.5) / F.col("steps"), F.lit(0.02))
    n = n.withColumn("expected", expected).withColumn("hazard", F.col("n") / F.col("reach"))
    over = F.col("n") * F.ln(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected")
    n = n.withColumn("surprise", F.when(F.col("n") > F.col("expected"), over).otherwise(0.0))
    n = n.withColumn("step", F.least(F.floor(F.col("surprise") * STEP), F.lit(LAST_STEP)))
    n = staged(n, "hazards")
    # false-discovery control over the histogram of ln p, which has LAST_STEP rows at most, whatever the number of sources
    steps = n.groupBy("step").agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    many, m, least = 0, sum(r.k for r in steps), None
    for r in steps:
        many += r.k
        if math.exp(-r.step / STEP) <= RATE * many / m:
            least = r.step
    low = n.where((F.col("surprise") > -math.log(RATE)) & (F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.col("expected")))
    significant = F.col("step") >= least if least is not None else F.lit(False)
    return low.select("source", "length", "n", "reach", "hazard", "expected", F.exp(-F.col("surprise")).alias("p"), significant.alias("significant"))


def _pools(source: str = "source") -> list[Column]:
    """The wider sources of a source: all channels of its table and kind, and the dotted texts of its table."""
    return [F.regexp_replace(source, "[^/]*$", "*"), F.concat(F.substring_index(source, "/", 1), F.lit("/dotted"))]


def _lengths(df: DataFrame) -> DataFrame:
    """(source, length) of the distinct texts of df in their sources and the wider ones."""
    seen = ends(df.select("source", "text", *_hashes(F.col("text")))).where("not broken")
    seen = seen.select("source", "h1", "h2", "length", (F.col("dots") | F.col("more")).alias("dotted")).distinct()
    wide, dotted = _pools()
    every = F.array(F.col("source"), wide, F.when(F.col("dotted"), dotted))
    return seen.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("source"), "length")


def cuts(df: DataFrame) -> DataFrame:
    """The cut texts of df (row_id, source, text), without the text, and their evidence.

    evidence: limit (incomplete at a significant length), more, broken, dots or transfer (the end alone shows it).
    """
    df = df.where("text is not null")
    texts = staged(ends(df.select("text").distinct()).select(*_hashes(F.col("text")), "text", "base", "length", "broken", "more", "dots", "closed"), "ends")
    open_ = texts.where("not closed and not broken and not more")
    contexts = staged(last_contexts(open_), "contexts")
    known = staged(context_ends(texts, contexts), "known").where(F.col("places") >= SEEN)
    spread = contexts.withColumn("salt", F.pmod(F.col("h1"), F.lit(SALTS)).cast("int"))
    copies = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    best = spread.join(copies, ["c", "salt"]).groupBy("h1", "h2").agg(F.min(F.struct("level", "share", "places")).alias("x")).select("h1", "h2", "x.share", "x.places")
    judged = texts.where("not closed or broken or more").select("h1", "h2", "length", "broken", "more", "dots").join(best, ["h1", "h2"], "left")
    incomplete = F.coalesce(F.col("share") < ENDS, F.lit(True))
    judged = staged(judged.where(F.col("broken") | F.col("more") | incomplete), "judged")

    limits = length_hazards(_lengths(df)).where("significant").select("source", "length").withColumn("limit", F.lit(True))
    limits = staged(limits, "limits")
    rows = df.select(*[c for c in df.columns if c != "text"], *_hashes(F.col("text"))).withColumn("salt", F.pmod(F.hash("row_id"), F.lit(SALTS)))
    few = judged.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(few, ["h1", "h2", "salt"]).drop("salt")
    for i, pool in enumerate([F.col("source"), *_pools()]):
        named = limits.select(F.col("source").alias(f"s{i}"), "length", F.col("limit").alias(f"l{i}"))
        rows = rows.withColumn(f"s{i}", pool).join(named, [f"s{i}", "length"], "left")
    limit = F.coalesce("l0", "l1", F.when(F.col("dots"), F.col("l2")), F.lit(False))
    sure = F.coalesce((F.col("share") < NEVER) & (F.col("places") >= SURE), F.lit(False))
    evidence = (
        F.when(F.col("broken"), "broken").when(F.col("more"), "more").when(limit, "limit")
        .when(F.col("dots") & F.coalesce(F.col("share") < DOTTED, F.lit(False)), "dots").when(sure, "transfer")
    )
    return rows.select(*[c for c in df.columns if c != "text"], evidence.alias("evidence")).where("evidence is not null")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts", "post_seq", "id", "channel_id", "platform", "content")
    items = table(spark, sf_dir, "coded_items", "item_seq", "text_id", "channel_id", "platform", "text")
    part = F.split("text_id", ":")
    a = posts.select(F.lit("posts").alias("src"), F.col("post_seq").alias("row_id"), F.col("id").alias("post"), "channel_id", "platform", F.lit("post").alias("kind"), F.col("content").alias("text"))
    b = items.select(F.lit("coded_items").alias("src"), F.col("item_seq").alias("row_id"), part[0].alias("post"), "channel_id", "platform", F.coalesce(part[1], F.lit("")).alias("kind"), "text")
    return a.unionByName(b).withColumn("source", F.concat_ws("/", "src", "kind", F.coalesce("channel_id", F.lit(""))))


def _words(text: Column) -> list[Column]:
    """What a text and an item coded from it have in common: its first or its last letters."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    return [F.concat(F.lit("<"), F.left(bare, F.lit(12))), F.concat(F.lit(">"), F.right(bare, F.lit(8)))]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, row_id, evidence) of cut contents of posts and texts of coded items; coded: an item of a cut content."""
    texts = _texts(spark, sf_dir)
    direct = staged(cuts(texts.select("src", "row_id", "post", "kind", "source", "text")), "cuts")
    posts = table(spark, sf_dir, "posts", "post_seq", "id", "content")
    residue = flagged(posts.select("post_seq", "content"), "post_seq", ["content"], bare=True).select("post_seq")
    residue = staged(posts.join(residue, "post_seq", "left_semi").select(F.col("id").alias("post"), F.lit("post").alias("kind")).distinct(), "residue")
    direct = direct.join(residue, ["post", "kind"], "left_anti")
    cut = direct.where("src = 'posts'").select(F.col("row_id").alias("post_seq")).distinct()
    cut = posts.join(cut, "post_seq", "left_semi").select(F.col("id").alias("post"), F.explode(F.array(*_words(F.col("content")))).alias("words")).distinct()
    items = texts.where("src = 'coded_items' and kind = 'post' and text is not null").join(cut.select("post").distinct(), "post", "left_semi")
    made = items.select("src", "row_id", "post", F.explode(F.array(*_words(F.col("text")))).alias("words")).join(cut, ["post", "words"], "left_semi")
    every = direct.select("src", "row_id", "evidence").unionByName(made.select("src", "row_id", F.lit("~coded").alias("evidence")))
    return every.groupBy("src", "row_id").agg(F.ltrim(F.min("evidence"), F.lit("~")).alias("evidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of posts and texts of coded items that were cut."""
    return found(spark, sf_dir).select("src", "row_id")


def p5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut texts per table and evidence: how many stand at a significant length, and how many show the cut otherwise."""
    return found(spark, sf_dir).groupBy("src", "evidence").agg(F.count("*").alias("cut"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and cut texts per table, platform and channel."""
    texts = _texts(spark, sf_dir).where("text is not null and text <> ''").select("src", "row_id", "platform", "channel_id")
    rows = texts.join(p5_found(spark, sf_dir).withColumn("cut", F.lit(1)), ["src", "row_id"], "left")
    return rows.groupBy("src", "platform", "channel_id").agg(F.count("*").alias("texts"), F.count("cut").alias("cut"), F.round(F.count("cut") / F.count("*"), 4).alias("rate"))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of every source and of the wider ones, with their hazards."""
    return length_hazards(_lengths(_texts(spark, sf_dir).where("text is not null"))).where("significant").drop("significant")
