"""Lexicon scoring of texts: the plain scorer, the scanning scorer, and aspect votes.

The scanning scorer reads a lower-case text from left to right: at each place the longest word of the
lexicon or of the context words (which are skipped whole) is taken, and the two characters before a hit
give its degree and negation. It exists twice: as Catalyst expressions over one alternation of all
words, and as a Python function that tests compare with it. Null and empty texts score 0, neutral.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions.text import any_of, clauses


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x with x computed once: Catalyst would copy the expression to each of its uses."""
    return F.element_at(F.transform(F.array(x), body), 1)


def label(score: Column, band: float = C.NEUTRAL_BAND) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").otherwise("neutral")


def intensity(score: Column) -> Column:
    """1 to 5 from an absolute score."""
    return F.greatest(F.least(F.floor(F.abs(score) * 5) + 1, F.lit(5)), F.lit(1)).cast("int")


def plain_score(text: Column, lexicon: Mapping[str, float] = C.LEXICON, negations: Sequence[str] = C.NEGATIONS) -> Column:
    """The plain scorer: every word that stands in the text counts once, reversed and weakened after a negation."""
    t = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for w, s in lexicon.items():
        hit = F.contains(t, F.lit(w))
        negated = any_of(t, [n + w for n in negations])
        total = total + F.when(hit & negated, -C.NEGATED * math.copysign(1, s)).when(hit, math.copysign(1.0, s)).otherwise(0.0)
    return F.round(F.tanh(total / C.TANH_SCALE), 4)


def _pattern(lexicon: Mapping[str, float], context: Sequence[str]) -> str:
    words = [*sorted(context, key=len, reverse=True), *sorted(lexicon, key=lambda w: (-len(w), w))]
    return "|".join(re.escape(w) for w in words)


def scan(text: Column, lexicon: Mapping[str, float] = C.LEXICON, degrees: Mapping[str, float] = C.DEGREES, negations: Sequence[str] = C.NEGATIONS,
         context: Sequence[str] = C.CONTEXT_WORDS, strong: Sequence[str] = C.STRONG_NEGATIVE, irony: Sequence[str] = C.IRONY) -> Column:
    """struct(score, sentiment, confidence, keywords, pos, neg) of a text, as one expression.

    The words and the gaps between them come from one alternation; the look-back is the end of the
    text before a word, put together from the gap and the word before it.
    """
    p = _pattern(lexicon, context)
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])

    def hits(g: Column) -> Column:
        """The lexicon's words of a text in order, each with the characters before it."""
        before = lambda i: F.right(F.concat(F.when(i > 1, F.element_at(g.words, F.greatest(i - 1, F.lit(1)))).otherwise(""), F.element_at(g.gaps, i)), F.lit(C.LOOKBACK))
        all_ = F.transform(F.sequence(F.lit(1), F.size(g.words)), lambda i: F.struct(F.element_at(g.words, i).alias("w"), before(i).alias("before")))
        none = F.array().cast("array<struct<w:string,before:string>>")
        return F.when(F.size(g.words) > 0, F.filter(all_, lambda h: F.try_element_at(table, h.w).isNotNull())).otherwise(none)

    def amount(h: Column) -> Column:
        s = F.element_at(table, h.w)
        degree = F.lit(1.0)
        for word, factor in reversed(list(degrees.items())):
            degree = F.when(h.before.endswith(F.lit(word)), factor).otherwise(degree)
        base = C.HIT_UNIT * degree * F.least(1 + F.abs(s) / 5, F.lit(3.0))
        sign = F.when(s > 0, 1.0).otherwise(-1.0)
        return F.when(any_of(h.before, negations), -sign * base * C.NEGATED).otherwise(sign * base)

    def sums(x: Column) -> Column:
        """x: the scored hits and the strong negatives of a text."""
        total = F.aggregate(x.hits, F.size(x.harsh) * F.lit(-C.STRONG_WEIGHT), lambda a, h: a + h.a)
        pos, neg = F.size(F.filter(x.hits, lambda h: h.a > 0)), F.size(F.filter(x.hits, lambda h: h.a < 0)) + F.size(x.harsh)
        keys = F.slice(F.concat(x.harsh, F.transform(x.hits, lambda h: h.w)), 1, 10)
        return F.struct(total.alias("total"), pos.alias("pos"), neg.alias("neg"), keys.alias("keywords"), any_of(x.t, irony).alias("irony"))

    def result(y: Column) -> Column:
        score = F.round(F.when(y.total < 0, -1.0).otherwise(1.0) * F.tanh(F.abs(y.total) / C.TANH_SCALE), 4)
        return let(F.struct(score.alias("score"), y.alias("y")), lambda z: F.struct(z.score.alias("score"), label(z.score).alias("sentiment"), F.round(confidence(z), 4).alias("confidence"), z.y.keywords.alias("keywords"), z.y.pos.alias("pos"), z.y.neg.alias("neg")))

    def confidence(z: Column) -> Column:
        n = z.y.pos + z.y.neg
        agree = F.when(n > 0, F.greatest(z.y.pos, z.y.neg) / n).otherwise(1.0)
        sure = F.when(F.abs(z.score) <= C.NEUTRAL_BAND, F.greatest(1 - 3 * F.abs(z.score), F.lit(0.0))).otherwise(F.least(C.CONFIDENCE_GAIN * F.abs(z.score), F.lit(1.0)))
        cap = F.least(F.when(n == 0, C.NO_HIT_CAP).otherwise(1.0), F.when(z.y.irony, C.IRONY_CAP).otherwise(1.0))
        return F.least(sure * agree, cap)

    def read(t: Column) -> Column:
        g = F.struct(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)).alias("words"), F.split(t, p, -1).alias("gaps"))
        harsh = F.filter(F.array(*[F.lit(w) for w in strong]), lambda w: F.contains(t, w))
        scored = let(g, lambda g: F.transform(hits(g), lambda h: F.struct(h.w.alias("w"), amount(h).alias("a"))))
        return let(let(F.struct(scored.alias("hits"), harsh.alias("harsh"), t.alias("t")), sums), result)

    return let(F.lower(F.coalesce(text, F.lit(""))), read)


def scan_text(text: str | None, lexicon: Mapping[str, float] = C.LEXICON, degrees: Mapping[str, float] = C.DEGREES, negations: Sequence[str] = C.NEGATIONS,
              context: Sequence[str] = C.CONTEXT_WORDS, strong: Sequence[str] = C.STRONG_NEGATIVE) -> tuple[float, str]:
    """(score, label) of one text, character by character: the specification that scan() is tested against."""
    t, i, total = (text or "").lower(), 0, 0.0
    total -= C.STRONG_WEIGHT * sum(w in t for w in strong)
    while i < len(t):
        skipped = max((w for w in context if t.startswith(w, i)), key=len, default=None)
        if skipped:
            i += len(skipped)
            continue
        word = max((w for w in lexicon if t.startswith(w, i)), key=len, default=None)
        if not word:
            i += 1
            continue
        before = t[max(0, i - C.LOOKBACK) : i]
        degree = next((f for w, f in degrees.items() if before.endswith(w)), 1.0)
        a = C.HIT_UNIT * degree * min(1 + abs(lexicon[word]) / 5, 3) * math.copysign(1, lexicon[word])
        total += -a * C.NEGATED if any(n in before for n in negations) else a
        i += len(word)
    score = round(math.copysign(1, total) * math.tanh(abs(total) / C.TANH_SCALE), 4) if total else 0.0
    return score, "positive" if score > C.NEUTRAL_BAND else "negative" if score < -C.NEUTRAL_BAND else "neutral"


def mentions(text: Column, dims: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The aspects, in schema order, any of whose keywords stands in the text. dims: (id, keywords), a small schema."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = {d: [k.lower() for k in ks or () if k] for d, ks in dims if d is not None}
    flags = [F.when(any_of(t, ks), F.lit(d)) for d, ks in words.items() if ks]
    return F.array_compact(F.array(*flags)).cast("array<string>")


def aspect_votes(text: Column, dims: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """map of aspect to sentiment: every clause with a polarity votes for the aspects it mentions; only unanimous votes count."""
    dims = [(d, ks) for d, ks in dims if d is not None]
    if not dims:
        none = F.array().cast("array<string>")
        return F.map_from_arrays(none, none)

    def votes(parts: Column) -> Column:
        def of(d: str) -> Column:
            said = F.array_distinct(F.transform(F.filter(parts, lambda x: F.array_contains(x.d, d)), lambda x: x.s))
            return let(said, lambda v: F.when(F.size(v) == 1, F.struct(F.lit(d).alias("key"), F.element_at(v, 1).alias("value"))))

        return F.map_from_entries(F.array_compact(F.array(*[of(d) for d, _ in dims])))

    parts = F.transform(clauses(F.coalesce(text, F.lit(""))), lambda c: F.struct(mentions(c, dims).alias("d"), scan(c).getField("sentiment").alias("s")))
    return let(F.filter(parts, lambda x: x.s != "neutral"), votes)
