"""Text functions as Catalyst expressions. Null in, null out unless a function says otherwise.

Compatibility normalisation (NFKC) has no built-in; nfkc() is the one Arrow function here, and
callers that know their text is plain leave it out.
"""

from __future__ import annotations

import functools
import html
import operator
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxgrid import config as C

URL = r"https?://[^\s，。！？、（）()<>\"']+|www\.[^\s，。！？、（）()<>\"']+"
MENTION = r"(?U)@[\w\-]+"
#: Letters, marks and digits since Unicode 14, which Java 17 doesn't know; rare Han characters among them.
NEWER = "870-887 889-88E 898-89F 8B5-8B5 8C8-8D2 C3C-C3C C5D-C5D CDD-CDD CF3-CF3 ECE-ECE 170D-170D 1715-1715 171F-171F 180F-180F 1AC1-1ACE 1B4C-1B4C 1DFA-1DFA 2C2F-2C2F 2C5F-2C5F 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3-A7D3 A7D5-A7D9 A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 107B2-107BA 10EFD-10EFF 10F70-10F85 11070-11075 110C2-110C2 1123F-11241 11740-11746 11AB0-11ABF 11F00-11F10 11F12-11F3A 11F3E-11F42 11F50-11F59 12F90-12FF0 1342F-1342F 13440-13455 16A70-16ABE 16AC0-16AC9 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132-1B132 1B155-1B155 1CF00-1CF2D 1CF30-1CF46 1D2C0-1D2D3 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E08F-1E08F 1E290-1E2AE 1E4D0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 31350-323AF"
#: White space and word characters of clean_text, as its SQL has them: (?U)\s lacks U+001C to U+001F and holds U+000B; (?U)\w lacks ① and ², and holds joiners and Ⓐ.
BLANK, WORD = r"\t\n\f\r \p{Z}\x{85}\x{1C}-\x{1F}", r"\p{L}\p{N}\p{M}" + re.sub(r"\w+", r"\\x{\g<0>}", NEWER).replace(" ", "")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SPACED_EMAIL = r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+"
MOBILE, IDENTITY = r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation; ASCII passes through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All HTML entities; text without an ampersand passes through."""
    return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def collapse_marks(c: Column) -> Column:
    """Three and more of one punctuation mark as one."""
    return F.regexp_replace(c, r"([!?！？。，,.~～…])\1{2,}", "$1")


def clean_text(c: Column) -> Column:
    """Tags, addresses and mentions as spaces, repeated marks as one, white space squeezed; a text of noise only is empty."""
    t = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), URL.replace(r"\s", r"\t\n\f\r "), " ")
    t = collapse_marks(F.regexp_replace(t, rf"@[{WORD}\p{{Pc}}\-]+", " "))
    t = F.trim(F.regexp_replace(t, f"[{BLANK}]+", " "))
    return F.regexp_replace(t, f"^[^{WORD}]*+$", "")


def compact(c: Column) -> Column:
    """Lower case without any white space: the form that keywords are matched in."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def light(c: Column) -> Column:
    """Lower case, marks and white space collapsed."""
    return F.lower(squeeze(collapse_marks(c)))


def mask(c: Column) -> Column:
    """Mail addresses, links, mentions, mobile and identity numbers as single spaces."""
    t = F.regexp_replace(c, SPACED_EMAIL, " ")
    for p in (URL, EMAIL, MENTION, IDENTITY, MOBILE):
        t = F.regexp_replace(t, p, " ")
    return squeeze(t)


def placeholders(c: Column) -> Column:
    """The same as typed placeholders, for fixtures."""
    for p, name in ((SPACED_EMAIL, "<mail>"), (URL, "<url>"), (IDENTITY, "<id>"), (MOBILE, "<phone>"), (MENTION, "<user>")):
        c = F.regexp_replace(c, p, name)
    return c


def fingerprint(title: Column, content: Column) -> Column:
    """16 hex digits of SHA-256 over title, newline, content; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), 256), 1, 16)


def shorten(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis where any are left out."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def first_of(haystack: Column, words: Sequence[str]) -> Column:
    """The first word of a list, in list order, that stands in the text; null for none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(haystack, w)), F.lit(1))


def any_of(haystack: Column, words: Sequence[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(haystack, F.lit(w)) for w in words])


def ad_marker(title: Column, text: Column, markers: Sequence[str] = C.AD_MARKERS) -> Column:
    """The first advertising marker of title and text, null for none."""
    return first_of(F.lower(F.concat_ws(" ", title, text)), markers)


def boilerplate(c: Column, patterns: Sequence[str] = C.BOILERPLATE) -> Column:
    return F.coalesce(light(c).rlike("(?i)" + "|".join(re.escape(p) for p in patterns)), F.lit(False))


def official(title: Column) -> Column:
    """Pages of a maker: hard words always, site words unless the title is a review site's."""
    t = F.coalesce(F.lower(title), F.lit(""))
    return any_of(t, C.OFFICIAL_WORDS) | (any_of(t, C.SITE_WORDS) & ~any_of(t, C.REVIEW_SITE_WORDS))


def evidence_text(c: Column, words: Sequence[str] = C.PROFANITY, n: int = C.EVIDENCE_LENGTH) -> Column:
    """Masked, shortened, and replaced as a whole where it holds profanity."""
    t = mask(c)
    return F.when(any_of(F.lower(t), words), F.lit("（含不当用语）")).otherwise(shorten(t, n))


def suffix_of(query: Column, keyword: Column, hints: Sequence[str] = ("测评", "评价", "怎么样", "体验")) -> Column:
    """What a query adds to its keyword, without the usual hint words."""
    t = F.replace(query, keyword, F.lit(" "))
    return squeeze(F.regexp_replace(t, "|".join(hints), " "))


def build_query(keyword: Column, hint: Column, suffixes: Sequence[str] = ("评测", "体验")) -> Column:
    """Keyword and hint; without a hint, the first suffix that the keyword doesn't hold, unless it asks for a review already."""
    more = F.try_element_at(F.filter(F.array(*[F.lit(s) for s in suffixes]), lambda s: ~F.contains(keyword, s)), F.lit(1))
    asks = any_of(keyword, ("评价", "测评", "口碑"))
    return F.trim(F.concat_ws(" ", keyword, F.when(hint != "", hint).otherwise(F.when(~asks, more))))


def chinese_count(c: Column) -> Column:
    """1.2万 as 12000, 3亿 likewise, plain numbers as they are; 0 for anything else, null for null."""
    n = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([万亿wW]?)\s*\+?\s*$", 1).try_cast("double")
    unit = F.regexp_extract(c, r"([万亿wW])\s*\+?\s*$", 1)
    factor = F.when(unit.isin("万", "w", "W"), 10000).when(unit == "亿", 100000000).otherwise(1)
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.round(n * factor).cast("bigint"), F.lit(0).cast("bigint")))


def note_id(url: Column) -> Column:
    """The last path part of an address that looks like an id."""
    return F.nullif(F.regexp_extract(url, r"/([A-Za-z0-9]{4,})(?:[/?#]|$)[^/]*$", 1), F.lit(""))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text without white space."""
    t = F.regexp_replace(c, r"(?U)\s+", "")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?s)(?=(..))"), F.lit(1)))


def consistent(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two texts share a pair of characters; short or missing ones are given the benefit of the doubt."""
    short = (F.coalesce(F.length(a), F.lit(0)) < least) | (F.coalesce(F.length(b), F.lit(0)) < least)
    return short | F.coalesce(F.arrays_overlap(bigrams(a), bigrams(b)), F.lit(True))


def page_quality(query: Column, titles: Column) -> Column:
    """Whether the longest word of a query stands in any of the titles."""
    words = F.split(F.trim(query), r"\s+")
    longest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.exists(titles, lambda t: F.contains(F.lower(t), F.lower(longest)))


def risk_markers(c: Column) -> Column:
    """The risk markers in a text, and whether one of them is hard."""
    t = F.lower(F.coalesce(c, F.lit("")))
    found = F.filter(F.array(*[F.lit(w) for w in (*C.RISK_MARKERS, *C.HARD_RISK)]), lambda w: F.contains(t, w))
    return F.struct(found.alias("markers"), any_of(t, C.HARD_RISK).alias("hard"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[。！？!?；;\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def clauses(c: Column) -> Column:
    """Parts of a text between marks and turning words."""
    return F.filter(F.transform(F.split(c, r"[，,。！？!?；;、\n]+|但是|不过|然而|可是|而且|但"), lambda x: F.trim(x)), lambda x: x != "")


def relevance_contains(text: Column, signals: Column, aliases: Column | None = None) -> Column:
    """1.0 where a signal stands in the text, 0.9 where an alias does, else 0.0. Blank signals don't count."""
    t = compact(F.coalesce(text, F.lit("")))
    hit = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda s: (compact(s) != "") & F.contains(t, compact(s)))
    got = F.when(hit(signals), 1.0)
    if aliases is not None:
        got = got.when(hit(aliases), 0.9)
    return got.otherwise(0.0)


def relevance(text: Column, signal: Column) -> Column:
    """Containment 1.0; else, for signals of 4 and more, the share of the signal that is the longest common substring,
    where that is at least 2 (Han) or 3 (other) long and begins the signal; else 0.

    The longest match that begins earliest in the signal decides: a longer one elsewhere gives 0.
    """
    t, s = compact(F.coalesce(text, F.lit(""))), compact(F.coalesce(signal, F.lit("")))
    n = F.length(s)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    # longest substring of the signal from each start that stands in the text
    at = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), F.lit(0), lambda a, k: F.when((i + k - 1 <= n) & (a == k - 1) & F.contains(t, F.substring(s, i, k)), k).otherwise(a))
    runs = F.transform(starts, at)
    best = F.array_max(runs)
    least = F.when(s.rlike(r"^[a-z0-9 _-]+$"), C.LCS_LATIN).otherwise(C.LCS_HAN)
    begins = F.element_at(runs, 1) == best
    part = F.when((n >= C.LCS_SIGNAL) & (best >= least) & begins, F.round(best / n, 4)).otherwise(0.0)
    return F.when(s == "", 0.0).when(F.contains(t, s), 1.0).otherwise(part)
