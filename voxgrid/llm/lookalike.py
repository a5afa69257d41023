"""One consistent form for texts that look the same but differ in their characters.

Method: an Arrow batch's text becomes one numpy array of code points. A lookup table gives each code
point its replacement length and, where it isn't one, an offset into a table of expansions; canonical
decompositions, wide and narrow forms, spaces, invisible characters and letters of other alphabets
with a Latin letter's shape are all entries of that one table. Marks are then composed onto their
letters by a sorted pair table, all rows at once. No string is touched row by row.

Defined results: null stays null, an empty text and one of invisible characters only become empty.
Case, accents, superscript and circled digits and traditional characters stay as they are. A joiner
between two emoji is visible and stays. Forms are complete texts of any length.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.llm.codepoints import points_of, strings_of
from voxgrid.session import table

#: Letters of other alphabets, each followed by the Latin letter of the same shape.
SAME_SHAPE = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW "
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv "
    "օo սu ոn ɑa ɡg ⅼl"
)
#: Blocks whose compatibility mappings are other encodings of the same sign: radicals, ligatures, Roman numerals.
SAME_SIGN = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x2160, 0x217F))
SPACE, JOINER = 0x20, 0x200D
#: Salts of each side when the members of hot classes are paired.
SALTS = 4


def _replacement(cp: int, shapes: dict[str, str]) -> str:
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if (cat == "Cf" and not 0x600 <= cp <= 0x605) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x180B, 0x180C, 0x180D):
        return ""
    if cat == "Cc" and ch not in "\t\n\r":
        return ""
    rule = unicodedata.decomposition(ch)
    if rule.startswith(("<wide>", "<narrow>", "<noBreak>")) or (rule.startswith("<compat>") and any(a <= cp <= b for a, b in SAME_SIGN)):
        ch = "".join(chr(int(x, 16)) for x in rule.split()[1:])
    return "".join(shapes.get(x, x) for x in unicodedata.normalize("NFD", ch))


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, built once in each Python worker."""
    shapes = {x[0]: x[1] for x in SAME_SHAPE.split()}
    n = 0x110000
    to, length, start = np.arange(n, dtype=np.int32), np.ones(n, np.int8), np.zeros(n, np.int32)
    ccc, emoji, pool = np.zeros(n, np.uint8), np.zeros(n, bool), []
    pairs: dict[tuple[int, int], int] = {}
    for cp in range(0x20000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        emoji[cp] = unicodedata.category(ch) in ("So", "Sk") and cp > 0x2000 or cp in (0xFE0F, JOINER)
        new = _replacement(cp, shapes)
        if new != ch:
            length[cp] = len(new)
            if len(new) == 1:
                to[cp] = ord(new)
            elif new:
                start[cp] = len(pool)
                pool.extend(map(ord, new))
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                pairs[a, b] = cp
    for cp in (*range(0x20000, 0x2FA20), *range(0xE0000, 0xE0200)):
        new = _replacement(cp, shapes)
        if new != chr(cp):
            length[cp] = len(new)
            if len(new) == 1:
                to[cp] = ord(new)
    for lead in range(19):
        for vowel in range(21):
            base = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[0x1100 + lead, 0x1161 + vowel] = base
            for tail in range(1, 28):
                pairs[base, 0x11A7 + tail] = base + tail
    keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    second = np.zeros(n, bool)
    second[[b for _, b in pairs]] = True
    return {
        "to": to, "length": length, "start": start, "pool": np.array(pool or [0], np.int32), "ccc": ccc, "emoji": emoji,
        "keys": keys[order], "made": np.array(list(pairs.values()), np.int32)[order], "second": second,
    }


def fold(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of all rows: code points and the row of each."""
    t = tables()
    if not len(cps):
        return cps, row
    n = t["length"][cps].astype(np.int64)
    joint = np.flatnonzero(cps == JOINER)
    if len(joint):
        inner = joint[(joint > 0) & (joint < len(cps) - 1)]
        inner = inner[t["emoji"][cps[inner - 1]] & t["emoji"][cps[inner + 1]] & (row[inner - 1] == row[inner + 1])]
        n[inner] = 1
    out = t["to"][cps]
    if (n != 1).any():
        more = np.flatnonzero(n > 1)
        at = np.cumsum(n) - n
        out, new_row = np.repeat(out, n), np.repeat(row, n)
        for k in range(int(n[more].max()) if len(more) else 0):
            m = more[n[more] > k]
            out[at[m] + k] = t["pool"][t["start"][cps[m]] + k]
        row = new_row
    return compose(out, row)


def compose(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, composed onto the letter before them."""
    t = tables()
    while len(cps):
        ccc = t["ccc"][cps]
        marks = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1]))
        if len(marks):
            group = np.cumsum((ccc == 0) | np.concatenate(([True], row[1:] != row[:-1])))
            order = np.lexsort((ccc, group))
            cps = cps[order]
            ccc = ccc[order]
        at = np.flatnonzero(t["second"][cps[1:]] & (ccc[:-1] == 0) & (row[1:] == row[:-1])) + 1
        if not len(at):
            break
        code = (cps[at - 1].astype(np.int64) << 21) | cps[at]
        hit = np.minimum(np.searchsorted(t["keys"], code), len(t["keys"]) - 1)
        good = t["keys"][hit] == code
        at, hit = at[good], hit[good]
        apart = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.empty(0, bool)
        at, hit = at[apart], hit[apart]
        if not len(at):
            break
        cps = cps.copy()
        cps[at - 1] = t["made"][hit]
        keep = np.ones(len(cps), bool)
        keep[at] = False
        cps, row = cps[keep], row[keep]
    return cps, row


def fold_array(texts: pa.Array) -> pa.Array:
    """The consistent form of an Arrow array of strings."""
    cps, row = points_of(texts)
    cps, row = fold(cps, row)
    return strings_of(cps, row, texts)


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with the consistent form of a text column as a new last column."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, fold_array(b.column(at))], [*names, out])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("string").alias(out)).schema)


def pairs_of(df: DataFrame, key: str, text: str, src: str) -> DataFrame:
    """Pairs of rows of df whose texts differ but have one form, as (src, row_a, row_b) with row_a < row_b.

    Rows are classes of equal texts first; only classes that share a form are paired, and their members
    are joined on with salts, so no task holds the rows of a hot text.
    """
    rows = with_form(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("t is not null"), "t")
    salt = lambda: F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    rows = rows.select("id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7), "form").alias("f2"), F.xxhash64("t").alias("v1"), F.xxhash64(F.lit(7), "t").alias("v2"), salt().alias("s"))
    classes = rows.select("f1", "f2", "v1", "v2").distinct()
    mixed = classes.groupBy("f1", "f2").agg(F.sort_array(F.collect_list(F.struct("v1", "v2"))).alias("vs")).where(F.size("vs") > 1)
    pairs = mixed.select(F.posexplode("vs").alias("i", "a"), "vs").select("a", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pairs = pairs.withColumn("sa", spread).withColumn("sb", spread)
    member = rows.select(F.struct("v1", "v2").alias("v"), "s", "id")
    side = lambda x: member.select(F.col("v").alias(x), F.col("s").alias(f"s{x}"), F.col("id").alias(f"id_{x}"))
    found = pairs.join(side("a"), ["a", "sa"]).join(side("b"), ["b", "sb"])
    return found.select(F.lit(src).alias("src"), F.least("id_a", "id_b").alias("row_a"), F.greatest("id_a", "id_b").alias("row_b"))


def classes_of(df: DataFrame, key: str, text: str, src: str) -> DataFrame:
    """(src, row_id, class_id, rows, variants) of the rows of df with a text: rows that look the same are one class, named by its least row.

    Linear in the rows, where pairs of a class grow with its square: copies aren't expanded.
    """
    rows = with_form(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("t is not null"), "t")
    rows = rows.select("id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7), "form").alias("f2"), F.xxhash64("t").alias("v1"), F.xxhash64(F.lit(7), "t").alias("v2"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("s"))
    texts = rows.groupBy("f1", "f2", "v1", "v2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("f1", "f2").agg(F.min("least").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("variants"))
    classes = classes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(classes, ["f1", "f2", "s"]).select(F.lit(src).alias("src"), F.col("id").alias("row_id"), "class_id", "rows", "variants")


FIELDS = (("posts", "post_seq", "title"), ("coded_items", "item_seq", "text"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title of posts and text of coded items."""
    out = None
    for name, key, text in FIELDS:
        df = table(spark, sf_dir, name, key, text).select(F.lit(name).alias("src"), F.col(key).alias("row_id"), F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return with_form(out, "text").drop("text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one table whose titles or texts differ as strings but look the same."""
    a, b = (pairs_of(table(spark, sf_dir, name, key, text), key, text, name) for name, key, text in FIELDS)
    return a.unionByName(b)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title of posts and text of coded items with its class of rows that look the same, its size and its different spellings."""
    a, b = (classes_of(table(spark, sf_dir, name, key, text), key, text, name) for name, key, text in FIELDS)
    return a.unionByName(b)
