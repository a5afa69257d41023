"""Keyword-stuffed and link-list pages, told from prose by their rank-frequency curve.

Method: a page's terms (pairs of Han characters, words of other scripts, numbers as one term) are
counted, and SQL windows over its frequency spectrum (so many terms of that frequency) give the ranks:
ln frequency is fitted against ln rank, which yields slope and residual. The page's divergence is that of
its term distribution from prose of its script. Every measure is held against pages of comparable length
by median and median deviation. A first pass finds the calm pages, whose terms make up the prose
background; in the second, a page with an extreme slope, residual or divergence against calm pages of its
length is a case if the background can't explain its bulk. A phrase repeated inside a review is told from
a stuffed page by looking at the page with its repeated clauses folded.

All statistics are over distinct texts: copies have one vote together. Pages of any length are judged.
Defined results: null, empty and blank texts and those without a term are no cases; copies are judged
alike, each under its own doc_id. Whole texts count, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid.llm.codepoints import points_of, slices, strings_of
from voxgrid.session import staged, table

#: Terms that a page must have.
LEAST = 1
#: A length group with fewer pages borrows the figures of the nearest longer or shorter one.
GROUP = 20
#: Half-octaves of length on either side whose medians smooth those of a group in the first pass.
SMOOTH = 2
#: Vocabularies up to this many terms (under 20 MB) are broadcast; of larger ones, the terms with a share of COMMON or more
#: (1 / COMMON of each script at most) are, and the others, none of which is frequent, are joined by shuffle.
BROADCAST_TERMS, COMMON = 200_000, 1e-4
#: Deviations (in median deviations) from which a measure is extreme, in the first and the second pass.
EXTREME, DIVERGENT = 3.5, 3.8
#: Share of a page that prose can't explain: alone, or together with the same share of the folded page.
BULK, SHARED_BULK = 0.62, 0.38
#: What a page may repeat: once per known term, and twice its expected number.
ALLOWED, TIMES, FLOOR = 1, 2, 1e-4
#: Copies of a page may be a third of all: the join from pages to rows is spread over so many parts.
SALTS = 8


def _folded(text: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(text, r"[，,。！？!?；;～\r\n]+|\.\s")), "，")


class Terms:
    """The terms of a batch of texts, counted: page, hash and count of each, and the places of one of them."""

    def __init__(self, texts: pa.Array):
        cps, row = points_of(texts)
        digit = (cps >= 48) & (cps <= 57)
        keep = ~digit
        keep[1:] |= digit[1:] & ~(digit[:-1] & (row[1:] == row[:-1]))
        keep[:1] = True
        self.cps, row = np.where(digit, 48, cps)[keep], row[keep]
        cps, n = self.cps, int(keep.sum())
        han = ((cps >= 0x4E00) & (cps <= 0x9FFF)) | ((cps >= 0x3400) & (cps <= 0x4DBF)) | (cps == 0x3005) | (cps == 0x3007) | ((cps >= 0xF900) & (cps <= 0xFAFF)) | ((cps >= 0x20000) & (cps <= 0x323AF))
        letter = _letters()[cps] & ~han
        same = np.zeros(n, bool)
        same[1:] = row[1:] == row[:-1]
        first = letter.copy()
        first[1:] &= ~(letter[:-1] & same[1:])
        at = np.flatnonzero(first)
        word = np.cumsum(first) - 1
        spot = np.flatnonzero(letter)
        power = np.cumprod(np.full(65, 0x100000001B3, np.uint64))
        h = np.zeros(len(at), np.uint64)
        if len(spot):
            place = (spot - at[word[spot]]) % 64
            starts = np.searchsorted(spot, at)
            h = np.add.reduceat((cps[spot].astype(np.uint64) + np.uint64(7)) * power[place], starts)
            size = np.diff(np.append(starts, len(spot)))
        else:
            size = np.zeros(0, np.int64)
        pair = np.flatnonzero(han[:-1] & han[1:] & same[1:]) if n else np.empty(0, np.int64)
        number = np.flatnonzero(cps == 48)
        hashes = np.concatenate((h * np.uint64(0x9E3779B97F4A7C15), (cps[pair].astype(np.uint64) << np.uint64(21) | cps[pair + 1].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9), np.full(len(number), 0x5851F42D4C957F2D, np.uint64)))
        hashes ^= hashes >> np.uint64(31)
        places, sizes = np.concatenate((at, pair, number)), np.concatenate((size, np.full(len(pair), 2), np.ones(len(number), np.int64))).astype(np.int64)
        rows = row[places]
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        edge = np.ones(len(order), bool)
        edge[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        edge = np.flatnonzero(edge)
        self.k = np.diff(np.append(edge, len(order))).astype(np.int64)
        self.page, self.w = rows[edge], hashes[edge].view(np.int64)
        self.place, self.size = places[order][edge], sizes[order][edge]
        count = np.bincount(row, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
        self.han = np.bincount(row, weights=han, minlength=len(texts)) > 0.15 * np.maximum(count, 1) if n else np.zeros(len(texts), bool)
        self.n = np.bincount(self.page, weights=self.k, minlength=len(texts)).astype(np.int64)
        self.v = np.bincount(self.page, minlength=len(texts))

    def words(self) -> pa.Array:
        """The terms as strings."""
        total = int(self.size.sum())
        at = np.repeat(self.place - np.concatenate(([0], np.cumsum(self.size)[:-1])), self.size) + np.arange(total)
        return strings_of(self.cps[at], np.repeat(np.arange(len(self.size)), self.size), pa.array(np.zeros(len(self.size), np.int8)))


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        for a, b in ((0x41, 0x3400), (0xA000, 0x20000)):
            table[a:b] = [chr(c).isalpha() for c in range(a, b)]
        _LETTERS.append(table)
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def counted(df: DataFrame, words: bool = False) -> DataFrame:
    """One row per row of (id, text) with a term: script, number of terms n and of distinct ones v, and its term counts.

    Terms are 64-bit hashes, or strings for words; id may have any columns but text.
    """
    names = [c for c in df.columns if c != "text"]
    kind = "string" if words else "long"
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(names)):
                got = Terms(part.column(len(names)))
                some = pa.array(np.flatnonzero(got.n >= LEAST))
                ends = np.concatenate(([0], np.cumsum(got.v[some.to_numpy()]))).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([got.words() if words else pa.array(got.w), pa.array(got.k)], ["w", "k"]))
                script = pa.array(np.where(got.han, "han", "other")).take(some)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(some) for i in range(len(names))], script, pa.array(got.n).take(some), pa.array(got.v.astype(np.int64)).take(some), terms], [*names, "script", "n", "v", "terms"])

    return df.select(*names, F.lower("text").alias("text")).where("text is not null").mapInArrow(run, f"{ids}, script string, n long, v long, terms array<struct<w:{kind},k:long>>")


#: Sums of ln r and of its square over the ranks up to some r, beyond which a series gives them.
_RANKS = 32
_LN = [0.0, *(math.fsum(math.log(r) for r in range(1, m + 1)) for m in range(1, _RANKS + 1))]
_LN2 = [0.0, *(math.fsum(math.log(r) ** 2 for r in range(1, m + 1)) for m in range(1, _RANKS + 1))]


def _series(r, ln, square: bool):
    """The sum of ln r (or of its square) over the ranks up to r, less a constant; for floats and columns."""
    if not square:
        return r * ln - r + ln / 2 + 1 / (12 * r) - 1 / (360 * r * r * r) + 1 / (1260 * r * r * r * r * r)
    return r * ln * ln - 2 * r * ln + 2 * r + ln * ln / 2 + ln / (6 * r) - (4 * ln - 6) / (720 * r * r * r) + (48 * ln - 100) / (30240 * r * r * r * r * r)


_REST = {sq: (_LN2 if sq else _LN)[_RANKS] - _series(float(_RANKS), math.log(_RANKS), sq) for sq in (False, True)}


def _summed(r: Column, square: bool = False) -> Column:
    few = F.element_at(F.array(*[F.lit(x) for x in (_LN2 if square else _LN)]), F.least(r, F.lit(_RANKS)).cast("int") + 1)
    many = F.greatest(r, F.lit(_RANKS)).cast("double")
    return F.when(r <= _RANKS, few).otherwise(_series(many, F.ln(many), square) + _REST[square])


def fits(counts: DataFrame, *key: str) -> DataFrame:
    """(key, slope, residual) of pages: ln frequency against ln rank, by windows over each page's frequency spectrum."""
    spectrum = counts.select(*key, "v", F.explode(F.transform("terms", lambda t: t.k)).alias("k")).groupBy(*key, "v", "k").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy(*key).orderBy(F.desc("k")))
    y = F.ln(F.col("k").cast("double"))
    got = spectrum.withColumn("r", upto).groupBy(*key, "v").agg(
        F.sum(F.col("m") * y).alias("y"), F.sum(F.col("m") * y * y).alias("yy"), F.sum(y * (_summed(F.col("r")) - _summed(F.col("r") - F.col("m")))).alias("xy"),
    )
    v = F.col("v").cast("double")
    got = got.withColumn("x", _summed(F.col("v"))).withColumn("sxx", _summed(F.col("v"), True) - F.col("x") * F.col("x") / v)
    got = got.withColumn("sxy", F.col("xy") - F.col("x") * F.col("y") / v).withColumn("syy", F.greatest(F.col("yy") - F.col("y") * F.col("y") / v, F.lit(0.0)))
    slope = F.when(F.col("v") > 1, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    return got.withColumn("slope", slope).select(*key, "slope", F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / v).alias("residual"))


def pages(df: DataFrame) -> DataFrame:
    """One row per page of (doc_id, text): script, number of terms, slope and residual, and its terms with their counts."""
    counts = staged(counted(df.select("doc_id", "text"), words=True), "pages")
    return counts.join(fits(counts, "doc_id"), "doc_id").select("doc_id", "script", "n", "slope", "residual", "terms")


def background(terms: DataFrame) -> DataFrame:
    """The mean share of each term in the pages of a script; every page has one vote."""
    votes = terms.select("script", "n", F.explode("terms").alias("t")).groupBy("script", F.col("t.w").alias("w")).agg(F.sum(F.col("t.k") / F.col("n")).alias("q"))
    size = terms.groupBy("script").agg(F.count("*").alias("m"))
    return votes.join(F.broadcast(size), "script").select("script", "w", (F.col("q") / F.col("m")).alias("q"))


def against(terms: DataFrame, prose: DataFrame, *key: str) -> DataFrame:
    """(key, script, n, kl, excess) of pages: divergence from the background prose, a table, and the share it can't explain."""
    rows = terms.select(*key, "script", "n", F.explode("terms").alias("t")).select(*key, "script", "n", "t.w", "t.k")
    p = F.col("k") / F.col("n")

    def judged(joined: DataFrame) -> DataFrame:
        joined = joined.withColumn("q", F.coalesce("q", F.lit(0.0)))
        explained = F.least(F.col("k").cast("double"), F.when(F.col("q") > FLOOR, ALLOWED).otherwise(0) + TIMES * F.col("n") * F.col("q"))
        return joined.groupBy(*key, "script", "n").agg(F.sum(p * F.ln(p / (F.col("q") + 1e-5))).alias("kl"), F.sum(explained).alias("explained"))

    if prose.count() <= BROADCAST_TERMS:
        got = judged(rows.join(F.broadcast(prose), ["script", "w"], "left"))
    else:
        common = F.broadcast(prose.where(F.col("q") >= COMMON))
        rare = rows.join(common, ["script", "w"], "left_anti").join(prose.where(F.col("q") < COMMON), ["script", "w"], "left")
        got = judged(rows.join(common, ["script", "w"])).unionByName(judged(rare)).groupBy(*key, "script", "n").agg(F.sum("kl").alias("kl"), F.sum("explained").alias("explained"))
    return got.select(*key, "script", "n", "kl", (1 - F.col("explained") / F.col("n")).alias("excess"))


def deviations(df: DataFrame, *measures: str, calm: Column | None = None) -> DataFrame:
    """df with z_<measure>: the distance from the median of pages of the script and of comparable length.

    calm: the pages that medians are taken from. Without it they are taken from all, and those of a group are smoothed by
    its neighbours', so that no group defines what is normal for itself.
    """
    df = df.withColumn("size", F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int"))
    seen = df if calm is None else df.where(calm)
    by = W.partitionBy("script").orderBy("size")
    below, above, around = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(0, W.unboundedFollowing), by.rangeBetween(-SMOOTH, SMOOTH)

    def settled(stats: DataFrame, names: list[str]) -> DataFrame:
        for c in names:
            full = F.when(F.col("pages") >= GROUP, F.col(c))
            stats = stats.withColumn(f"u{c}", F.coalesce(F.last(full, True).over(below), F.first(full, True).over(above), F.col(c)))
            if calm is None:
                some = F.array_sort(F.collect_list(f"u{c}").over(around))
                stats = stats.withColumn(f"u{c}", F.element_at(some, F.floor((F.size(some) + 1) / 2).cast("int")))
        return stats.select("script", "size", "pages", *[F.col(f"u{c}").alias(c) for c in names])

    ms, ds = [f"m_{m}" for m in measures], [f"d_{m}" for m in measures]
    mid = seen.groupBy("script", "size").agg(F.count("*").alias("pages"), *[F.percentile_approx(m, 0.5, 1000).alias(f"m_{m}") for m in measures])
    # every length that occurs has a row, those without calm pages too
    mid = df.select("script", "size").distinct().join(mid, ["script", "size"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    mid = staged(settled(mid, ms), "medians")
    off = seen.join(F.broadcast(mid), ["script", "size"]).groupBy("script", "size").agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"m_{m}")), 0.5, 1000).alias(f"d_{m}") for m in measures])
    stats = settled(mid.join(off, ["script", "size"], "left"), ds).drop("pages").join(mid.drop("pages"), ["script", "size"])
    df = df.join(F.broadcast(stats), ["script", "size"])  # two scripts, and a row for each half-octave
    z = [((F.col(m) - F.col(f"m_{m}")) / (1.4826 * F.col(f"d_{m}") + 0.03)).alias(f"z_{m}") for m in measures]
    return df.select(*[c for c in df.columns if c not in (*ms, *ds, "size")], *z)


def scored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Every page of (doc_id, text) with its measures and the verdict.

    Columns: doc_id, n, slope, residual, divergence, z_slope, z_residual, excess, folded, found.
    """
    key = ("h1", "h2")
    hashed = lambda *cols: [*cols, *[F.xxhash64(F.lit(i), "text").alias(k) for i, k in enumerate(key)]]
    texts = df.select("text").where("text is not null").distinct().select(*hashed("text"))
    terms = staged(counted(texts.select(*key, "text")), "pages")
    curves = staged(fits(terms, *key), "curves")
    prose = staged(background(terms), "prose")
    first = staged(against(terms, prose, *key).join(curves, list(key)), "first")
    z = deviations(first, "slope", "residual", "kl")
    calm = staged(z.where((F.abs("z_slope") < EXTREME + 1) & (F.col("z_residual") < EXTREME + 1) & (F.col("z_kl") < EXTREME)).select(*key), "calm")
    prose = staged(background(terms.join(calm, list(key), "left_semi")), "background")
    second = against(terms, prose, *key).join(curves, list(key)).join(calm.withColumn("calm", F.lit(True)), list(key), "left")
    second = deviations(staged(second, "second"), "slope", "residual", "kl", calm=F.col("calm"))
    extreme = (F.col("z_kl") >= DIVERGENT) | (F.abs("z_slope") >= DIVERGENT) | (F.col("z_residual") >= DIVERGENT)
    second = staged(second.withColumn("extreme", F.coalesce(extreme, F.lit(False))).drop("calm"), "judged")
    doubt = second.where((F.col("z_kl") >= DIVERGENT) & (F.col("excess") >= SHARED_BULK) & (F.col("excess") < BULK)).select(*key)
    again = texts.join(doubt, list(key), "left_semi").select(*key, _folded(F.col("text")).alias("text"))
    folded = against(staged(counted(again), "folded"), prose, *key).select(*key, F.col("excess").alias("folded"))
    # a page that diverges may share its bulk with the folded one; an extreme curve alone needs the whole bulk
    bulk = (F.col("excess") >= BULK) | (F.coalesce("folded", F.lit(0.0)) >= SHARED_BULK)
    out = second.join(folded, list(key), "left").select(*key, "n", "slope", "residual", F.col("z_kl").alias("divergence"), "z_slope", "z_residual", "excess", "folded", (F.col("extreme") & bulk).alias("found"))
    spread = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = df.where("text is not null").select(*hashed("doc_id")).withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    return rows.join(spread, [*key, "salt"]).drop(*key, "salt")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every page with a term."""
    return scored(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose bulk is repeated keywords, links, or tags and names instead of sentences."""
    return p10_scores(spark, sf_dir).where("found").select("doc_id")
