"""Token statistics: frequencies, signals, co-occurrence, phrases, topics, clusters.

Texts are token arrays; windows and n-grams are made inside the array, so no row meets another before
the counts do. Ties are broken by name throughout.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.session import staged

#: Added before rounding sums of floats, so that ties don't depend on the order of summation.
HAIR = 1e-9
#: Words that the segmenter knows besides pairs of Han characters.
DICTIONARY = (*C.LEXICON, "说明书", "充电头", "随手就能用", "性价比", "新版本")


def token_pattern(dictionary: Sequence[str] = DICTIONARY, han: str = r"\p{IsHan}") -> str:
    """Known words first, longest first; then words of letters, then pairs of Han characters."""
    words = sorted(set(dictionary), key=lambda w: (-len(w), w))
    return "|".join(re.escape(w) for w in words) + rf"|[a-z][a-z0-9]+|{han}{{2}}"


def segment(text: Column, dictionary: Sequence[str] = DICTIONARY, stop: Sequence[str] = C.STOPWORDS) -> Column:
    """Tokens of at least two characters, without stop words; null and empty texts have none."""
    got = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({token_pattern(dictionary)})"), F.lit(1))
    return F.filter(got, lambda w: ~w.isin(*stop)) if stop else got


def word_freq(docs: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent tokens of (doc, tokens)."""
    n = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "word").limit(k)


def token_signal(docs: DataFrame) -> DataFrame:
    """Per token: documents, sums of positive and of negative scores, and their balance from -1 to 1. docs: (tokens, score)."""
    rows = docs.select(F.explode(F.array_distinct("tokens")).alias("word"), "score")
    p = F.sum(F.greatest("score", F.lit(0.0)))
    q = F.sum(F.greatest(-F.col("score"), F.lit(0.0)))
    got = rows.groupBy("word").agg(F.count("*").alias("docs"), p.alias("p"), q.alias("q"))
    return got.select("word", "docs", F.round(F.col("p") + HAIR, 4).alias("pos"), F.round(F.col("q") + HAIR, 4).alias("neg"), F.round(F.when(F.col("p") + F.col("q") > 0, (F.col("p") - F.col("q")) / (F.col("p") + F.col("q"))).otherwise(0.0) + HAIR, 4).alias("signal"))


def cloud_weights(signal: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Weights of the words of a cloud: strong signals, and weak ones that the lexicon agrees with. lexicon: (word, score)."""
    rows = signal.join(lexicon, "word", "left")
    agrees = F.coalesce(F.signum("score") == F.signum("signal"), F.lit(False))
    keep = (F.abs("signal") >= C.CLOUD_STRONG) | ((F.abs("signal") >= C.CLOUD_WEAK) & agrees)
    weight = (F.col("pos") + F.col("neg")) * F.least("docs", F.lit(C.CLOUD_CAP)) * F.abs("signal")
    return rows.where(keep).select("word", "docs", "signal", F.round(weight + HAIR, 3).alias("weight"))


def sentiment_sources(docs: DataFrame, least: int = C.SOURCE_LEAST, k: int = C.SOURCE_TOP) -> DataFrame:
    """Words by the share of negative among their positive and negative documents. docs: (tokens, sentiment)."""
    rows = docs.where(F.col("sentiment").isin("positive", "negative")).select(F.explode(F.array_distinct("tokens")).alias("word"), "sentiment")
    neg, n = F.count_if(F.col("sentiment") == "negative"), F.count("*")
    got = rows.groupBy("word").agg(n.alias("total"), neg.alias("negative"), F.round(neg / n, 3).alias("rate")).where(F.col("total") >= least)
    return got.orderBy(F.desc("rate"), F.desc("total"), "word").limit(k)


def pairs_in_window(tokens: Column, window: int = C.COOC_WINDOW) -> Column:
    """The distinct unordered pairs of different tokens at most window places apart."""
    n = F.size(tokens)
    apart = lambda k: F.zip_with(F.slice(tokens, 1, F.greatest(n - k, F.lit(0))), F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0))), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    return F.array_distinct(F.filter(F.concat(*[apart(k) for k in range(1, window + 1)]), lambda x: x.a != x.b))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(word, n): in how many of (tokens) each word occurs."""
    return docs.select(F.explode_outer(F.array_distinct("tokens")).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


def tokenised(docs: DataFrame) -> DataFrame:
    """The documents with a token, segmented once and staged."""
    return staged(docs.where(F.size("tokens") > 0), "tokens")


def cooccurrence(docs: DataFrame, window: int = C.COOC_WINDOW, least: int = C.COOC_LEAST, k: int | None = C.COOC_TOP) -> DataFrame:
    """Pairs of tokens near each other in at least `least` documents, with PMI by document frequencies; the k heaviest.

    Documents without a token don't count. docs: (tokens), segmented already where several steps use them.
    """
    rows = docs.where(F.size("tokens") > 0)
    n = rows.count()
    words = document_frequency(rows).where(F.col("n") >= least).select(F.col("word").alias("w"), F.col("n").alias("df"))
    # an outer explode: the filter that Spark infers for an inner one would compute the pairs again below it
    pairs = rows.select(F.explode_outer(pairs_in_window(F.col("tokens"), window)).alias("p")).where("p is not null").groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    side = lambda x: words.select(F.col("w").alias(x), F.col("df").alias(f"n_{x}"))
    got = pairs.join(side("a"), "a").join(side("b"), "b")
    pmi = F.ln(F.col("n").cast("double") * n / (F.col("n_a") * F.col("n_b")))
    got = got.select(F.col("a").alias("source"), F.col("b").alias("target"), "n", F.round(pmi, 3).alias("weight"))
    return got if k is None else got.orderBy(F.desc("weight"), F.desc("n"), "source", "target").limit(k)


def node_degree(edges: DataFrame) -> DataFrame:
    """Degree and total weight of the words of an edge list."""
    ends = edges.select(F.col("source").alias("word"), "weight").unionByName(edges.select(F.col("target").alias("word"), "weight"))
    return ends.groupBy("word").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 3).alias("strength"))


def trim_graph(edges: DataFrame, words: DataFrame, nodes: int = C.GRAPH_NODES, most: int = C.GRAPH_EDGES) -> DataFrame:
    """The edges among the nodes in most documents, heaviest first. words: (word, n), document frequencies."""
    ends = edges.select(F.col("source").alias("word")).unionByName(edges.select(F.col("target").alias("word"))).distinct()
    top = ends.join(words, "word").orderBy(F.desc("n"), "word").limit(nodes).select("word")
    kept = edges.join(top.withColumnRenamed("word", "source"), "source", "left_semi").join(top.withColumnRenamed("word", "target"), "target", "left_semi")
    return kept.orderBy(F.desc("weight"), F.desc("n"), "source", "target").limit(most).select("source", "target", "n", "weight")


def pair_rows(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent pairs."""
    return edges.orderBy(F.desc("n"), "source", "target").limit(k).select("source", "target", "n")


def ngrams(tokens: Column, lo: int = 2, hi: int = 5) -> Column:
    """The n-grams of a token array as structs of first and last word and the phrase: letters joined by spaces, others without."""
    def of(k: int) -> Column:
        n = F.size(tokens)
        at = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice(tokens, i, k))
        made = F.transform(at, lambda g: F.struct(F.element_at(g, 1).alias("a"), F.element_at(g, -1).alias("b"), F.when(F.array_join(g, "").rlike("^[a-z0-9]+$"), F.array_join(g, " ")).otherwise(F.array_join(g, "")).alias("phrase")))
        return F.when(n >= k, made).otherwise(F.array().cast("array<struct<a:string,b:string,phrase:string>>"))

    return F.concat(*[of(k) for k in range(lo, hi + 1)])


def phrases(docs: DataFrame, least: int = C.PHRASE_LEAST, pmi: float = C.PHRASE_PMI, relaxed: float = C.PHRASE_PMI_RELAXED, hi: int = 5) -> DataFrame:
    """Phrases of two and more tokens in at least `least` documents whose first and last words go together.

    docs: (doc, tokens, score). A phrase of clear sentiment passes with a lower PMI. Each with its first document as a sample.
    """
    rows = docs.select("doc", "score", F.explode_outer(F.array_distinct(ngrams(F.col("tokens"), 2, hi))).alias("g")).where("g is not null").select("doc", "score", "g.*").where(F.length("phrase") <= C.PHRASE_LONGEST)
    words = docs.select(F.explode_outer(F.array_distinct("tokens")).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("df"))
    n = docs.count()
    ids = F.array(F.min("doc"))  # one sample: a list of all documents of a hot phrase has no bound
    got = rows.groupBy("a", "b", "phrase").agg(F.count_distinct("doc").alias("n"), F.round(F.avg("score") + HAIR, 3).alias("sentiment"), ids.alias("samples")).where(F.col("n") >= least)
    side = lambda x: words.select(F.col("w").alias(x), F.col("df").alias(f"n_{x}"))
    got = got.join(side("a"), "a").join(side("b"), "b").withColumn("pmi", F.round(F.ln(F.col("n").cast("double") * n / (F.col("n_a") * F.col("n_b"))), 3))
    return got.where((F.col("pmi") >= pmi) | ((F.col("pmi") >= relaxed) & (F.abs("sentiment") >= 0.25))).select("phrase", "n", "pmi", "sentiment", "samples")


def suppressed(found: DataFrame, k: int = C.PHRASE_TOP) -> DataFrame:
    """The k best phrases, without those that a longer one of at least their count holds.

    A phrase that suppresses and is suppressed itself has a longer one that holds both, so one look suffices: every phrase
    offers its count to the pieces of itself, of which it has few.
    """
    n = F.length("phrase")
    lengths = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    pieces = F.flatten(F.transform(lengths, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(F.col("phrase"), i, w))))
    longer = found.where(n > 1).select("n", F.explode(F.array_distinct(pieces)).alias("phrase")).groupBy("phrase").agg(F.max("n").alias("most"))
    kept = found.join(longer, "phrase", "left").where(F.coalesce(F.col("most") < F.col("n"), F.lit(True))).drop("most")
    return kept.orderBy(F.desc(F.col("n") * (1 + F.col("pmi"))), "phrase").limit(k)


def topics(found: DataFrame, groups: dict[str, Sequence[str]] = C.SYNONYM_TOPICS, least: int = 2) -> DataFrame:
    """Phrases coded to the first topic any of whose words they hold: documents by sample, and main polarity."""
    rule = F.lit(None).cast("string")
    for name, words in reversed(list(groups.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.col("phrase"), F.lit(w))
        rule = F.when(hit, name).otherwise(rule)
    side = F.when(F.col("sentiment") > 0.15, "positive").when(F.col("sentiment") < -0.15, "negative").otherwise("neutral")
    rows = found.withColumn("topic", rule).where("topic is not null").withColumn("polarity", side)
    return rows.groupBy("topic", "polarity").agg(F.count("*").alias("phrases"), F.sum("n").alias("mentions")).where(F.col("phrases") >= least)


def dominant_dimension(docs: DataFrame) -> DataFrame:
    """The aspect that most documents of a token mention, ties by name. docs: (tokens, dims)."""
    n = docs.select(F.explode(F.array_distinct("tokens")).alias("word"), "dims").select("word", F.explode("dims").alias("dim")).groupBy("word", "dim").agg(F.count("*").alias("n"))
    return n.groupBy("word").agg(F.min_by("dim", F.struct(-F.col("n"), "dim")).alias("dim"), F.max("n").alias("n"))


def communities(edges: list[tuple[str, str, float]], most: int = C.CLUSTERS_MOST) -> list[list[str]]:
    """Communities (of one level, by local moves only) of a small weighted graph by moving nodes to the neighbour community that gains most modularity.

    Deterministic: nodes in order of name, ties to the smallest community name. More than `most` are
    merged: the largest stay, the rest become one. The graph is bounded (GRAPH_NODES).
    """
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    near: dict[str, dict[str, float]] = {x: {} for x in nodes}
    for a, b, w in edges:
        w = max(w, 1e-9)
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    total = sum(sum(v.values()) for v in near.values()) or 1.0
    strength = {x: sum(near[x].values()) for x in nodes}
    home = {x: x for x in nodes}
    for _ in range(50):
        moved = False
        for x in nodes:
            size: dict[str, float] = {}
            for y in nodes:
                if y != x:
                    size[home[y]] = size.get(home[y], 0) + strength[y]
            gain = {c: sum(w for y, w in near[x].items() if home[y] == c and y != x) - strength[x] * size.get(c, 0) / total for c in {home[y] for y in near[x]} | {home[x]}}
            best = min(gain, key=lambda c: (-round(gain[c], 9), c))
            if gain[best] > gain[home[x]] + 1e-9:
                home[x], moved = best, True
        if not moved:
            break
    groups: dict[str, list[str]] = {}
    for x in nodes:
        groups.setdefault(home[x], []).append(x)
    out = sorted(groups.values(), key=lambda g: (-len(g), g))
    return out if len(out) <= most else [*out[: most - 1], sorted(x for g in out[most - 1 :] for x in g)]


def cluster_docs(docs: DataFrame, clusters: list[list[str]]) -> DataFrame:
    """Documents that hold any member of each cluster (each document once), and how many are negative. docs: (tokens, sentiment)."""
    members = [F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(w) for w in c]).alias("members")) for i, c in enumerate(clusters)]
    if not members:
        return docs.sparkSession.createDataFrame([], "cluster int, doc_count long, negative long, rate double")
    rows = docs.select("sentiment", "tokens", F.explode(F.array(*members)).alias("c")).where(F.arrays_overlap("tokens", "c.members"))
    neg = F.count_if(F.col("sentiment") == "negative")
    return rows.groupBy(F.col("c.cluster").alias("cluster")).agg(F.count("*").alias("doc_count"), neg.alias("negative"), F.round(neg / F.count("*"), 3).alias("rate"))


def cluster_view(total: int, edges: list[tuple[str, str, float]]) -> tuple[str, list[list[str]]]:
    """Which view a graph is good for (none, pairs or clusters), and its clusters: too small or too lopsided graphs show pairs."""
    if total < C.CLUSTER_TOTAL or not edges:
        return "none", []
    nodes = {x for a, b, _ in edges for x in (a, b)}
    if len(edges) < C.CLUSTER_EDGES or len(nodes) < C.CLUSTER_NODES:
        return "pairs", []
    found = communities(edges)
    return ("pairs", []) if max(map(len, found)) > 0.9 * len(nodes) else ("clusters", found)


def hub_words(edges: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """The k words of most weight: degree times frequency."""
    return node_degree(edges).join(words, "word").select("word", (F.col("degree") * F.col("n")).alias("hub")).orderBy(F.desc("hub"), "word").limit(k)

