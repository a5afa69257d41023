"""Scores of abusive, hateful and sexually explicit language.

Method: a factorization machine over hashed terms (Han n-grams, words, word pairs and letter n-grams),
so that pairs of terms weigh more or less than their sum: an insult beside a group, a threat beside a
person, a harsh word beside a product. Disguises are undone before hashing: wide and look-alike
letters, signs set between characters, digits and signs in place of letters.

A text is scored by its worst sentence. Labels are per text, so training alternates between choosing
the sentence of a labelled text that carries the label and fitting; texts whose label the fitted model
contradicts strongly are left out of the last fit, as a few labels are wrong. The model is fitted on
the driver on at most LABELS labelled rows (a documented bound; by hash of their key) and travels to
the workers as a broadcast of fixed size; every row is scored.

Defined results: null and blank texts score 0 and are no cases; repeated rows score alike; with no
labels at all, or labels of one kind only, nothing is found. Whole texts are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.llm.private import folded
from voxgrid.session import table

#: The bound on labelled rows, the hashed space, the rank of interactions.
LABELS, SPACE, RANK = 20_000, 1 << 18, 8
#: Epochs of each round of fitting, rounds, step size, decay, and units of one step.
EPOCHS, ROUNDS, STEP, DECAY, BATCH = 5, 3, 0.15, 1e-4, 256
#: The logit that a sentence starts from: most are harmless, whatever their share among the labelled ones.
PRIOR = -2.0
#: Sentences whose score a worker keeps; when full it starts over.
KEPT = 300_000
#: A text is a case from this probability on.
CASE = 0.35

_END = re.compile(r"[。！？!?～~；;…\r\n]+|(?<=[A-Za-z0-9])\.(?:\s|$)")
_BETWEEN = re.compile(r"(?<=[㐀-鿿])[\s*.·_~^`'\-]+(?=[㐀-鿿])")
#: Numbers and model codes say nothing; sentences that differ in them are scored once.
_NUMBER = re.compile(r"(?<![A-Za-z])[0-9]{2,}(?![A-Za-z])|(?<![A-Za-z])[A-Z]{2,3}[0-9]{4,}")
_MIXED = re.compile(r"(?:[a-z]+[0-9$@*!]|[0-9$@*!]+[a-z])[a-z0-9$@*!]*")
#: Signs that stand for letters inside a word.
_LEET = str.maketrans("013457$@!", "oieastsai")


def plain(sentence: str) -> str:
    """A sentence in the form that terms are taken from."""
    t = _BETWEEN.sub("", folded(sentence)[0].lower())

    def word(m: re.Match[str]) -> str:
        w = m.group()
        return w.translate(_LEET).replace("*", "") if sum(c.isalpha() for c in w) * 5 >= len(w.strip("!*")) * 2 else w

    return _MIXED.sub(word, t)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, as they stand but for numbers."""
    return [s for x in _END.split(text) if (s := _NUMBER.sub("0", x.strip(" ,，.、")))] if text else []


def terms(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the units and the hashed distinct terms of each, unit by unit."""
    whole = "\n".join(map(plain, units))
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.uint64)
    line = np.cumsum(cps == 10) - (cps == 10)
    han = (cps >= 0x3400) & (cps < 0xA000)
    letter = ((cps >= 97) & (cps <= 122)) | ((cps >= 0xC0) & (cps < 0x250)) | (cps == 39)
    digit = (cps >= 48) & (cps <= 57)
    solid = han | letter | digit
    h = lambda *xs: (sum((x * np.uint64(p) for x, p in zip(xs, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), strict=False)), np.uint64(0)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    rows, feats = [], []

    def put(at: np.ndarray, code: np.ndarray, kind: int) -> None:
        rows.append(line[at])
        feats.append(((code + np.uint64(kind * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(30)) % np.uint64(SPACE))

    n = len(cps)
    one = np.flatnonzero(han)
    put(one, h(cps[one]), 1)
    for size, kind in ((2, 2), (3, 3)):
        ok = np.ones(max(n - size + 1, 0), bool)
        some = np.zeros(max(n - size + 1, 0), bool)
        for j in range(size):
            ok &= solid[j : n - size + 1 + j]
            some |= han[j : n - size + 1 + j]
        at = np.flatnonzero(ok & some)
        put(at, h(*[cps[at + j] for j in range(size)]), kind)
    if n >= 4:
        ok = letter[: n - 3] & letter[1 : n - 2] & letter[2 : n - 1] & letter[3:]
        at = np.flatnonzero(ok)
        put(at, h(*[cps[at + j] for j in range(4)]), 4)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = np.flatnonzero(first)
    if len(at):
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        power = np.cumprod(np.full(64, 1_000_003, np.uint64))
        code = np.add.reduceat(np.where(letter, cps * power[np.minimum(place, 63)], np.uint64(0)), at)
        put(at, code, 5)
        near = np.flatnonzero(line[at][1:] == line[at][:-1]) if len(at) > 1 else np.empty(0, np.int64)
        put(at[near], code[near] * np.uint64(31) + code[near + 1], 6)
        two = np.flatnonzero(line[at][2:] == line[at][:-2]) if len(at) > 2 else np.empty(0, np.int64)
        put(at[two], code[two] * np.uint64(131) + code[two + 2], 7)
    key = np.sort(np.concatenate(rows).astype(np.int64) * SPACE + np.concatenate(feats).astype(np.int64))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return np.searchsorted(key, np.arange(len(units) + 1, dtype=np.int64) * SPACE), key % SPACE


class Machine:
    """A factorization machine with logistic loss; terms of a unit are scaled to length one."""

    def __init__(self) -> None:
        rng = np.random.default_rng(9)
        self.bias = PRIOR
        self.linear = np.zeros(SPACE, np.float32)
        self.pair = rng.normal(0, 0.05, (SPACE, RANK)).astype(np.float32)
        self._seen = np.full((SPACE, RANK + 1), 1e-2, np.float32)

    def raw(self, start: np.ndarray, feat: np.ndarray) -> np.ndarray:
        """The logit of each unit."""
        n = np.diff(start)
        row = np.repeat(np.arange(len(n)), n)
        scale = 1 / np.sqrt(np.maximum(n, 1))
        total = np.bincount(row, weights=self.linear[feat], minlength=len(n)) * scale
        for k in range(RANK):
            v = self.pair[feat, k]
            total += 0.5 * (np.bincount(row, weights=v, minlength=len(n)) ** 2 - np.bincount(row, weights=v * v, minlength=len(n))) * scale**2
        return np.where(n > 0, total + self.bias, -30.0)  # a sentence without terms, of emoji or signs, says nothing

    def fit(self, start: np.ndarray, feat: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                b = order[at : at + BATCH]
                n = start[b + 1] - start[b]
                live = np.repeat(start[b] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                f, row = feat[live], np.repeat(np.arange(len(b)), n)
                if not len(f):
                    continue
                scale = (1 / np.sqrt(np.maximum(n, 1)))[row][:, None]
                v = self.pair[f] * scale
                by_row = lambda x: np.bincount(row, weights=x, minlength=len(b))  # noqa: B023, E731
                sums = np.stack([by_row(v[:, k]) for k in range(RANK)], 1)
                squares = by_row((v * v).sum(1))
                z = np.bincount(row, weights=self.linear[f] * scale[:, 0], minlength=len(b)) + 0.5 * ((sums**2).sum(1) - squares) + self.bias
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) * weight[b]
                g = np.concatenate((err[row][:, None] * scale, err[row][:, None] * scale * (sums[row] - v)), 1)
                place, inverse = np.unique(f, return_inverse=True)
                grad = np.stack([np.bincount(inverse, weights=g[:, k], minlength=len(place)) for k in range(RANK + 1)], 1)
                grad[:, 0] += DECAY * len(b) * self.linear[place]
                grad[:, 1:] += DECAY * len(b) * self.pair[place]
                self._seen[place] += grad**2
                step = STEP * grad / np.sqrt(self._seen[place])
                self.linear[place] -= step[:, 0]
                self.pair[place] -= step[:, 1:]
                self.bias -= 0.02 * err.mean()


def fitted(texts: list[str], labels: np.ndarray) -> Machine | None:
    """A machine fitted on labelled texts; None where the labels are of one kind or there are none."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    split = [sentences(t) or [""] for t in texts]
    owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
    start, feat = terms([s for u in split for s in u])
    y = labels[owner].astype(np.float64)
    per = np.bincount(owner)[owner]
    use, weight = np.ones(len(owner), bool), np.where(y > 0, 1 / per, 1.0)

    def pick(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(start)[i]
        live = np.repeat(start[:-1][i] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.concatenate(([0], np.cumsum(n))), feat[live]

    machine = Machine()
    for r in range(ROUNDS + 1):
        rows = np.flatnonzero(use)
        machine = Machine() if r == ROUNDS else machine
        machine.fit(*pick(rows), y[rows], weight[rows], EPOCHS * (2 if r == ROUNDS else 1), r)
        if r == ROUNDS:
            break
        score = machine.raw(start, feat)
        order = np.lexsort((-score, owner))
        top = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
        carries = np.zeros(len(owner), bool)
        carries[top] = True
        best = np.zeros(len(split))
        best[owner[top]] = score[top]
        use = np.where(y > 0, carries, True)
        weight = np.ones(len(owner))
        if r == ROUNDS - 1:
            wrong = np.where(labels > 0, best < -1.0, best > 2.0)
            use &= ~wrong[owner]
    return machine


class Scorer:
    """Scores texts by their worst sentence, keeping what it knows of sentences."""

    def __init__(self, machine: Machine | None):
        self.machine = machine
        self.kept: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text."""
        if self.machine is None:
            return np.zeros(len(texts))
        split = [sentences(t) for t in texts]
        new = list({s: None for u in split for s in u if s not in self.kept})
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list({s: None for u in split for s in u})
        got = self.kept if len(new) <= KEPT else dict(self.kept)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            z = np.clip(self.machine.raw(*terms(part)), -30, 30)
            got.update(zip(part, (1 / (1 + np.exp(-z))).tolist(), strict=True))
        return np.array([max((got[s] for s in u), default=0.0) for u in split])


_workers: dict[int, tuple[Scorer, object]] = {}


class SharedScorer:
    """A scorer whose machine travels to the workers as a broadcast: only the places that training touched."""

    def __init__(self, spark: SparkSession, machine: Machine | None):
        value = None
        if machine is not None:
            used = np.flatnonzero(machine.linear).astype(np.int32)
            value = (machine.bias, used, machine.linear[used].astype(np.float16), machine.pair[used].astype(np.float16))
        self.sent = spark.sparkContext.broadcast(value)

    def get(self) -> Scorer:
        value = self.sent.value
        if id(value) not in _workers:
            machine = None
            if value is not None:
                machine = Machine()
                machine.pair[:] = 0
                machine.bias, used, machine.linear[value[1]], machine.pair[value[1]] = value[0], value[1], value[2], value[3]
            _workers.clear()
            _workers[id(value)] = (Scorer(machine), value)
        return _workers[id(value)][0]


def scored(df: DataFrame, text: str, machine: Machine | None) -> DataFrame:
    """df with a score (0 to 1) in place of the text."""
    shared = SharedScorer(df.sparkSession, machine)
    names = [c for c in df.columns if c != text]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.get()
        for b in batches:
            s = scorer.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(s, pa.float64())], [*names, "score"])

    return df.mapInArrow(run, df.drop(text).select("*", F.lit(0.0).alias("score")).schema)


FIELDS = (("comments", "comment_seq"), ("coded_items", "item_seq"))


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    parts = [table(spark, sf_dir, n, k, "text", *more).select(F.lit(n).alias("src"), F.col(k).cast("bigint").alias("row_id"), "text", *more) for n, k in FIELDS]
    return parts[0].unionByName(parts[1])


def learned(spark: SparkSession, sf_dir: str) -> Machine | None:
    """The machine fitted on the labelled rows of a directory."""
    labels = table(spark, sf_dir, "abuse_labels", "src", "row_id", "abusive").groupBy("src", "row_id").agg(F.avg("abusive").alias("y"))
    labels = labels.orderBy(F.xxhash64("src", "row_id"), "src", "row_id").limit(LABELS)  # the bound on the training sample
    rows = _texts(spark, sf_dir).join(F.broadcast(labels), ["src", "row_id"]).where("text is not null").select("src", "row_id", "text", "y").collect()
    rows.sort(key=lambda r: (r.src, r.row_id))
    return fitted([r.text for r in rows], np.array([int(r.y >= 0.5) for r in rows]))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every comment and coded item."""
    return scored(_texts(spark, sf_dir), "text", learned(spark, sf_dir)).select("src", "row_id", F.round("score", 6).alias("score"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments and coded items that are abusive, hateful or sexually explicit."""
    return scored(_texts(spark, sf_dir), "text", learned(spark, sf_dir)).where(F.col("score") >= CASE).select("src", "row_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cases and mean score per table, platform and channel. Comments have their channel's platform."""
    channels = table(spark, sf_dir, "channels", "channel_id", "platform").groupBy("channel_id").agg(F.min("platform").alias("platform"))
    rows = scored(_texts(spark, sf_dir, "channel_id"), "text", learned(spark, sf_dir)).join(channels, "channel_id", "left")
    out = rows.groupBy("src", "platform", "channel_id").agg(F.count("*").alias("texts"), F.count_if(F.col("score") >= CASE).alias("cases"), F.round(F.avg("score"), 6).alias("mean_score"))
    return out.withColumn("rate", F.round(F.col("cases") / F.col("texts"), 6))
