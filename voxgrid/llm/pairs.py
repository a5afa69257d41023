"""Items that appear together: how often, and how that compares with chance.

Method: every pair of a record becomes one packed 64-bit code. Codes are sorted in runs inside the
tasks and run-length counted before anything is shuffled, so a hot pair is one row per run; Spark's
external sort (spilled sorted runs, multiway merge) brings equal codes together, and a second
run-length pass adds them up. Counts are compared with chance by odds ratios with a continuity
correction of one half.

Defined results: null and empty arrays hold no items, null and blank items don't count, an item
counts once per record, records are distinct by their key columns (nulls equal), and records without
items count in the number of records. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.session import staged, table

#: Codes that a task holds before it sorts and counts them: 8 bytes each.
RUN = 2_000_000
#: Dictionaries up to this many items travel to the tasks as a whole; larger ones are joined.
WHOLE_DICTIONARY = 50_000
#: Of larger dictionaries, items in more than one of FEW records are hot: at most FEW times the mean number of items of a record.
FEW = 2_000


def record_key(*cols: str) -> list[Column]:
    """128 bits of a record's key columns; nulls are told apart from every value."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"r{i}") for i in (1, 2)]


def item_sets(df: DataFrame, key: list[str], items: Column) -> DataFrame:
    """One row per distinct record: its distinct items. Repeats are removed before rows meet in one task."""
    rows = df.select(*record_key(*key), F.explode_outer(F.array_distinct(items)).alias("item")).distinct()
    return rows.groupBy("r1", "r2").agg(F.collect_set("item").alias("items")).select("items")


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The run lengths of equal codes."""
    if counts is None:
        codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    n = np.diff(np.append(edge, len(codes))) if counts is None else np.add.reduceat(counts, edge)
    return codes[edge], n.astype(np.int64)


def _codes(offsets: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The packed codes of all pairs of each list, RUN at most at a time; ids ascend within a list."""
    sizes = np.diff(offsets)
    for k in np.unique(sizes[sizes > 1]).tolist():
        starts = offsets[:-1][sizes == k]
        if k * (k - 1) // 2 > RUN:  # one record alone has more pairs than a run: a block of its first items after the other
            step = max(1, RUN // k)
            for at in starts:
                m = ids[at : at + k]
                for i in range(0, k - 1, step):
                    a, b = np.nonzero(np.arange(k)[None] > np.arange(i, min(i + step, k - 1))[:, None])
                    yield (m[a + i] << 32) | m[b]
            continue
        a, b = np.triu_indices(k, 1)
        step = max(1, RUN // len(a))
        for at in range(0, len(starts), step):
            m = ids[starts[at : at + step, None] + np.arange(k)]
            yield ((m[:, a] << 32) | m[:, b]).ravel()


def _table(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])


def _counted(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sorted, run-length counted runs of the codes."""
    held: list[np.ndarray] = []
    for codes in blocks:
        held.append(codes)
        if sum(map(len, held)) >= RUN:
            yield _table(*_runs(np.concatenate(held)))
            held = []
    if held and sum(map(len, held)):
        yield _table(*_runs(np.concatenate(held)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums of a stream that is sorted by code."""
    last, total = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes, n = _runs(b.column(0).to_numpy(), b.column(1).to_numpy())
        if last is not None:
            if codes[0] == last:
                n[0] += total
            else:
                yield _table(np.array([last]), np.array([total]))
        last, total = codes[-1], n[-1]
        if len(codes) > 1:
            yield _table(codes[:-1], n[:-1])
    if last is not None:
        yield _table(np.array([last]), np.array([total]))


def pair_statistics(sets: DataFrame, least: int = 1, share: int | None = None) -> DataFrame:
    """Every pair of items of a record, with counts, lift, odds ratio, log odds and their z value.

    sets: one row per record with an array of distinct items. least: pairs that meet in fewer records
    are left out. share: pairs that meet in fewer than 1/share of the records are left out as well; as
    an item is in at least as many records as its pairs, rarer items are dropped before pairing, and at
    most share times the mean number of items per record remain.
    """
    spark = sets.sparkSession
    n_records = sets.count()
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    floor = max(least, -(-n_records // share) if share else 1)
    counts = staged(counts.where(F.col("n") >= floor), "items")
    size = counts.count()
    if size <= WHOLE_DICTIONARY:
        known = sorted(((r.item, r.n) for r in counts.collect()), key=lambda r: r[0])
        names = spark.sparkContext.broadcast([k for k, _ in known])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            order = pa.array(names.value, pa.string())
            for b in batches:
                lists = b.column(0)
                ids = pc.index_in(lists.flatten().cast(pa.string()), order)
                keep = ids.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[keep]
                got = ids.drop_null().to_numpy().astype(np.int64)
                at = np.lexsort((got, row))
                yield from _codes(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lists))))), got[at])

        codes = sets.mapInArrow(lambda bs: _counted(blocks(bs)), "code long, n long")
        ids = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(known)], "id long, item string, n long")
    else:
        ranked = counts.orderBy("item").rdd.zipWithIndex().map(lambda x: (x[1], x[0].item, x[0].n))
        ids = staged(spark.createDataFrame(ranked, "id long, item string, n long"), "ids")
        rows = sets.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode("items").alias("item"))
        # an item in more than one record of FEW is hot; there are few of them, and they travel to the tasks
        hot = ids.where(F.col("n") * FEW > n_records).select("id", "item")
        cold = rows.join(F.broadcast(hot), "item", "left_anti").join(ids.where(F.col("n") * FEW <= n_records).select("id", "item"), "item")
        lists = rows.join(F.broadcast(hot), "item").unionByName(cold).groupBy("r").agg(F.sort_array(F.collect_list("id")).alias("ids"))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                lens = pc.list_value_length(b.column(0)).to_numpy()
                yield from _codes(np.concatenate(([0], np.cumsum(lens))), b.column(0).flatten().to_numpy())

        codes = lists.select("ids").mapInArrow(lambda bs: _counted(blocks(bs)), "code long, n long")
    merged = codes.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n long")
    merged = merged.where(F.col("n") >= floor)
    side = lambda x: ids.select(F.col("id").alias(f"id_{x}"), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = merged.select(F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("id_b"), F.col("n").alias("n_ab"))
    pairs = pairs.join(side("a"), "id_a").join(side("b"), "id_b").withColumn("n_records", F.lit(n_records).cast("long"))
    both, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n_records"))
    cells = [both + 0.5, a - both + 0.5, b - both + 0.5, n - a - b + both + 0.5]
    odds = cells[0] * cells[3] / (cells[1] * cells[2])
    error = F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    return pairs.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records",
        F.round(both * n / (a * b), 6).alias("lift"), F.round(odds, 6).alias("odds_ratio"),
        F.round(F.ln(odds), 6).alias("log_odds"), F.round(F.ln(odds) / error, 4).alias("z"),
    )


def coded_item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item sets of the distinct (text_id, text) of coded_items."""
    df = table(spark, sf_dir, "coded_items", "text_id", "text", "keywords", "dimensions")
    words = F.transform(
        F.coalesce("keywords", F.array().cast("array<string>")),
        lambda k: F.concat(F.lit("kw:"), F.lower(F.regexp_replace(k, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))),
    )
    dims = F.transform(F.coalesce("dimensions", F.array().cast("array<string>")), lambda k: F.concat(F.lit("dim:"), k))
    items = F.filter(F.concat(words, dims), lambda x: x.isNotNull() & ~x.isin("kw:", "dim:"))
    return staged(item_sets(df, ["text_id", "text"], items), "sets")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of keywords and dimensions of one record, with their statistics."""
    return pair_statistics(coded_item_sets(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least 5 records and one record in 2,000 that meet 8 times as often as by chance or more."""
    pairs = pair_statistics(coded_item_sets(spark, sf_dir), least=5, share=2000)
    exact = "cast(n_ab as decimal(38,0)) * n_records >= cast(8 as decimal(2,0)) * (cast(n_a as decimal(18,0)) * cast(n_b as decimal(18,0)))"
    return pairs.where("n_ab * 2000 >= n_records").where(exact).select("item_a", "item_b")


_SQL = r"""
with items as (
  select distinct text_id, text, item from (
    select text_id, text, 'kw:' || lower(regexp_replace(k, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as item
      from (select text_id, text, unnest(keywords) as k from coded_items) where k is not null
    union all
    select text_id, text, 'dim:' || k from (select text_id, text, unnest(dimensions) as k from coded_items) where k is not null)
  where item not in ('kw:', 'dim:')),
recs as (select row_number() over () as r, text_id, text from (select distinct text_id, text from coded_items)),
m as (select r, item from items join recs on items.text_id is not distinct from recs.text_id and items.text is not distinct from recs.text),
c as (select item, count(*) as n from m group by 1),
t as (select count(*) as n_records from recs),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from m a join m b on a.r = b.r and a.item < b.item group by 1, 2),
s as (select p.*, ca.n as n_a, cb.n as n_b, n_records from p join c ca on ca.item = item_a join c cb on cb.item = item_b, t)
"""
ORACLE = {
    "p1_found": _SQL + "select item_a, item_b from s where n_ab >= 5 and 2000 * n_ab >= n_records and n_ab::hugeint * n_records >= 8::hugeint * n_a * n_b",
    "p1_pairs": _SQL + """, o as (select *, (n_ab + 0.5::double) * (n_records - n_a - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)) as x,
      sqrt(1 / (n_ab + 0.5::double) + 1 / (n_a - n_ab + 0.5::double) + 1 / (n_b - n_ab + 0.5::double) + 1 / (n_records - n_a - n_b + n_ab + 0.5::double)) as e from s)
    select item_a, item_b, n_ab, n_a, n_b, n_records, round(n_ab::double * n_records / (n_a::double * n_b), 6) as lift,
      round(x, 6) as odds_ratio, round(ln(x), 6) as log_odds, round(ln(x) / e, 4) as z from o""",
}
