"""Samples for annotation: weighted, capped, stratified, by quotas. Randomness is a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxgrid.functions import stats as S


def uniform(seed: int, id: str) -> Column:
    """A number in (0, 1) that depends on seed and id only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id)), 11) + 0.5) / (1 << 53)


def weighted_sample(df: DataFrame, id: str, weight: Column, k: int, seed: int = 1) -> DataFrame:
    """k rows without replacement, chosen with chances by weight: the smallest -ln(u) / w."""
    return df.withColumn("__key", -F.ln(uniform(seed, id)) / weight).orderBy("__key", id).limit(k).drop("__key")


def cap_per_group(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """At most cap rows of each group, the first by order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__k") <= cap).drop("__k")


def brand_cap(df: DataFrame, group: str, id: str, share: float, total: int) -> DataFrame:
    """No group takes more than its share of the total."""
    return cap_per_group(df, group, id, max(1, int(share * total)))


def hold_out(df: DataFrame, strata: str, id: str, total: int, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A stratified hold-out of total rows and the rest; quotas by largest remainder, order by hash or, without a seed, by id."""
    sizes = df.groupBy(F.col(strata).alias("key")).agg(F.count("*").alias("size"))
    quota = S.largest_remainder(sizes, "size", total, cap="size").select("key", "quota")
    order = [F.col(id)] if seed is None else [F.xxhash64(F.lit(seed), F.col(id)), F.col(id)]
    # no stratum gives more than total rows: a limit that every partition applies before anything is shuffled
    ranked = df.select(F.col(strata).alias("key"), F.struct(*order).alias("__o")).withColumn("__k", F.row_number().over(W.partitionBy("key").orderBy("__o"))).where(F.col("__k") <= total)
    last = ranked.join(quota, ranked["key"].eqNullSafe(quota["key"])).where(F.col("__k") <= F.col("quota")).groupBy(ranked["key"].alias("__s")).agg(F.max("__o").alias("__last"))
    rows = df.withColumn("__o", F.struct(*order)).join(last, F.col(strata).eqNullSafe(F.col("__s")), "left")
    pick = F.coalesce(F.col("__o") <= F.col("__last"), F.lit(False))
    clean = lambda x: x.drop("__o", "__s", "__last")
    return clean(rows.where(pick)), clean(rows.where(~pick))


def share_check(sample: DataFrame, whole: DataFrame, strata: str) -> DataFrame:
    """Shares of strata in sample and whole, and whether they are within ten points."""
    share = lambda df, name: df.groupBy(strata).agg(F.count("*").alias("n")).select(strata, (F.col("n") / F.sum("n").over(W.partitionBy())).alias(name))
    out = share(whole, "whole").join(share(sample, "sample"), strata, "left").na.fill(0.0)
    return out.select(strata, F.round("whole", 4).alias("whole"), F.round("sample", 4).alias("sample"), (F.abs(F.col("whole") - F.col("sample")) <= 0.1).alias("ok"))


def edge_sample(df: DataFrame, id: str, subsets: list[tuple[str, Column]], quota: int) -> DataFrame:
    """quota rows for each subset in turn (name, condition); a row goes to the first subset that takes it."""
    out = None
    left = df
    for name, cond in subsets:
        got = left.where(cond).orderBy(id).limit(quota).withColumn("subset", F.lit(name))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(id), id, "left_anti")
    return out


def trial_sample(df: DataFrame, cells: list[str], id: str, total: int) -> DataFrame:
    """Rows in rounds over the cells: every cell gives its first row before any gives its second."""
    ranked = df.withColumn("__k", F.row_number().over(W.partitionBy(*cells).orderBy(id)))
    return ranked.orderBy("__k", *cells, id).limit(total).drop("__k")


def pool_counts(pool: DataFrame, sample: DataFrame, id: str, *by: str) -> DataFrame:
    """Sizes of pool and sample by each column on its own."""
    rows = pool.join(sample.select(F.col(id).alias("__s")), pool[id] == F.col("__s"), "left").select(*by, F.col("__s").isNotNull().alias("taken"))
    parts = [rows.groupBy(F.col(b).cast("string").alias("value")).agg(F.count("*").alias("pool"), F.count_if("taken").alias("sample")).select(F.lit(b).alias("field"), "value", "pool", "sample") for b in by]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quota_sample(rows: list[dict], quotas: dict[str, dict[str, int]], total: int) -> list[dict]:
    """Main sampler over a bounded pool on the driver: scarce values first, then any that fits its quotas, then the rest.

    rows: dicts with id and the quota fields. quotas: field -> value -> least number wanted.
    """
    need = {f: dict(v) for f, v in quotas.items()}
    count = {f: {v: sum(r.get(f) == v for r in rows) for v in q} for f, q in quotas.items()}
    taken: list[dict] = []
    left = dict(enumerate(sorted(rows, key=lambda r: r["id"])))

    def take(at: int) -> None:
        r = left.pop(at)
        taken.append(r)
        for f, q in need.items():
            if r.get(f) in q:
                q[r[f]] -= 1

    for f, v in sorted(((f, v) for f in need for v in need[f]), key=lambda x: (count[x[0]][x[1]] - quotas[x[0]][x[1]], x)):
        for at in [at for at, r in left.items() if r.get(f) == v]:
            if need[f][v] <= 0 or len(taken) >= total:
                break
            take(at)
    for at in list(left):
        if len(taken) >= total:
            break
        take(at)
    return taken
