"""Evaluation and sampling queries: a user's label in feedback plays the gold one, the model's the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid.functions import stats as S
from voxgrid.operators import evaluation as E
from voxgrid.operators import sampling as P
from voxgrid.plans.registry import query
from voxgrid.session import table

_PAIRS = "(select f.id, f.text_id, user_sentiment as gold, coalesce(nullif(model_sentiment, ''), 'neutral') as pred, status, coalesce(reason, '') as flags, created_at from feedback f where user_sentiment is not null and user_sentiment <> '')"
_ITEM = "(select text_id, max(confidence) as confidence, max(need_review) as flagged from coded_items group by 1)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback").where("user_sentiment is not null and user_sentiment <> ''")
    return f.select("id", "text_id", F.col("user_sentiment").alias("gold"), F.coalesce(F.nullif("model_sentiment", F.lit("")), F.lit("neutral")).alias("pred"), "status", F.coalesce("reason", F.lit("")).alias("flags"))


def with_items(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "coded_items", "text_id", "confidence", "need_review").groupBy("text_id").agg(F.max("confidence").alias("confidence"), F.max("need_review").alias("flagged"))
    return pairs(spark, d).join(i, "text_id", "left")


def _interval(a: str, n: str) -> str:
    mid, half, den = f"({a} + 3.8416 / (2 * {n}))", f"(1.96 * sqrt({a} * (1 - {a}) / {n} + 3.8416 / (4.0 * {n} * {n})))", f"(1 + 3.8416 / {n})"
    return f"round(greatest({mid} / {den} - {half} / {den}, 0), 4) as low, round(least({mid} / {den} + {half} / {den}, 1), 4) as high"


@query(f"""with g as (select 'all' as grp, '' as segment, count(*) as n, avg((gold = pred)::int) as a from {_PAIRS} union all select 'status', coalesce(status, ''), count(*), avg((gold = pred)::int) from {_PAIRS} group by 2 union all select 'gold', gold, count(*), avg((gold = pred)::int) from {_PAIRS} group by 2)
  select grp, segment, n, round(a, 4) as accuracy, {_interval('a', 'n::double')} from g""")
def accuracy_by_group(spark, d):
    p = pairs(spark, d).withColumn("label", F.col("gold"))
    out = E.accuracy(p, "status", "label")
    return out.withColumn("grp", F.when(F.col("grp") == "label", "gold").otherwise(F.col("grp")))


_PRF = "round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 4) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 4) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 4) as f1"


@query(f"""with c as (select label, count(*) filter (where gold = label and pred = label) as tp, count(*) filter (where gold <> label and pred = label) as fp, count(*) filter (where gold = label and pred <> label) as fn from {_PAIRS}, (select unnest(['positive', 'negative', 'neutral']) as label) group by 1)
  select label, tp, fp, fn, {_PRF} from c""")
def class_prf(spark, d):
    return E.class_prf(pairs(spark, d))


@query(f"select pred, gold, count(*) as n from {_PAIRS} group by 1, 2")
def confusion(spark, d):
    return E.confusion(pairs(spark, d))


_MAPS = "(select item_seq, dimension_sentiments as gold, map_from_entries(list_transform(list_distinct(list_filter(dimensions, lambda x: x is not null and x <> '')), lambda x: struct_pack(k := x, v := coalesce(sentiment, 'neutral')))) as pred from coded_items)"


def maps(spark: SparkSession, d: str) -> DataFrame:
    """The aspect map of an item against one that gives every mentioned aspect the item's own sentiment."""
    dims = F.filter(F.array_distinct("dimensions"), lambda x: x.isNotNull() & (x != ""))
    return table(spark, d, "coded_items").select("item_seq", F.col("dimension_sentiments").alias("gold"), F.map_from_entries(F.transform(dims, lambda x: F.struct(x, F.coalesce("sentiment", F.lit("neutral"))))).alias("pred"))


_ASPECT = f"""with g as (select item_seq, unnest(map_keys(gold)) as dim, unnest(map_values(gold)) as g from {_MAPS}), p as (select item_seq, unnest(map_keys(pred)) as dim, unnest(map_values(pred)) as p from {_MAPS}), j as (select coalesce(g.dim, p.dim) as dim, g, p from g full join p on g.item_seq = p.item_seq and g.dim = p.dim),
  c as (select dim, count(*) filter (where g is not distinct from p) as tp, count(*) filter (where p is not null and g is distinct from p) as fp, count(*) filter (where g is not null and g is distinct from p) as fn, count(*) filter (where g is not null and p is not null) as mention_tp, count(*) filter (where p is not null and g is null) as mention_fp, count(*) filter (where g is not null and p is null) as mention_fn from j group by 1)"""


@query(_ASPECT + f" select dim, tp, fp, fn, mention_tp, mention_fp, mention_fn, {_PRF}, round(case when 2 * mention_tp + mention_fp + mention_fn > 0 then 2.0 * mention_tp / (2 * mention_tp + mention_fp + mention_fn) else 0 end, 4) as mention_f1 from c")
def aspect_prf(spark, d):
    return E.aspect_prf(maps(spark, d))


@query()
def aspect_exact(spark, d):
    """Share of items whose aspect map is exactly the predicted one."""
    return E.exact_match(maps(spark, d))


_BIN = "case when confidence >= 0 and confidence < 0.5 then '0.0-0.5' when confidence >= 0.5 and confidence < 0.6 then '0.5-0.6' when confidence >= 0.6 and confidence < 0.7 then '0.6-0.7' when confidence >= 0.7 and confidence < 0.8 then '0.7-0.8' when confidence >= 0.8 and confidence < 0.9 then '0.8-0.9' when confidence >= 0.9 and confidence < 1.0001 then '0.9-1.0' else 'missing' end"


@query(f"""with b as (select {_BIN} as bin, count(*) as n, round(avg((gold = pred)::int), 4) as accuracy from {_PAIRS} p left join {_ITEM} i on i.text_id = p.text_id group by 1)
  select s.bin, coalesce(n, 0) as n, accuracy from (select unnest(['0.0-0.5', '0.5-0.6', '0.6-0.7', '0.7-0.8', '0.8-0.9', '0.9-1.0', 'missing']) as bin) s left join b on b.bin = s.bin""")
def calibration(spark, d):
    return E.calibration(with_items(spark, d))


@query(f"with f as (select gold, pred, unnest(list_distinct(list_filter(list_transform(string_split_regex(flags, '[,、]'), lambda x: trim(x)), lambda x: x <> ''))) as flag from {_PAIRS}) select flag, count(*) as n, round(avg((gold = pred)::int), 4) as accuracy from f group by 1")
def flag_accuracy(spark, d):
    return E.flag_accuracy(pairs(spark, d))


@query("select count(*) filter (where method <> 'llm') as direct, count(*) filter (where method = 'llm') as model, count(*) filter (where method = 'llm' and lexicon_sentiment is not null and lexicon_sentiment <> sentiment) as corrected, round(count(*) filter (where method = 'llm')::double / count(*), 4) as model_rate from coded_items")
def routing_counts(spark, d):
    return E.routing(table(spark, d, "coded_items"))


@query(f"""with p as (select gold <> pred as wrong, coalesce(flagged, false) as f from {_PAIRS} p left join {_ITEM} i on i.text_id = p.text_id)
  select count(*) as n, count(*) filter (where wrong) as wrong, count(*) filter (where f) as flagged, round(count(*) filter (where wrong and f)::double / count(*) filter (where wrong), 4) as hit_rate, round(count(*) filter (where not wrong and f)::double / count(*) filter (where not wrong), 4) as false_alarm, round(count(*) filter (where f)::double / count(*), 4) as flag_rate from p""")
def review_backtest(spark, d):
    return E.review_backtest(with_items(spark, d))


@query(f"""with n as (select count(*) as n, count(*) filter (where gold = pred) as same from {_PAIRS}), a as (select gold as label, count(*) as a from {_PAIRS} group by 1), b as (select pred as label, count(*) as b from {_PAIRS} group by 1), e as (select sum(a::double * b) as ab from a join b on a.label = b.label)
  select n, round(same::double / n, 4) as agreement, round((same::double / n - ab / (n::double * n)) / (1 - ab / (n::double * n)), 4) as kappa from n, e""")
def kappa(spark, d):
    return E.kappa(pairs(spark, d))


@query("""with a as (select id as k, user_sentiment as s1, 2 as i1 from feedback where user_sentiment <> ''), b as (select id as k, model_sentiment as s2, 1 + (id % 3)::int as i2 from feedback where model_sentiment <> ''), j as (select * from a full join b on a.k = b.k)
  select count(*) filter (where s1 is not null and s2 is not null) as n, count(*) filter (where s2 is null) as missing_second, count(*) filter (where s1 is null) as missing_first, round(count(*) filter (where s1 = s2)::double / count(*) filter (where s1 is not null and s2 is not null), 4) as sentiment,
    round(count(*) filter (where s1 is not null and s2 is not null and i1 = i2)::double / count(*) filter (where s1 is not null and s2 is not null), 4) as intensity, round(count(*) filter (where s1 is not null and s2 is not null and abs(i1 - i2) <= 1)::double / count(*) filter (where s1 is not null and s2 is not null), 4) as intensity_near, count(*) filter (where s1 <> s2) as disputes from j""")
def agreement(spark, d):
    f = table(spark, d, "feedback")
    a = f.where("user_sentiment <> ''").select("id", F.col("user_sentiment").alias("sentiment"), F.lit(2).alias("intensity"))
    b = f.where("model_sentiment <> ''").select("id", F.col("model_sentiment").alias("sentiment"), (1 + F.col("id") % 3).cast("int").alias("intensity"))
    return E.agreement(a, b, "id")


_RUN = "(select event_id as run_id, event_type as mode, user_id % 5 as fingerprint, ts, value as accuracy from events)"


@query(f"select run_id, lag(run_id) over (partition by mode, fingerprint order by ts, run_id) as previous, lag(accuracy) over (partition by mode, fingerprint order by ts, run_id) as previous_accuracy from {_RUN}")
def prev_run_asof(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), (F.col("user_id") % 5).alias("fingerprint"), "ts", F.col("value").alias("accuracy"))
    return E.previous_run(r).select("run_id", "previous", "previous_accuracy")


def _segments(earlier: int) -> str:
    return f"(select 'model' as grp, pred as segment, count(*) as n, round(avg((gold = pred)::int), 4) as accuracy from {_PAIRS} where (created_at < (select substring(max(created_at), 1, 4) from feedback)) = ({earlier} = 1) group by 2)"


def _half(a: str, n: str) -> str:
    den, mid, half = f"(1 + 3.8416 / {n})", f"({a} + 3.8416 / (2 * {n}))", f"(1.96 * sqrt({a} * (1 - {a}) / {n} + 3.8416 / (4.0 * {n} * {n})))"
    return f"round(greatest({a} - greatest({mid} / {den} - {half} / {den}, 0), least({mid} / {den} + {half} / {den}, 1) - {a}) * 100, 2)"


@query(f"""with j as (select a.grp, a.segment, a.n, a.accuracy, round((a.accuracy - b.accuracy) * 100, 2) as delta_pp, round(sqrt(pow({_half('a.accuracy', 'a.n::double')}, 2) + pow({_half('b.accuracy', 'b.n::double')}, 2)), 2) as width_pp from {_segments(0)} a left join {_segments(1)} b on b.segment = a.segment)
  select *, case when delta_pp is null then 'new' when abs(delta_pp) < 1 then 'flat' when width_pp is not null and abs(delta_pp) <= width_pp then 'within noise' when delta_pp > 0 then 'better' else 'worse' end as status from j""")
def segment_compare(spark, d):
    """The feedback of the latest year against that of all years before."""
    p = pairs(spark, d).join(table(spark, d, "feedback", "id", "created_at"), "id")
    year = table(spark, d, "feedback", "created_at").agg(F.substring(F.max("created_at"), 1, 4)).first()[0]
    seg = lambda k: p.where((F.col("created_at") < F.lit(year)) == bool(k)).groupBy(F.col("pred").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 4).alias("accuracy")).withColumn("grp", F.lit("model"))
    return E.compare_segments(seg(0), seg(1))


@query(f"select platform, n, {_interval('p', 'n::double')} from (select platform, count(*) as n, count(*) filter (where sentiment = 'negative')::double / count(*) as p from coded_items group by 1)")
def wilson(spark, d):
    x = table(spark, d, "coded_items").groupBy("platform").agg(F.count("*").alias("n"), (F.count_if(F.col("sentiment") == "negative") / F.count("*")).alias("p"))
    lo, hi = S.wilson(F.col("p"), F.col("n").cast("double"))
    return x.select("platform", "n", F.round(lo, 4).alias("low"), F.round(hi, 4).alias("high"))


@query("select count(*) as n from coded_items i where not exists (select 1 from feedback f where trim(f.text_snippet) = trim(substring(i.text, 1, 200)))")
def gold_anti_join(spark, d):
    seen = table(spark, d, "feedback").select(F.trim("text_snippet").alias("k")).where("k is not null").distinct()
    return table(spark, d, "coded_items", "text").withColumn("k", F.trim(F.substring("text", 1, 200))).join(seen, "k", "left_anti").agg(F.count("*").alias("n"))


_QUOTA = """with s as (select platform as key, count(*) as size from coded_items group by 1), t as (select *, size * 200.0 / sum(size) over () as share from s), b as (select *, least(floor(share)::bigint, size) as base from t),
  q as (select *, base + case when row_number() over (order by case when base < size then 0 else 1 end, round(share - floor(share), 9) desc, size desc, key) <= 200 - sum(base) over () and base < size then 1 else 0 end as quota from b)"""


@query(_QUOTA + " select key, size, quota::bigint as quota from q")
def largest_remainder(spark, d):
    s = table(spark, d, "coded_items", "platform").groupBy(F.col("platform").alias("key")).agg(F.count("*").alias("size"))
    return S.largest_remainder(s, "size", 200, cap="size").select("key", "size", "quota")


@query(_QUOTA + ", r as (select item_seq, platform, row_number() over (partition by platform order by item_seq) as k from coded_items) select item_seq, platform from r join q on q.key = r.platform where k <= quota")
def stratified_holdout(spark, d):
    return P.hold_out(table(spark, d, "coded_items", "item_seq", "platform"), "platform", "item_seq", 200)[0]


@query("with r as (select post_seq, keyword, row_number() over (partition by keyword order by post_seq) as k from posts) select post_seq, keyword from r where k <= 30")
def brand_cap(spark, d):
    return P.brand_cap(table(spark, d, "posts", "post_seq", "keyword"), "keyword", "post_seq", 0.1, 300)


@query()
def weighted_sample(spark, d):
    """A sample without replacement, weighted by the number of edge features."""
    from voxgrid.operators.review import edge_features

    return P.weighted_sample(table(spark, d, "coded_items", "item_seq", "text", "dimensions"), "item_seq", 1.0 + F.size(edge_features()), 300).select("item_seq")


@query("with r as (select item_seq, platform, sentiment, row_number() over (partition by platform, sentiment order by item_seq) as k from coded_items) select item_seq from r order by k, platform, sentiment nulls first, item_seq limit 60")
def trial_sample(spark, d):
    return P.trial_sample(table(spark, d, "coded_items", "item_seq", "platform", "sentiment"), ["platform", "sentiment"], "item_seq", 60).select("item_seq")


@query()
def edge_subsets(spark, d):
    """Rows for six kinds of hard texts, no row twice."""
    from voxgrid.operators.review import edge_features

    i = table(spark, d, "coded_items", "item_seq", "text", "dimensions", "confidence").withColumn("f", edge_features())
    subsets = [(n, F.array_contains("f", n)) for n in ("irony", "emoji", "mixed", "aspects", "long")] + [("lowconf", F.col("confidence").between(0.55, 0.95))]
    return P.edge_sample(i, "item_seq", subsets, 50).select("item_seq", "subset")
