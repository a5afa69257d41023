"""Queries of the keyword funnel. The month of collection plays the run, the channel the source, a blank content the drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions import stats as S
from voxgrid.functions import text as T
from voxgrid.operators import control, funnel
from voxgrid.plans.registry import query
from voxgrid.session import table

_BASE = """with b as (select strftime(collected_at, '%Y-%m') as run_id, (year(collected_at) * 12 + month(collected_at))::int as run_seq, channel_id as channel, coalesce(nullif(keyword, ''), '未分类') as keyword,
    coalesce(platform_specific['query'], '') as q0, url, post_seq as ord, case when trim(coalesce(content, '')) = '' then 'empty' when length(content) < 20 then 'too short' when coalesce(ad_flag, false) then 'advert' end as reason from posts),
  kept as (select *, case when q0 = '' then keyword else q0 end as query from b where reason is null),
  dropped as (select *, case when q0 = '' then keyword else q0 end as query, case when reason = 'advert' then 'collection' else 'quality' end as kind from b where reason is not null),
  coded as (select channel_id as channel, coalesce(nullif(keyword, ''), '未分类') as keyword, sentiment, ad_flag from coded_items)"""
_R = "round(case when {1} <> 0 then {0}::double / ({1}) else 0 end, 4)"


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reason = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").when(F.length("content") < 20, "too short").when(F.coalesce("ad_flag", F.lit(False)), "advert")
    p = table(spark, d, "posts").select(
        F.date_format("collected_at", "yyyy-MM").alias("run_id"), (F.year("collected_at") * 12 + F.month("collected_at")).alias("run_seq"), F.col("channel_id").alias("channel"), F.coalesce(F.nullif("keyword", F.lit("")), F.lit(C.UNSORTED)).alias("keyword"),
        F.coalesce(F.try_element_at("platform_specific", F.lit("query")), F.lit("")).alias("q0"), "url", F.col("post_seq").alias("ord"), reason.alias("reason"),
    )
    p = p.withColumn("query", F.when(F.col("q0") == "", F.col("keyword")).otherwise(F.col("q0")))
    drops = p.where("reason is not null").withColumn("kind", F.when(F.col("reason") == "advert", "collection").otherwise("quality"))
    coded = table(spark, d, "coded_items").select(F.col("channel_id").alias("channel"), F.coalesce(F.nullif("keyword", F.lit("")), F.lit(C.UNSORTED)).alias("keyword"), "sentiment", "ad_flag")
    return p.where("reason is null"), drops, coded


_EXTRACT = _BASE + f""", r as (select channel, keyword, query, 1 as k, 0 as dd, 0 as q from kept union all select channel, keyword, query, 0, 1, case when kind = 'quality' then 1 else 0 end from dropped),
  c as (select channel, keyword, query, sum(k)::bigint as kept, sum(dd)::bigint as dropped, sum(q)::bigint as quality_dropped from r group by 1, 2, 3),
  s as (select channel, keyword, count(*) as coded, count(*) filter (where sentiment = 'negative') as negative, count(*) filter (where coalesce(ad_flag, false)) as ads from coded group by 1, 2),
  f as (select c.*, coalesce(coded, 0) as coded, coalesce(negative, 0) as negative, coalesce(ads, 0) as ads, kept + dropped as collected, {_R.format('kept', '(kept + dropped)')} as effective_rate, {_R.format('kept', '(kept + quality_dropped)')} as quality_rate,
    {_R.format('coalesce(negative, 0)', 'coalesce(coded, 0)')} as negative_rate from c left join s on s.channel = c.channel and s.keyword = c.keyword)"""


@query(_EXTRACT + " select * from f")
def funnel_rows(spark, d):
    return funnel.extract(*frames(spark, d)).drop("reasons")


@query(_EXTRACT + " select channel, query, collected, effective_rate, case when collected >= 30 and effective_rate < 0.5 then 'strong' else 'weak' end as level from f where (collected >= 30 and effective_rate < 0.5) or (collected >= 10 and effective_rate < 0.4)")
def low_efficiency(spark, d):
    return funnel.low_efficiency(funnel.extract(*frames(spark, d)))


@query(_EXTRACT + " select channel, query, keyword, collected, effective_rate, case when effective_rate >= 0.7 and collected >= 30 then 'prefer' else 'avoid' end as move from f where (effective_rate >= 0.7 and collected >= 30) or (channel = 'xiaohongshu' and effective_rate < 0.4 and collected >= 10)")
def channel_candidates(spark, d):
    return funnel.candidates(funnel.extract(*frames(spark, d)))


@query(_EXTRACT + f""", x as (select trim(regexp_replace(regexp_replace(replace(query, keyword, ' '), '测评|评价|怎么样|体验', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) as suffix, collected, kept from f where starts_with(channel, 'websearch'))
  select suffix, sum(collected)::bigint as collected, sum(kept)::bigint as kept, {_R.format('sum(kept)', 'sum(collected)')} as rate from x group by 1""")
def suffix_stats(spark, d):
    return funnel.suffix_stats(funnel.extract(*frames(spark, d)), T.suffix_of(F.col("query"), F.col("keyword")))


_RUNS = _BASE + """, r as (select run_id, run_seq, channel, keyword, query, 1 as k, 0 as dd, 0 as q from kept union all select run_id, run_seq, channel, keyword, query, 0, 1, case when kind = 'quality' then 1 else 0 end from dropped),
  runs as (select run_id, run_seq, channel, keyword, query, sum(k)::bigint as kept, sum(dd)::bigint as dropped, sum(q)::bigint as quality_dropped, (sum(k) + sum(dd))::bigint as collected from r group by 1, 2, 3, 4, 5)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped, _ = frames(spark, d)
    key = ["run_id", "run_seq", "channel", "keyword", "query"]
    r = kept.select(*key, F.lit(1).alias("k"), F.lit(0).alias("d"), F.lit(0).alias("q"), F.lit(None).cast("string").alias("reason")).unionByName(dropped.select(*key, F.lit(0).alias("k"), F.lit(1).alias("d"), (F.col("kind") == "quality").cast("int").alias("q"), "reason"))
    why = r.where("reason is not null").groupBy(*key, "reason").agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    out = r.groupBy(*key).agg(F.sum("k").alias("kept"), F.sum("d").alias("dropped"), F.sum("q").alias("quality_dropped"), (F.sum("k") + F.sum("d")).alias("collected"))
    return out.join(why, key, "left")


@query(_RUNS + " select channel, query, sum(collected)::bigint as collected, sum(kept)::bigint as kept, sum(dropped)::bigint as dropped, sum(quality_dropped)::bigint as quality_dropped, count(distinct run_id) as runs from runs group by 1, 2")
def aggregate_runs(spark, d):
    return funnel.aggregate_runs(runs(spark, d)).drop("keyword", "reasons")


@query(_BASE + f""", a as (select channel, query, coalesce(url, '') as url, 1 as kept, null::varchar as reason, null::varchar as kind, null::bigint as ord from kept union all select channel, query, url, 0, reason, kind, ord from dropped where coalesce(url, '') <> ''),
  o as (select channel, query, url, max(kept) as kept, arg_min(kind, ord) as kind from a group by 1, 2, 3)
  select channel, query, count(*) as collected, sum(kept)::bigint as kept, count(*) filter (where kept = 0) as dropped, count(*) filter (where kept = 0 and kind = 'quality') as quality_dropped, {_R.format('sum(kept)', 'count(*)')} as effective_rate,
    {_R.format('sum(kept)', "(sum(kept) + count(*) filter (where kept = 0 and kind = 'quality'))")} as quality_rate from o group by 1, 2""")
def unique_url_funnel(spark, d):
    kept, dropped, _ = frames(spark, d)
    return funnel.unique_urls(kept, dropped)


_RATES = _RUNS + f", t as (select run_id, max(run_seq) as run_seq, sum(kept)::bigint as kept, sum(dropped)::bigint as dropped, {_R.format('sum(kept)', '(sum(kept) + sum(dropped))')} as rate, {_R.format('sum(kept)', '(sum(kept) + sum(quality_dropped))')} as quality_rate from runs group by 1)"


@query(_RATES + " select run_id, kept, dropped, rate, quality_rate from t")
def run_rates(spark, d):
    return funnel.total_rates(runs(spark, d))


@query(_RATES + """, x as (select *, round((rate - lag(rate) over (order by run_seq, run_id)) * 100, 1) as delta_pp from t)
  select run_id, run_seq, kept, dropped, rate, quality_rate, delta_pp, case when delta_pp is null then 'first run' when delta_pp >= 5 then 'reached' when delta_pp > 0 then 'better' when delta_pp = 0 then 'flat' else 'worse' end as verdict from x""")
def run_compare(spark, d):
    return funnel.compare_runs(runs(spark, d))


@query(_RUNS + ", l as (select max(run_seq) as last from runs) select channel, query from (select distinct channel, query from runs, l where run_seq = last) a where not exists (select 1 from runs b, l where b.run_seq < last and b.channel = a.channel and b.query = a.query)")
def new_queries(spark, d):
    """Queries of the latest run that no earlier run asked."""
    r = runs(spark, d)
    last = r.agg(F.max("run_seq")).first()[0]
    return funnel.new_queries(r.where(F.col("run_seq") == F.lit(last)), r.where(F.col("run_seq") < F.lit(last)))


@query(_BASE + ", w as (select distinct channel, keyword, 5 as wanted from b), k as (select channel, keyword, count(*) as kept from kept group by 1, 2) select w.channel, w.keyword, wanted, coalesce(kept, 0) as kept, greatest(wanted - coalesce(kept, 0), 0) as missing, case when coalesce(kept, 0) = 0 then 'nothing kept' when wanted > coalesce(kept, 0) then 'fewer than asked' else 'met' end as note from w left join k on k.channel = w.channel and k.keyword = w.keyword")
def gap_notes(spark, d):
    kept, dropped, _ = frames(spark, d)
    wanted = kept.select("channel", "keyword").unionByName(dropped.select("channel", "keyword")).distinct().withColumn("wanted", F.lit(5))
    return funnel.gap_notes(wanted, kept)


@query("""with k as (select distinct keyword from posts where keyword is not null and length(keyword) >= 3), t as (select keyword as subject, text from coded_items where keyword is not null and length(keyword) >= 3 and not contains(text, keyword)),
  a as (select subject, unnest(list_distinct([left(subject, 2), right(subject, 2)])) as alias, text from t), n as (select subject, alias, count(*) as n from a where contains(text, alias) group by 1, 2 having count(*) >= 2),
  r as (select *, row_number() over (partition by subject order by n desc, alias) as k from n) select subject, alias, n from r where k <= 5""")
def alias_hints(spark, d):
    return funnel.alias_hints(table(spark, d, "coded_items").select(F.col("keyword").alias("subject"), "text"))


@query()
def subject_hints(spark, d):
    """Tokens beside a subject in texts that hold it."""
    from voxgrid.operators.tokens import segment

    return funnel.subject_hints(table(spark, d, "coded_items").select(F.col("keyword").alias("subject"), "text", segment(F.col("text")).alias("tokens")))


_STRATEGY = {"砾光G7": ["测评", "续航"], "Velmora": ["review"], "墨蓟之城": ["攻略"]}


@query("""with k as (select distinct keyword from posts where keyword is not null), q as (select keyword, list_concat([keyword], list_transform(case when keyword = '砾光G7' or starts_with(keyword, '砾光G7 ') then ['测评', '续航'] when keyword = 'Velmora' or starts_with(keyword, 'Velmora ') then ['review']
  when keyword = '墨蓟之城' or starts_with(keyword, '墨蓟之城 ') then ['攻略'] else [] end, lambda w: keyword || ' ' || w)) as qs from k) select keyword, (unnest(range(0, len(qs))))::int as ord, unnest(qs) as query from q""")
def query_expansion(spark, d):
    return funnel.expand_queries(table(spark, d, "posts", "keyword").where("keyword is not null").distinct(), _STRATEGY)


@query("select source, count(*) as texts, round((sum(length(coalesce(text, ''))) * 1.0 * 2.0 + count(*) * 60 * 8.0) / 1e6, 4) as cost from documents group by 1")
def cost_estimate(spark, d):
    t = table(spark, d, "documents", "source", "text").groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("p"))
    return t.select("source", "texts", S.token_cost(F.col("p").cast("double"), F.col("texts") * 60.0).alias("cost"))


# ---- control tables, played by the events table -------------------------------------------------
_QUOTA = """with e as (select user_id % 20 as channel, ts, event_id as seq, case when event_type in ('click', 'view') then 'consume' when event_type = 'error' then 'refund' else 'settle' end as op, 3 as est, case when event_type = 'purchase' then 1 else 4 end as actual from events),
  x as (select channel, ts::date as day, sum(case op when 'consume' then est when 'refund' then -est else actual - est end) over (partition by channel, ts::date order by ts, seq rows unbounded preceding) as p, case op when 'consume' then est when 'refund' then -est else actual - est end as dl from e),
  g as (select channel, day, count(*) as events, sum(dl) as s, min(p) as low from x group by 1, 2)"""


def quota_events(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("click", "view"), "consume").when(F.col("event_type") == "error", "refund").otherwise("settle")
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("channel"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.lit(3).alias("est"), F.when(F.col("event_type") == "purchase", 1).otherwise(4).alias("actual"), "event_type")


@query(_QUOTA + " select channel, day, events, (s - least(0, low))::bigint as used, (s - least(0, low)) >= 40 as spent from g")
def quota_fold(spark, d):
    return control.quota_fold(quota_events(spark, d), 40)


@query("""with e as (select user_id % 20 as channel, ts::date as day, ts, event_id as seq, event_type <> 'error' as ok from events), r as (select *, sum(ok::int) over (partition by channel, day order by ts, seq rows unbounded preceding) as run from e),
  l as (select *, sum((not ok)::int) over (partition by channel, day, run order by ts, seq rows unbounded preceding) as level, row_number() over (partition by channel, day order by ts desc, seq desc) as k from r)
  select channel, day, level::int as level, case when ok then 0 else least(10 * pow(2, level - 1), 60) end::int as minutes from l where k = 1""")
def cooldown_fold(spark, d):
    return control.cooldown_fold(quota_events(spark, d).select("channel", "ts", "seq", (F.col("event_type") != "error").alias("ok")))


@query("select user_id as task_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as since, count(*) as events from events group by 1")
def task_state(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return control.task_state(e)


@query("with l as (select user_id % 50 as worker, max(ts) as last from events group by 1), n as (select max(ts) as now from events) select worker, (floor(epoch(now)) - floor(epoch(last)))::bigint as silent_s, (floor(epoch(now)) - floor(epoch(last))) > 3600 as stale from l, n")
def stale_heartbeat(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("worker"), "ts")
    now = e.agg(F.max("ts")).first()[0]
    return control.stale(e, F.lit(now), 3600)


_TASKS = "(select event_id as task_id, event_type as bucket, value as minutes, ts as ended from events)"


@query(f"""with r as (select * from {_TASKS} where minutes between 0 and 1440 order by ended desc, task_id desc limit 200), o as (select bucket, count(*) as n, round(avg(minutes), 1) as mean, round(median(minutes), 1) as median from r group by 1), a as (select round(avg(minutes), 1) as ma, round(median(minutes), 1) as md from r)
  select bucket, n, case when n < 2 then ma else mean end as mean, case when n < 2 then md else median end as median from o, a""")
def duration_stats(spark, d):
    return control.duration_stats(table(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("bucket"), F.col("value").alias("minutes"), F.col("ts").alias("ended")))


@query("select event_id, event_type from events order by ts desc, event_id limit 20 offset 40")
def paging(spark, d):
    return control.page(table(spark, d, "events", "event_id", "event_type", "ts"), [F.desc("ts"), F.col("event_id")], 20, 2).select("event_id", "event_type")


@query("select category, count(*) filter (where rk > 30 and age > 7) as selected, count(*) as files from (select event_type as category, row_number() over (partition by event_type order by ts desc, event_id desc) as rk, (date '2024-02-15' - ts::date) as age from events) group by 1")
def retention(spark, d):
    f = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("ts").alias("modified"), F.col("event_id").alias("name"))
    return control.retention(f, F.lit("2024-02-15").cast("date")).groupBy("category").agg(F.count_if("selected").alias("selected"), F.count("*").alias("files"))


@query("select ts::date::varchar as day, event_type, count(*) as n from events group by 1, 2")
def daily_window(spark, d):
    from voxgrid.streaming import forms

    return forms.daily(table(spark, d, "events", "ts", "event_type"), "event_type")


@query("select date_trunc('week', ts)::date::varchar as week, event_type, count(*) as n from events group by 1, 2")
def weekly_window(spark, d):
    from voxgrid.streaming import forms

    return forms.weekly(table(spark, d, "events", "ts", "event_type"), "event_type")


@query("""with e as (select user_id % 20 as worker, ts, lag(ts) over (partition by user_id % 20 order by ts) as before from events), s as (select *, sum(case when before is null or ts - before >= interval 3600 second then 1 else 0 end) over (partition by worker order by ts rows unbounded preceding) as k from e)
  select worker, min(ts) as first, max(ts) + interval 3600 second as last, count(*) as beats from s group by worker, k""")
def worker_sessions(spark, d):
    from voxgrid.streaming import forms

    return forms.sessions(table(spark, d, "events").select((F.col("user_id") % 20).alias("worker"), "ts"), 3600)
