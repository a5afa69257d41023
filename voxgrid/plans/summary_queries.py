"""Queries over coded items, posts and comments: summaries and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.operators import evidence as E
from voxgrid.operators import review as R
from voxgrid.operators import summary as S
from voxgrid.plans.registry import query
from voxgrid.session import table

STAT = "(select * from coded_items where not coalesce(ad_flag, false))"
DAY = (
    r"coalesce(case when regexp_extract(pub_date, '([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})', 1) <> '' then"
    r" regexp_extract(pub_date, '([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(pub_date, '([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})', 2), 2, '0')"
    r" || '-' || lpad(regexp_extract(pub_date, '([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})', 3), 2, '0') else nullif(substring(trim(pub_date), 1, 10), '') end, '未知')"
)
ASPECTS = f"(select i.*, unnest(map_keys(dimension_sentiments)) as dim, unnest(map_values(dimension_sentiments)) as value from {STAT} i)"
RATIO = "round(case when {b} <> 0 then {a}::double / {b} else 0 end, 4)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "coded_items")


@query(f"""select s.sentiment, coalesce(n, 0) as n, round(case when sum(coalesce(n, 0)) over () > 0 then coalesce(n, 0)::double / sum(coalesce(n, 0)) over () else 0 end, 4) as ratio
  from (select unnest(['positive', 'negative', 'neutral']) as sentiment) s left join (select sentiment, count(*) as n from {STAT} group by 1) c on c.sentiment = s.sentiment""")
def sentiment_distribution(spark, d):
    return S.sentiment_distribution(items(spark, d))


_PLATFORM = """select platform, count(*) as posts, round(coalesce(avg(case when not coalesce(ad_flag, false) then sentiment_score end), 0) + 1e-9, 4) as avg_score,
  count(*) filter (where not coalesce(ad_flag, false) and sentiment = 'positive') as positive, count(*) filter (where not coalesce(ad_flag, false) and sentiment = 'negative') as negative,
  count(*) filter (where not coalesce(ad_flag, false) and sentiment = 'neutral') as neutral from coded_items group by 1"""


@query(_PLATFORM)
def platform_stats(spark, d):
    return S.platform_stats(items(spark, d))


_GRID = "count(*) as n, count(*) filter (where value = 'negative') as negative, round(count(*) filter (where value = 'negative')::double / count(*), 4) as negative_rate, round(avg(case value when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end) + 1e-9, 4) as avg_score"


@query(f"select dim, {_GRID} from {ASPECTS} group by 1")
def dimension_stats(spark, d):
    return S.aspect_grid(items(spark, d))


@query(f"select platform, dim, {_GRID} from {ASPECTS} group by 1, 2")
def platform_dim_grid(spark, d):
    return S.aspect_grid(items(spark, d), F.col("platform"))


@query(f"select {DAY} as day, dim, {_GRID} from {ASPECTS} group by 1, 2")
def date_dim_grid(spark, d):
    return S.aspect_grid(items(spark, d), S.day_text().alias("day"))


@query(f"""with g as (select dim, {_GRID} from {ASPECTS} group by 1) select * from g where n >= 3 order by negative_rate desc, dim limit 1""")
def worst_dimension(spark, d):
    return S.worst_dimension(S.aspect_grid(items(spark, d)))


@query(f"""with g as (select platform, dim, {_GRID} from {ASPECTS} group by 1, 2), r as (select *, row_number() over (partition by platform order by negative_rate desc, dim) as k from g where n >= 3)
  select platform, dim, n, negative, negative_rate from r where k = 1""")
def dim_worst_per_platform(spark, d):
    return S.worst_per_platform(S.aspect_grid(items(spark, d), F.col("platform")))


@query(f"""with g as (select {DAY} as day, dim, {_GRID} from {ASPECTS} group by 1, 2) select day, dim, n, negative from g where day <> '未知' order by negative desc, negative_rate desc, day, dim limit 3""")
def worst_days(spark, d):
    return S.worst_days(S.aspect_grid(items(spark, d), S.day_text().alias("day")))


@query(f"""with g as (select dim, {_GRID} from {ASPECTS} group by 1) select (select dim from g where n >= 3 order by avg_score desc, dim desc limit 1) as best, (select dim from g where n >= 3 order by avg_score, dim limit 1) as worst""")
def dim_radar(spark, d):
    return S.radar(S.aspect_grid(items(spark, d)))


@query(f"""with s as {STAT}
  select 'sentiment' as kind, sentiment as key, count(*) as n, round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) as avg_score from s group by 2
  union all select 'platform', platform, count(*), round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) from s group by 2
  union all select 'day', {DAY}, count(*), round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) from s group by 2
  union all select 'intensity', intensity::varchar, count(*), round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) from s group by 2""")
def item_sets(spark, d):
    return S.item_sets(items(spark, d))


_TREND = f"select {DAY} as day, count(*) as n, round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) as avg_score, count(*) filter (where sentiment = 'negative') as negative from {STAT} group by 1"


@query(_TREND)
def daily_trend(spark, d):
    return S.date_trend(items(spark, d))


@query(f"""with t as ({_TREND}), v as (select try_cast(day as date) as d, n, avg_score, negative from t where try_cast(day as date) is not null),
  k as (select *, case when (select max(d) - min(d) from v) > 90 then date_trunc('week', d)::date else d end as k from v)
  select min(d)::varchar as day, sum(n)::bigint as n, round(sum(n * avg_score) / sum(n) + 1e-9, 4) as avg_score, sum(negative)::bigint as negative from k group by k""")
def weekly_trend(spark, d):
    return S.weekly_trend(S.date_trend(items(spark, d)))


@query(f"""with t as ({_TREND}), v as (select *, row_number() over (order by day) as k, count(*) over () as m from t where day <> '未知'),
  h as (select round(avg(avg_score) filter (where k <= floor(m / 2)) + 1e-9, 3) as early, round(avg(avg_score) filter (where k > floor(m / 2)) + 1e-9, 3) as late from v)
  select early, late, (select day from v order by n desc, day limit 1) as peak_day, (select day from v order by negative desc, day limit 1) as worst_day,
    case when late - early > 0.05 then 'up' when early - late > 0.05 then 'down' else 'flat' end as direction from h""")
def trend_direction(spark, d):
    return S.trend_direction(S.date_trend(items(spark, d)))


@query(f"select i.intensity, coalesce(n, 0) as n from (select unnest(range(1, 6))::int as intensity) i left join (select intensity, count(*) as n from {STAT} group by 1) c on c.intensity = i.intensity")
def intensity_hist(spark, d):
    return S.intensity_histogram(items(spark, d))


@query("""with k as (select coalesce(nullif(trim(keyword), ''), '未分类') as keyword, 0 as posts, 0 as comments, 1 as coded, case when coalesce(ad_flag, false) then 0 else 1 end as stat,
    case when not coalesce(ad_flag, false) and sentiment = 'positive' then 1 else 0 end as positive, case when not coalesce(ad_flag, false) and sentiment = 'negative' then 1 else 0 end as negative,
    case when not coalesce(ad_flag, false) and sentiment = 'neutral' then 1 else 0 end as neutral from coded_items
  union all select coalesce(nullif(trim(keyword), ''), '未分类'), 1, 0, 0, 0, 0, 0, 0 from posts
  union all select coalesce(nullif(trim(p.keyword), ''), '未分类'), 0, 1, 0, 0, 0, 0, 0 from comments c left join (select id, min(keyword) as keyword from posts group by 1) p on p.id = c.post_id),
  s as (select keyword, sum(posts)::bigint as posts, sum(comments)::bigint as comments, sum(coded)::bigint as coded, sum(stat)::bigint as stat, sum(positive)::bigint as positive, sum(negative)::bigint as negative, sum(neutral)::bigint as neutral from k group by 1)
  select *, round(case when (case when stat > 0 then stat else coded end) <> 0 then negative::double / (case when stat > 0 then stat else coded end) else 0 end, 4) as negative_rate from s""")
def keyword_stats(spark, d):
    return S.keyword_stats(items(spark, d), table(spark, d, "posts"), table(spark, d, "comments"))


@query(f"""with w as (select item_seq, unnest(keywords) as word, generate_subscripts(keywords, 1) as pos from {STAT} where len(keywords) > 0),
  c as (select word, count(*) as n, min((item_seq, pos)) as first from w where word is not null group by 1) select word, n from c order by n desc, first, word limit 20""")
def top_keywords(spark, d):
    return S.top_keywords(items(spark, d))


_LEX = "(values " + ", ".join(f"('{w}', {s}::double)" for w, s in C.LEXICON.items()) + ") l(word, score)"


@query(f"""select l.word, case when l.score > 0 then 'positive' else 'negative' end as polarity, round(sum(abs(sentiment_score)), 4) as weight, count(*) as n
  from (select sentiment_score, unnest(keywords) as word from {STAT}) k join {_LEX} on l.word = k.word group by 1, 2""")
def word_polarity_weight(spark, d):
    return S.word_polarity_weight(items(spark, d), spark.createDataFrame(list(C.LEXICON.items()), "word string, score double"))


@query(f"select count(*) as n, round(coalesce(avg(sentiment_score), 0) + 1e-9, 4) as avg_score, case when coalesce(avg(sentiment_score), 0) > 0.15 then 'positive' when coalesce(avg(sentiment_score), 0) < -0.15 then 'negative' else 'neutral' end as label from {STAT}")
def overall_label(spark, d):
    return S.overall_label(items(spark, d))


@query("select count(*) filter (where coalesce(ad_flag, false)) as ads, count(*) as total, round(count(*) filter (where coalesce(ad_flag, false))::double / count(*), 4) as ratio from coded_items")
def ads_block(spark, d):
    return S.ads_block(items(spark, d))


@query(f"select count(*) filter (where method = 'llm') as model, count(*) filter (where method = 'llm' and lexicon_sentiment <> '' and lexicon_sentiment <> sentiment) as corrected from {STAT}")
def corrected_count(spark, d):
    return S.corrected_count(items(spark, d))


@query("""select platform, n, case when n = 0 then 'none' when n < 10 then 'too few' when n < 30 then 'indicative' when n < 45 then 'small' when n < 100 then 'usable' else 'ample' end as band
  from (select platform, count(*) filter (where not coalesce(ad_flag, false)) as n from coded_items group by 1)""")
def quality_gate(spark, d):
    return S.quality_gate(items(spark, d))


_CUBE = f"""with s as (select coalesce(attribution, '不明确') as actor, coalesce(narrative, 'none') as frame, sentiment from {STAT} where method = 'llm' and (narrative is not null or attribution is not null)),
  g as (select 'actor' as kind, actor, null::varchar as frame, count(*) as n, count(*) filter (where sentiment = 'negative') as negative from s group by actor
  union all select 'frame', null, frame, count(*), count(*) filter (where sentiment = 'negative') from s group by frame
  union all select 'both', actor, frame, count(*), count(*) filter (where sentiment = 'negative') from s group by actor, frame),
  c as (select *, round(case when n <> 0 then negative::double / n else 0 end, 4) as negative_rate, n < 10 as few, case when actor = '不明确' then 1 else 0 end as last from g)"""


@query(_CUBE + " select * from c")
def narrative_cube(spark, d):
    return S.narrative_cube(items(spark, d))


@query(_CUBE + " select actor, frame, n, negative_rate from c where kind = 'both' and n >= 10 and negative_rate >= 0.6")
def narrative_hotspots(spark, d):
    return S.narrative_hotspots(S.narrative_cube(items(spark, d)))


@query(f"""with n as (select platform, count(*) as collected from (select platform from posts union all select p.platform from comments c join (select id, min(platform) as platform from posts group by 1) p on p.id = c.post_id) group by 1),
  e as (select platform, count(*) as usable, count(*) filter (where sentiment = 'positive') as positive, count(*) filter (where sentiment = 'negative') as negative from {STAT} group by 1),
  j as (select n.platform, collected, coalesce(usable, 0) as usable, coalesce(positive, 0) as positive, coalesce(negative, 0) as negative from n left join e on e.platform = n.platform)
  select *, round(case when collected <> 0 then usable::double / collected else 0 end, 4) as share,
    case when usable >= 12 and positive >= 2 and negative >= 2 then 'ample' when usable >= 6 and (positive >= 2 or negative >= 2) then 'some' else 'little' end as tier from j""")
def consumer_voice(spark, d):
    return S.consumer_voice(table(spark, d, "posts"), table(spark, d, "comments"), items(spark, d))


@query(f"""select 1 as ord, 'collected' as stage, count(*) as n from posts union all select 2, 'kept', count(distinct id) from posts union all select 3, 'comments', count(*) from comments
  union all select 4, 'coded', count(*) from coded_items union all select 5, 'usable', count(*) from {STAT}""")
def funnel_stages(spark, d):
    return S.stages(table(spark, d, "posts"), table(spark, d, "comments"), items(spark, d))


_ORDER = "case when sentiment = 'negative' then 0 when sentiment = 'positive' then 1 else 2 end nulls first, sentiment_score desc nulls last, intensity desc nulls last, day nulls first, text_id nulls first, item_seq"


@query(f"""with c as (select *, {DAY} as day from {ASPECTS} where text is not null and text <> ''), r as (select *, row_number() over (partition by dim, value order by {_ORDER}) as k, count(*) over (partition by dim, value) as n from c)
  select dim, value as polarity, k, n, item_seq, text_id from r where k <= 3""")
def evidence_topk(spark, d):
    return E.dimension_cards(items(spark, d)).drop("quote")


@query(f"""with c as (select *, {DAY} as day from {ASPECTS} where text is not null and text <> ''), r as (select *, row_number() over (partition by dim, value order by {_ORDER}) as k from c), u as (select distinct item_seq from r where k <= 3)
  select item_seq, text_id, sentiment_score from (select *, {DAY} as day from {STAT}) where sentiment = 'negative' and text is not null and text <> '' and item_seq not in (select item_seq from u) order by {_ORDER} limit 5""")
def negative_cards(spark, d):
    i = items(spark, d)
    return E.negative_cards(i, E.dimension_cards(i)).drop("quote")


@query(f"""with s as {STAT} select 'overall' as kind, '' as key, count(*) as n, round(count(*) filter (where sentiment = 'negative')::double / count(*), 4) as value from s
  union all select 'platform', platform, count(*), round(count(*) filter (where sentiment = 'negative')::double / count(*), 4) from s group by 2
  union all select 'dimension', dim, count(*), round(count(*) filter (where value = 'negative')::double / count(*), 4) from {ASPECTS} group by 2""")
def stat_cards(spark, d):
    return E.stat_cards(items(spark, d))


_FIND = f"with f as (select dim, count(*) as n, count(*) filter (where value = 'negative') as negative, round(count(*) filter (where value = 'negative')::double / count(*), 4) as rate from {ASPECTS} group by 1)"


@query(_FIND + " select *, n >= 10 as confident from f where n >= 3 order by n >= 10 desc, round(n * rate, 4) desc, dim limit 4")
def findings_rank(spark, d):
    return E.findings(items(spark, d))


@query(_FIND + " select dim, n, rate from f where n >= 3 order by rate desc, dim limit 3")
def top_issues(spark, d):
    return E.top_issues(items(spark, d))


@query("""with p as (select * from posts where url is not null and url <> ''), e as (select content, arg_max(url, post_seq) as u1 from p where content is not null and content <> '' group by 1),
  l as (select lower(regexp_replace(content, '[\\s\\p{Z}]+', '', 'g')) as c, arg_max(url, post_seq) as u2 from p where content is not null and content <> '' group by 1), b as (select id, arg_min(url, post_seq) as u3 from p group by 1)
  select item_seq, coalesce(u1, u2, u3) as url from coded_items i left join e on e.content = i.text left join l on l.c = lower(regexp_replace(i.text, '[\\s\\p{Z}]+', '', 'g')) left join b on b.id = split_part(i.text_id, ':', 1)""")
def source_urls(spark, d):
    return E.source_urls(items(spark, d), table(spark, d, "posts"))


@query("""select item_seq, case when coalesce(ad_flag, false) then 'advertisement' when coalesce(need_review, false) then 'needs review' when method = 'llm' then 'by model' when len(coalesce(keywords, [])) > 0 then 'by words' else 'no hits' end as why from coded_items""")
def reason_labels(spark, d):
    return items(spark, d).select("item_seq", R.reason_label().alias("why"))


_REVIEW = """with r as (select item_seq, list_filter([case when coalesce(confidence, 0) < 0.7 then 'low confidence' end, case when lexicon_sentiment is not null and lexicon_sentiment <> '' and lexicon_sentiment <> sentiment then 'labels differ' end,
  case when regexp_matches(coalesce(text, ''), '[?？]\\s*$') then 'question' end, case when length(coalesce(text, '')) between 1 and 5 then 'short' end], lambda x: x is not null) as w, method from coded_items)"""


@query(_REVIEW + " select item_seq, array_to_string(case when len(w) > 0 and method <> 'llm' then list_prepend('direct', w) else w end, '；') as why from r")
def need_review(spark, d):
    return items(spark, d).select("item_seq", F.array_join(R.review_reasons(), "；").alias("why"))


@query("select case when c >= 0.8 then 'high' when c >= 0.5 then 'middle' else 'low' end as tier, method, count(*) as n from (select case when method = 'lexicon' then least(confidence, 0.6) else confidence end as c, method from coded_items) group by 1, 2")
def display_tier(spark, d):
    return items(spark, d).select(R.tier(R.shown_confidence(F.col("confidence"), F.col("method"))).alias("tier"), "method").groupBy("tier", "method").agg(F.count("*").alias("n"))


@query("select platform, count(*) filter (where platform = 'weibo' or coalesce(confidence, 0) < 0.8) as routed, count(*) as n from coded_items group by 1")
def llm_route(spark, d):
    return items(spark, d).groupBy("platform").agg(F.count_if(R.route_to_model(F.col("confidence"), F.col("platform") == "weibo")).alias("routed"), F.count("*").alias("n"))


@query("""with l as (select text_id, arg_max(user_sentiment, id) as usr from feedback where user_sentiment is not null and user_sentiment <> '' group by 1)
  select coalesce(usr, sentiment) as label, count(*) as n, count(*) filter (where usr is not null and usr <> sentiment) as changed from coded_items i left join l on l.text_id = i.text_id group by 1""")
def label_override(spark, d):
    return R.override(items(spark, d), table(spark, d, "feedback")).groupBy("label").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("""with f as (select unnest(list_filter([case when length(coalesce(text, '')) > 100 then 'long' end, case when regexp_matches(coalesce(text, ''), '[A-Za-z]{3,}') and regexp_matches(coalesce(text, ''), '\\p{Han}') then 'mixed' end,
  case when len(regexp_extract_all(coalesce(text, ''), '[\\x{1F000}-\\x{1FAFF}]')) >= 2 then 'emoji' end, case when regexp_matches(coalesce(text, ''), '呵呵|真是服了|好家伙|笑死|可真行') then 'irony' end, case when len(coalesce(dimensions, [])) >= 2 then 'aspects' end], lambda x: x is not null)) as feature from coded_items)
  select feature, count(*) as n from f group by 1""")
def edge_features(spark, d):
    return items(spark, d).select(F.explode(R.edge_features()).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


_CLASSES = "case " + " ".join(f"when regexp_matches(m, '{p}')" + (" and not starts_with(m, '[')" if n == "llm" else "") + f" then '{n}'" for n, p in C.ERROR_CLASSES) + " else 'unknown' end"


@query(f"select {_CLASSES} as class, count(*) as n from (select lower(coalesce(content, '')) as m from posts) group by 1")
def error_class(spark, d):
    return table(spark, d, "posts", "content").groupBy(R.error_class(F.col("content")).alias("class")).agg(F.count("*").alias("n"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in C.ERROR_CLASSES) + "]"


@query(f"""with m as (select platform, lower(coalesce(content, '')) as m from posts), c as (select platform, list(distinct {_CLASSES}) as got from m group by 1)
  select platform, list_transform(case when len(list_filter({_NAMES}, lambda n: list_contains(got, n))) > 0 then list_filter({_NAMES}, lambda n: list_contains(got, n)) else ['unknown'] end, lambda n: map {{{", ".join(f"'{k}': '{v}'" for k, v in C.FIXES.items())}}}[n]) as fixes from c""")
def fix_suggestions(spark, d):
    got = table(spark, d, "posts", "platform", "content").groupBy("platform", R.error_class(F.col("content")).alias("class")).agg(F.lit(1).alias("one")).groupBy("platform").agg(F.collect_set("class").alias("got"))
    names = F.array(*[F.lit(n) for n, _ in C.ERROR_CLASSES])
    found = F.filter(names, lambda n: F.array_contains("got", n))
    fixes = F.create_map(*[F.lit(x) for kv in C.FIXES.items() for x in kv])
    return got.select("platform", F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown"))), lambda n: F.element_at(fixes, n)).alias("fixes"))
