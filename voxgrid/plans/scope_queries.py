"""Queries of scopes, unions and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.operators import funnel, scoping
from voxgrid.operators import summary as S
from voxgrid.plans.funnel_queries import _EXTRACT, _R, frames
from voxgrid.plans.registry import query
from voxgrid.plans.summary_queries import _GRID, ASPECTS, items
from voxgrid.plans.text_queries import DOCS, docs
from voxgrid.session import table


@query("select channel_id, count(*) as n from posts where starts_with(channel_id, 'websearch') group by 1")
def websearch_rows(spark, d):
    return scoping.channel_rows(table(spark, d, "posts", "channel_id"), None).groupBy("channel_id").agg(F.count("*").alias("n"))


@query("select channel_id, count(*) as n from posts where url in (select url from posts where url is not null and not coalesce(ad_flag, false)) group by 1")
def kept_url_rows(spark, d):
    p = table(spark, d, "posts", "channel_id", "url", "ad_flag")
    return scoping.kept_rows(p, p.where(~F.coalesce("ad_flag", F.lit(False)))).groupBy("channel_id").agg(F.count("*").alias("n"))


@query(f"""with g as (select dim, {_GRID} from {ASPECTS} group by 1), w as (select dim from g where n >= 3 order by negative_rate desc, dim limit 1),
  t as (select unnest(d.tokens) as word from {DOCS} d join coded_items i on i.item_seq = d.doc, w where i.dimension_sentiments[w.dim] = 'negative')
  select word, count(*) as n from t group by 1 order by n desc, word limit 30""")
def worst_dimension_words(spark, d):
    """The words of the texts that are negative on the worst aspect."""
    worst = S.worst_dimension(S.aspect_grid(items(spark, d))).first()
    said = table(spark, d, "coded_items", F.col("item_seq").alias("doc"), "dimension_sentiments")
    return scoping.worst_words(docs(spark, d).join(said, "doc"), worst and worst.dim)


def _report(by: str) -> str:
    return _EXTRACT + f""", rr as (select {by}, sum(collected)::bigint as collected, sum(kept)::bigint as kept, sum(dropped)::bigint as dropped, sum(quality_dropped)::bigint as quality_dropped from f group by 1)
  select *, {_R.format('kept', 'collected')} as effective_rate, {_R.format('kept', '(kept + quality_dropped)')} as quality_rate from rr"""


@query(_report("keyword"))
def keyword_report(spark, d):
    return scoping.report_rows(funnel.extract(*frames(spark, d)), "keyword")


@query(_report("query"))
def query_report(spark, d):
    return scoping.report_rows(funnel.extract(*frames(spark, d)), "query")


@query("select post_seq from (select post_seq, row_number() over (partition by keyword order by coalesce(likes, 0) desc, post_seq) as k from posts) where k <= 5")
def hot_posts(spark, d):
    return scoping.hot_rows(table(spark, d, "posts", "post_seq", "keyword", "likes"), "keyword", "likes", "post_seq").select("post_seq")


@query("select channel_id, keyword from posts union select channel_id, keyword from coded_items")
def search_keys(spark, d):
    return scoping.key_union(table(spark, d, "posts"), table(spark, d, "coded_items"), "channel_id", "keyword")


@query("select keyword, max(n) as n from (select keyword, count(*) as n from posts group by 1 union all select keyword, count(*) from coded_items group by 1) group by 1")
def keyword_multiset(spark, d):
    count = lambda name: table(spark, d, name, "keyword").groupBy("keyword").agg(F.count("*").alias("n"))
    return scoping.max_union(count("posts"), count("coded_items"), "keyword")


@query("select item_seq, nullif(list_aggregate(list_sort(list_distinct(list_concat(coalesce(dimensions, []), coalesce(map_keys(dimension_sentiments), [])))), 'string_agg', ','), '') as dims from coded_items")
def item_dimension_union(spark, d):
    i = table(spark, d, "coded_items", "item_seq", "dimensions", "dimension_sentiments")
    dims = F.array_join(scoping.item_dimensions(F.col("dimensions"), F.col("dimension_sentiments")), ",")
    return i.select("item_seq", F.nullif(dims, F.lit("")).alias("dims"))


@query("""with e as (select item_seq, unnest(map_entries(dimension_sentiments)) as x from coded_items), a as (select item_seq, x.key as dim, lower(trim(x.value)) as sentiment from e)
  select dim, sentiment, count(*) as n from a where sentiment in ('positive', 'negative') and dim in (select dim_id from dim_schema) group by 1, 2""")
def aspects_sanitised(spark, d):
    known = sorted({r.dim_id for r in table(spark, d, "dim_schema", "dim_id").collect() if r.dim_id is not None})
    rows = table(spark, d, "coded_items", "dimension_sentiments").select(F.explode(scoping.aspects_kept(F.col("dimension_sentiments"), known)).alias("dim", "sentiment"))
    return rows.groupBy("dim", "sentiment").agg(F.count("*").alias("n"))


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"select case when lower(trim(narrative)) in {_IN(C.FRAMES)} then lower(trim(narrative)) end as frame, case when lower(trim(attribution)) in {_IN(C.ACTORS)} then lower(trim(attribution)) end as actor, count(*) as n from coded_items group by 1, 2")
def narratives_sanitised(spark, d):
    i = table(spark, d, "coded_items", "narrative", "attribution")
    return i.groupBy(scoping.narrative_kept(F.col("narrative")).alias("frame"), scoping.narrative_kept(F.col("attribution"), True).alias("actor")).agg(F.count("*").alias("n"))
