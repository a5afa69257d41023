"""Queries over texts: cleaning, masking, lexicon, tokens, de-duplication, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxgrid import config as C
from voxgrid.functions import dates as D
from voxgrid.functions import lexicon as L
from voxgrid.functions import stats as S
from voxgrid.functions import text as T
from voxgrid.operators import cleaning as K
from voxgrid.operators import tokens as TK
from voxgrid.plans.registry import query
from voxgrid.session import staged, table

WS = r"[\s\p{Z}\x{0085}\x{001C}-\x{001F}]"
TOKENS = TK.token_pattern(han=r"\p{Han}").replace("'", "''")
DOCS = f"(select item_seq as doc, list_filter(regexp_extract_all(lower(coalesce(text, '')), '({TOKENS})', 1), lambda w: w not in ({', '.join(repr(w) for w in C.STOPWORDS)})) as tokens, sentiment, sentiment_score as score from coded_items where not coalesce(ad_flag, false))"
_LEX = "(values " + ", ".join(f"('{w}', {s}::double)" for w, s in C.LEXICON.items()) + ") l(word, score)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "coded_items", "item_seq", "text", "sentiment", "sentiment_score", "ad_flag").where(~F.coalesce("ad_flag", F.lit(False)))
    return i.select(F.col("item_seq").alias("doc"), TK.segment(F.col("text")).alias("tokens"), "sentiment", F.col("sentiment_score").alias("score"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.LEXICON.items()), "word string, score double")


def dims(spark: SparkSession, d: str) -> list[tuple[str, list[str]]]:
    """The aspect schema: a reference table of fixed size."""
    return [(r.dim_id, list(r.keywords or [])) for r in table(spark, d, "dim_schema").orderBy("domain_id", "dim_ord").collect()]


@query(f"with w as (select unnest(tokens) as word from {DOCS}) select word, count(*) as n from w group by 1 order by n desc, word limit 50")
def word_freq(spark, d):
    return TK.word_freq(docs(spark, d))


_SIGNAL = f"""with w as (select unnest(list_distinct(tokens)) as word, score, sentiment, doc from {DOCS}),
  g as (select word, count(*) as docs, sum(greatest(score, 0)) as p, sum(greatest(-score, 0)) as q from w group by 1),
  s as (select word, docs, round(p + 1e-9, 4) as pos, round(q + 1e-9, 4) as neg, round(case when p + q > 0 then (p - q) / (p + q) else 0 end + 1e-9, 4) as signal from g)"""


@query(_SIGNAL + " select * from s")
def token_signal(spark, d):
    return TK.token_signal(docs(spark, d))


@query(_SIGNAL + f" select s.word, docs, signal, round((pos + neg) * least(docs, 20) * abs(signal) + 1e-9, 3) as weight from s left join {_LEX} on l.word = s.word where abs(signal) >= 0.25 or (abs(signal) >= 0.1 and coalesce(sign(l.score) = sign(signal), false))")
def wordcloud_weight(spark, d):
    return TK.cloud_weights(TK.token_signal(docs(spark, d)), lexicon(spark))


@query(f"""with w as (select unnest(list_distinct(tokens)) as word, sentiment from {DOCS} where sentiment in ('positive', 'negative'))
  select word, count(*) as total, count(*) filter (where sentiment = 'negative') as negative, round(count(*) filter (where sentiment = 'negative')::double / count(*), 3) as rate from w group by 1 having count(*) >= 5 order by rate desc, total desc, word limit 12""")
def sentiment_sources(spark, d):
    return TK.sentiment_sources(docs(spark, d))


_COOC = f"""with x as (select doc, unnest(tokens) as w, generate_subscripts(tokens, 1) as i from {DOCS} where len(tokens) > 0),
  p as (select distinct a.doc, least(a.w, b.w) as a, greatest(a.w, b.w) as b from x a join x b on a.doc = b.doc and b.i between a.i + 1 and a.i + 3 and a.w <> b.w),
  c as (select a, b, count(*) as n from p group by 1, 2 having count(*) >= 3), f as (select w, count(distinct doc) as df from x group by 1), t as (select count(*) as n_docs from {DOCS} where len(tokens) > 0),
  e as (select c.a as source, c.b as target, c.n, round(ln(c.n::double * n_docs / (fa.df * fb.df)), 3) as weight from c join f fa on fa.w = c.a join f fb on fb.w = c.b, t)"""


@query(_COOC + " select * from e order by weight desc, n desc, source, target limit 30")
def cooccurrence_pmi(spark, d):
    return TK.cooccurrence(TK.tokenised(docs(spark, d)))


_TOP = _COOC + ", k as (select * from e order by weight desc, n desc, source, target limit 30), v as (select unnest([source, target]) as word, weight, n, source, target from k)"


@query(_TOP + " select word, count(*) as degree, round(sum(weight), 3) as strength from v group by 1")
def node_degree(spark, d):
    return TK.node_degree(TK.cooccurrence(TK.tokenised(docs(spark, d))))


@query(_TOP + f""", wf as (select w as word, df as n from f), tn as (select distinct v.word, wf.n from v join wf on wf.word = v.word order by wf.n desc, v.word limit 20)
  select source, target, n, weight from k where source in (select word from tn) and target in (select word from tn) order by weight desc, n desc, source, target limit 20""")
def graph_trim(spark, d):
    x = TK.tokenised(docs(spark, d))
    return TK.trim_graph(TK.cooccurrence(x), TK.document_frequency(x))


@query(_TOP + " select source, target, n from k order by n desc, source, target limit 10")
def pair_rows(spark, d):
    return TK.pair_rows(TK.cooccurrence(TK.tokenised(docs(spark, d))))


_CLUSTERS = [["好用", "流畅", "顺手"], ["失望", "卡顿", "闪退"], ["great", "smooth"]]


@query(f"""with c as (select unnest([0, 1, 2])::int as cluster, unnest([{', '.join('[' + ', '.join(f"'{w}'" for w in c) + ']' for c in _CLUSTERS)}]) as m)
  select cluster, count(*) as doc_count, count(*) filter (where sentiment = 'negative') as negative, round(count(*) filter (where sentiment = 'negative')::double / count(*), 3) as rate from {DOCS} d join c on list_has_any(d.tokens, c.m) group by 1""")
def cluster_union_docs(spark, d):
    return TK.cluster_docs(docs(spark, d), _CLUSTERS)


@query()
def word_clusters(spark, d):
    """Communities of the trimmed graph and the documents that hold them."""
    x = TK.tokenised(docs(spark, d))
    edges = TK.trim_graph(TK.cooccurrence(x), TK.document_frequency(x))
    return TK.cluster_docs(x, TK.communities([(r.source, r.target, r.weight) for r in edges.collect()]))


_PHRASES = f"""with t as (select doc, score, tokens from {DOCS}), g as (select doc, score, tokens, unnest(range(1, len(tokens) + 1)) as i from t where len(tokens) > 1), k as (select doc, score, tokens[i:i + l - 1] as w from g, (select unnest([2, 3, 4, 5]) as l) where i + l - 1 <= len(tokens)),
  p as (select distinct doc, score, w[1] as a, w[-1] as b, case when regexp_matches(array_to_string(w, ''), '^[a-z0-9]+$') then array_to_string(w, ' ') else array_to_string(w, '') end as phrase from k),
  f as (select w, count(*) as df from (select distinct doc, unnest(tokens) as w from t) group by 1), n as (select count(*) as n_docs from t),
  c as (select a, b, phrase, count(distinct doc) as n, round(avg(score) + 1e-9, 3) as sentiment, [min(doc)] as samples from p where length(phrase) <= 40 group by 1, 2, 3 having count(distinct doc) >= 2),
  m as (select phrase, c.n, round(ln(c.n::double * n_docs / (fa.df * fb.df)), 3) as pmi, sentiment, samples from c join f fa on fa.w = a join f fb on fb.w = b, n),
  o as (select * from m where pmi >= 1.5 or (pmi >= 1.2 and abs(sentiment) >= 0.25))"""


@query(_PHRASES + " select * from o")
def ngram_phrases(spark, d):
    return TK.phrases(staged(docs(spark, d), "tokens"))


@query(_PHRASES + """, pc as (select n, phrase, unnest(range(1, len(phrase) + 1)) as i from o), pw as (select n, phrase, i, unnest(range(1, len(phrase))) as w from pc),
  ps as (select substring(phrase, i, w) as sub, max(n) as most from pw where i + w - 1 <= len(phrase) group by 1)
  select phrase, n, pmi, sentiment from o left join ps on sub = phrase where most is null or most < n order by n * (1 + pmi) desc, phrase limit 50""")
def phrases_suppressed(spark, d):
    """The best phrases without fragments of longer ones."""
    return TK.suppressed(staged(TK.phrases(staged(docs(spark, d), "tokens")), "phrases")).select("phrase", "n", "pmi", "sentiment")


@query()
def phrase_topics(spark, d):
    """Phrases coded to topics by polarity."""
    return TK.topics(TK.phrases(staged(docs(spark, d), "tokens")))


_EVERY = DOCS.replace(" where not coalesce(ad_flag, false)", "")


@query(f"""with x as (select d.tokens, list_distinct(list_filter(coalesce(i.dimensions, []), lambda v: v is not null and v <> '')) as dims from {_EVERY} d join coded_items i on i.item_seq = d.doc),
  w as (select dims, unnest(list_distinct(tokens)) as word from x), p as (select word, unnest(dims) as dim from w), g as (select word, dim, count(*) as n from p group by 1, 2)
  select word, dim, n from (select *, row_number() over (partition by word order by n desc, dim) as k from g) where k = 1""")
def dominant_dimension(spark, d):
    """The aspect that most items of a token mention."""
    i = table(spark, d, "coded_items", "item_seq", "text", "dimensions")
    return TK.dominant_dimension(i.select(TK.segment(F.col("text")).alias("tokens"), F.filter(F.array_distinct("dimensions"), lambda x: x.isNotNull() & (x != "")).alias("dims")))


@query()
def lexicon_score(spark, d):
    """The scanning scorer over every item; tests compare it with a character-by-character reading."""
    s = table(spark, d, "coded_items", "item_seq", "text").withColumn("s", L.scan(F.col("text")))
    return s.select("item_seq", F.col("s.score").alias("score"), F.col("s.sentiment").alias("sentiment"), F.col("s.confidence").alias("confidence"), F.col("s.pos").alias("pos"), F.col("s.neg").alias("neg"))


_PLAIN = " + ".join(
    f"case when contains(t, '{w}') and (" + " or ".join(f"contains(t, '{n + w}')" for n in C.NEGATIONS) + f") then {-0.8 * (1 if s > 0 else -1)}::double when contains(t, '{w}') then {1.0 if s > 0 else -1.0}::double else 0::double end" for w, s in C.LEXICON.items()
)


@query(f"select item_seq, round(tanh(({_PLAIN}) / 3.0), 4) as score from (select item_seq, lower(coalesce(text, '')) as t from coded_items)")
def lexicon_plain(spark, d):
    return table(spark, d, "coded_items", "item_seq", "text").select("item_seq", L.plain_score(F.col("text")).alias("score"))


@query("""with k as (select row_number() over (order by domain_id, dim_ord) as o, dim_id, unnest(keywords) as kw from dim_schema),
  m as (select distinct i.item_seq, k.o, k.dim_id from coded_items i join k on contains(lower(coalesce(i.text, '')), lower(k.kw)))
  select dim_id, count(*) as n from m group by 1""")
def dimension_mention(spark, d):
    rows = table(spark, d, "coded_items", "item_seq", "text").select(F.explode(L.mentions(F.col("text"), dims(spark, d))).alias("dim_id"))
    return rows.groupBy("dim_id").agg(F.count("*").alias("n"))


@query()
def aspect_sentiment(spark, d):
    """Unanimous clause votes per aspect of every item."""
    rows = table(spark, d, "coded_items", "item_seq", "text").select("item_seq", F.explode(L.aspect_votes(F.col("text"), dims(spark, d))).alias("dim", "sentiment"))
    return rows.groupBy("dim", "sentiment").agg(F.count("*").alias("n"))


@query(rf"""select post_seq, case when regexp_matches(t, '^[^\p{{L}}\p{{N}}\p{{M}}]*$') then '' else t end as text from (select post_seq, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
  '<[^>]+>', ' ', 'g'), 'https?://[^\s，。！？、（）()<>"'']+|www\.[^\s，。！？、（）()<>"'']+', ' ', 'g'), '@[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}\-]+', ' ', 'g'), '([!]{{3,}})', '!', 'g'), '{WS}+', ' ', 'g')) as t from posts where content is not null and not regexp_matches(content, '[?！？。，,.~～…]{{3}}'))""")
def clean_text(spark, d):
    """Cleaned contents; the SQL leaves out texts with runs of other marks than !, tests compare all with a plain reading."""
    p = table(spark, d, "posts", "post_seq", "content").where("content is not null")
    return p.select("post_seq", T.clean_text(F.col("content")).alias("text"))


@query("select comment_seq, regexp_replace(regexp_replace(regexp_replace(text, '[!]{3,}', '!', 'g'), '[！]{3,}', '！', 'g'), '[。]{3,}', '。', 'g') as text from comments where text is not null and not regexp_matches(text, '[?？，,.~～…]{3}')")
def punct_collapse(spark, d):
    """Repeated marks as one; the SQL leaves out texts with runs of other marks than !, ！ and 。, tests compare all with a plain reading."""
    p = table(spark, d, "comments", "comment_seq", "text").where("text is not null")
    return p.select("comment_seq", T.collapse_marks(F.col("text")).alias("text"))


@query()
def pii_mask(spark, d):
    """Comments with addresses, links, mentions and numbers blanked (look-behind has no SQL form here)."""
    return table(spark, d, "comments", "comment_seq", "text").select("comment_seq", T.mask(F.col("text")).alias("text"))


@query("select post_seq, substring(sha256(coalesce(title, '') || chr(10) || coalesce(content, '')), 1, 16) as fp from posts")
def fingerprints(spark, d):
    return table(spark, d, "posts", "post_seq", "title", "content").select("post_seq", T.fingerprint(F.col("title"), F.col("content")).alias("fp"))


_MARK = "[" + ", ".join(f"'{m}'" for m in C.AD_MARKERS) + "]"


@query(f"""with h as (select lower(concat_ws(' ', title, content)) as h from posts), m as (select list_filter({_MARK}, lambda m: contains(h, m))[1] as marker from h) select coalesce(marker, '') as marker, count(*) as n from m group by 1""")
def ad_marker(spark, d):
    m = table(spark, d, "posts", "title", "content").select(F.coalesce(T.ad_marker(F.col("title"), F.col("content")), F.lit("")).alias("marker"))
    return m.groupBy("marker").agg(F.count("*").alias("n"))


@query("""with t as (select source, lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'))) as t from documents)
  select source, count(*) filter (where regexp_matches(t, '版权所有|icp备|免责声明|点击进入|返回首页|all rights reserved|cookie policy|terms of service|privacy policy')) as flagged, count(*) as n from t group by 1""")
def boilerplate_flag(spark, d):
    return table(spark, d, "documents", "source", "text").groupBy("source").agg(F.count_if(T.boilerplate(F.coalesce("text", F.lit("")))).alias("flagged"), F.count("*").alias("n"))


@query("""select platform, count(*) filter (where regexp_matches(t, '官方旗舰店|官方网站') or (regexp_matches(t, '官网|首页') and not regexp_matches(t, '测评|评测|点评|论坛'))) as official, count(*) as n from (select platform, lower(coalesce(title, '')) as t from posts) group by 1""")
def official_pages(spark, d):
    return table(spark, d, "posts", "platform", "title").groupBy("platform").agg(F.count_if(T.official(F.col("title"))).alias("official"), F.count("*").alias("n"))


@query("""select post_seq, case when regexp_replace(lower(coalesce(keyword, '')), '[\\s\\p{Z}]+', '', 'g') <> '' and contains(regexp_replace(lower(concat_ws(' ', title, content)), '[\\s\\p{Z}]+', '', 'g'), regexp_replace(lower(coalesce(keyword, '')), '[\\s\\p{Z}]+', '', 'g')) then 1.0::double else 0.0::double end as score from posts""")
def relevance_contains(spark, d):
    return table(spark, d, "posts", "post_seq", "keyword", "title", "content").select("post_seq", T.relevance_contains(F.concat_ws(" ", "title", "content"), F.array(F.coalesce("keyword", F.lit("")))).alias("score"))


@query()
def relevance_lcs(spark, d):
    """The longest-common-substring score of title against keyword; tests compare it with a plain reading."""
    return table(spark, d, "posts", "post_seq", "keyword", "title").select("post_seq", T.relevance(F.col("title"), F.col("keyword")).alias("score"))


@query()
def normalized_dates(spark, d):
    """The lenient date of every post and its exact calendar day where it has one."""
    p = table(spark, d, "posts", "post_seq", "timestamp", "collected_at").withColumn("pub_date", D.normalize_pub_date(F.col("timestamp"), F.col("collected_at")))
    return p.select("post_seq", "pub_date", F.col("pub_date").try_cast("date").cast("string").alias("pub_day"))


@query("select bucket, count(*) as n from (select case when v is null then 'unknown' when span <= 0 then '0' else least(2, floor((v - lo) * 3.0 / span))::bigint::varchar end as bucket from (select v, min(v) over () as lo, max(v) over () - min(v) over () as span from (select collected_at::date as v from posts))) group by 1")
def time_buckets(spark, d):
    p = table(spark, d, "posts", "collected_at").select(F.to_date("collected_at").alias("day"))
    return p.select(S.time_bucket(F.col("day"), *S.span(p, "day")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("with k as (select url, min(post_seq) as post_seq from posts group by 1) select post_seq from k")
def url_dedupe(spark, d):
    return K.first_wins(table(spark, d, "posts", "post_seq", "url"), "post_seq", F.col("url")).select("post_seq")


@query("select min(item_seq) as item_seq from coded_items where text is not null group by text")
def dedupe_exact(spark, d):
    return K.first_wins(table(spark, d, "coded_items", "item_seq", "text").where("text is not null"), "item_seq", F.col("text")).select("item_seq")


@query("select min(post_seq) as post_seq from posts group by lower(coalesce(url, '')), substring(coalesce(title, ''), 1, 30)")
def dedupe_url_title(spark, d):
    return K.first_wins(table(spark, d, "posts", "post_seq", "url", "title"), "post_seq", F.lower(F.coalesce("url", F.lit(""))), F.substring(F.coalesce("title", F.lit("")), 1, 30)).select("post_seq")


@query()
def dedupe_greedy4(spark, d):
    """First-wins over id, address, title and body; tests compare it with a sequential reading."""
    return K.greedy_duplicates(table(spark, d, "posts", "post_seq", "id", "url", "title", "content"), "post_seq", K.post_keys())


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts")
    return staged(K.clean(p, T.relevance_contains(F.concat_ws(" ", "title", "content"), F.array(F.coalesce("keyword", F.lit(""))))), "cleaned")


@query()
def drop_reasons(spark, d):
    """How often each cleaning rule dropped a post."""
    return K.reason_counts(cleaned(spark, d))


@query("select count(*) as input, true as ok from posts")
def ledger_balance(spark, d):
    """Kept and dropped posts add up to the input."""
    return K.balance(cleaned(spark, d)).select("input", "ok")


@query()
def drop_ledger(spark, d):
    """The ledger of dropped posts."""
    return K.ledger(cleaned(spark, d))


_ONCE = "(select arg_min(c, comment_seq) as r from comments c group by case when coalesce(id, '') = '' then 'seq:' || comment_seq else id end)"


@query(f"""with o as (select r.* from {_ONCE}), t as (select *, row_number() over (partition by post_id order by coalesce(likes, 0) desc, comment_seq) as place from o where not coalesce(is_reply, false)),
  k as (select * from t where place <= 10), m as (select post_id, author, min(place) as place from k group by 1, 2),
  b as (select *, row_number() over (partition by post_id, reply_to order by coalesce(likes, 0) desc, comment_seq) as rn from o where coalesce(is_reply, false) and coalesce(reply_to, '') <> '')
  select post_id, place, 0 as part, comment_seq, likes from k union all select b.post_id, m.place, 1, b.comment_seq, b.likes from b join m on m.post_id = b.post_id and m.author = b.reply_to where rn = 1""")
def comment_flatten(spark, d):
    return K.flatten_comments(table(spark, d, "comments"))


@query("with r as (select post_seq, row_number() over (partition by keyword order by coalesce(likes, 0) desc, post_seq) as k from posts) select post_seq, k from r where k <= 5")
def per_key_limit(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("keyword").orderBy(F.desc(F.coalesce("likes", F.lit(0))), "post_seq")
    return table(spark, d, "posts", "post_seq", "keyword", "likes").withColumn("k", F.row_number().over(w)).where("k <= 5").select("post_seq", "k")


@query("select platform, count(*) as n from posts where contains(coalesce(url, ''), 'example') and not contains(coalesce(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), 'bilibili') group by 1")
def host_filter(spark, d):
    return K.by_host(table(spark, d, "posts", "platform", "url"), ["example"], ["bilibili"]).groupBy("platform").agg(F.count("*").alias("n"))


@query("""with l as (select date_trunc('year', max(collected_at)) as y from posts), u as (select distinct url from posts, l where collected_at < y and url is not null)
  select count(*) as n from posts p, l where collected_at >= y and (p.url is null or p.url not in (select url from u))""")
def skip_seen(spark, d):
    """Posts collected in the latest year whose address no earlier year has seen."""
    p = table(spark, d, "posts", "post_seq", "url", "collected_at")
    year = p.agg(F.date_trunc("year", F.max("collected_at"))).first()[0]
    return K.unseen(p.where(F.col("collected_at") >= F.lit(year)), p.where(F.col("collected_at") < F.lit(year))).agg(F.count("*").alias("n"))
