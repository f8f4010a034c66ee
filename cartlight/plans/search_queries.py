"""C: search and retrieval."""

from pyspark.sql import functions as F

from cartlight.operators import search as C
from cartlight.operators import search_index as X
from cartlight.plans.registry import query, view
from cartlight.session import work_path

view("v_request", """
select traj_id, step, k, q, page,
       case when k >= 85 then shop_param end as shop_id,
       case when k % 5 = 0 then '900-950' when k % 5 = 1 then '-930' when k % 5 = 2 then '940-'
            when k % 5 = 3 then 'cheap' end as price,
       case when k % 7 = 0 then 'order' when k % 7 = 1 then 'priceasc' when k % 7 = 2 then 'pricedesc'
            when k % 7 = 3 then 'newest' end as sort,
       case when k % 6 = 0 then 'official,gift' when k % 6 = 1 then 'COD,freeShipping,COD' when k % 6 = 2 then 'gift' end as service
from v_calls where name = 'find_product'
""")
view("v_item", """
select product_id, shop_id, title, price, services, sold_count,
       concat(title, chr(10), sku_size, chr(10), attr_brand, ' ', attr_type) as contents
from v_product
""")
# ranking of all matching documents, once more in SQL
RANK = """
{p}_tok as (select id, unnest(words) as term, len(words) as dl from (
   select id, list_filter(regexp_split_to_array(lower(contents), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as words from {corpus}) w),
{p}_qterm as (select qid, term, count(*) as qtf from (
   select qid, unnest(list_filter(regexp_split_to_array(lower(q), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) as term from {queries}) w group by 1, 2),
{p}_post as (select term, id, dl, count(*) as tf from {p}_tok where term in (select term from {p}_qterm) group by 1, 2, 3),
{p}_df as (select term, count(*) as df from {p}_post group by 1),
{p}_n as (select (select count(*) from {corpus}) as n,
   (select avg(len(list_filter(regexp_split_to_array(lower(contents), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) from {corpus}) as avgdl),
{p}_rank as (select *, row_number() over (partition by qid order by score desc, id) as rank from (
  select qid, p.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) as score
  from {p}_post p join {p}_qterm q on q.term = p.term join {p}_df d on d.term = p.term, {p}_n group by 1, 2) s)
"""
DOC_RANK = RANK.format(p="d", corpus="d_corpus", queries="d_query")
HIT = "with i_corpus as (select product_id as id, contents from v_item), i_query as (select distinct q as qid, q from {req}), " + \
    RANK.format(p="i", corpus="i_corpus", queries="i_query") + """,
asked as (select distinct q, page, shop_id, price, sort, service from {req}),
hits as (
  select a.*, p.product_id as id, p.price as price_value, p.sold_count, r.rank
  from asked a join i_rank r on r.qid = a.q and r.rank <= 5000 join v_item p on p.product_id = r.id
  where (a.shop_id is null or a.shop_id = p.shop_id)
    and (a.price is null or len(string_split(a.price, '-')) <> 2 or
         (coalesce(p.price >= try_cast(string_split(a.price, '-')[1] as double), true)
          and coalesce(p.price <= try_cast(string_split(a.price, '-')[2] as double), true)))
    and (a.service is null or list_has_all(string_split(p.services, ','),
         list_filter(string_split(a.service, ','), lambda s: s in ('official', 'freeShipping', 'COD', 'flashsale'))))),
kept as (select * from (select *, row_number() over (partition by q, page, shop_id, price, sort, service order by rank) as n from hits) h where n <= 50),
placed as (select *, row_number() over (partition by q, page, shop_id, price, sort, service order by
   case when sort = 'order' then -sold_count when sort = 'priceasc' then price_value when sort = 'pricedesc' then -price_value else 0 end, rank) as position from kept)
"""


HIT_RANK = "with i_corpus as (select product_id as id, contents from v_item), i_query as (select distinct q as qid, q from v_request), " + RANK.format(p="i", corpus="i_corpus", queries="i_query")


def items(t):
    return t.v_item.withColumn("service", F.split("services", ","))


@query("bm25_topk", "with d_corpus as (select doc_id as id, text as contents from documents), d_query as (select item_id as qid, text as q from benchmark), "
       + DOC_RANK + " select qid as item_id, id as doc_id, score, rank from d_rank where rank <= 20")
def bm25_topk(t):
    out = C.bm25_topk(t.benchmark, t.spread("documents"), k=20, query_id="item_id", query_text="text", id_col="doc_id", text_col="text")
    return out.select("item_id", F.col("id").alias("doc_id"), "score", "rank")


@query("price_filter", """
select product_id, price between 900 and 950 as closed_band, price <= 930 as open_low, price >= 940 as open_high,
       true as no_dash, true as three_parts, price >= 950 as bad_high from v_item
""")
def price_filter(t):
    def ok(text):
        return C.price_ok(F.col("price"), F.lit(text))

    return t.v_item.select("product_id", ok("900-950").alias("closed_band"), ok("-930").alias("open_low"),
                           ok("940-").alias("open_high"), ok("cheap").alias("no_dash"),
                           ok("1-2-3").alias("three_parts"), ok("950-x").alias("bad_high"))


@query("service_filter", """
select p.product_id, list_has_all(string_split(services, ','), ['COD', 'freeShipping']) as cod_and_free,
       list_has_all(string_split(services, ','), ['official']) as official_only from v_item p
""")
def service_filter(t):
    return items(t).select("product_id",
                           C.service_ok(F.col("service"), F.lit("COD,freeShipping,COD,gift")).alias("cod_and_free"),
                           C.service_ok(F.col("service"), F.lit("official,gift")).alias("official_only"))


@query("shop_filter", """
select product_id, coalesce(shop_id = '3', false) as in_shop, true as no_shop from v_item
""")
def shop_filter(t):
    return t.v_item.select("product_id", C.shop_ok(F.col("shop_id"), F.lit("3")).alias("in_shop"),
                           C.shop_ok(F.col("shop_id"), F.lit("")).alias("no_shop"))


SHOWN = "coalesce(shop_id, '-') as shop_id, coalesce(price, '-') as price, coalesce(sort, '-') as sort, coalesce(service, '-') as service"


def shown(df):
    return [F.coalesce(c, F.lit("-")).alias(c) for c in ["shop_id", "price", "sort", "service"]]


@query("search_sort", HIT.replace("{req}", "v_request") + f" select q, page, {SHOWN}, id, position from placed")
def search_sort(t):
    out = C.search(t.v_request, items(t), paged=False)
    return out.select("q", "page", *shown(out), "id", "position")


@query("search_page", HIT.replace("{req}", "v_request") + f" select q, page, {SHOWN}, id, position from placed where position > 10 * (cast(page as int) - 1) and position <= 10 * cast(page as int)")
def search_page(t):
    out = C.search(t.v_request, items(t))
    return out.select("q", "page", *shown(out), "id", "position")


@query("project_fields", "select product_id, shop_id, title, price, services as service, sold_count from v_item")
def project_fields(t):
    return C.project_fields(t.v_item.withColumn("service", F.col("services")))


@query("lookup_products", """
select c.traj_id, c.step, c.pos as call_pos, x.pos, x.product_id, p.price from v_calls c,
  lateral (select generate_subscripts(string_split(c.product_ids, ','), 1) - 1 as pos, unnest(string_split(c.product_ids, ',')) as product_id) x
  join v_product p on p.product_id = x.product_id where c.product_ids is not null
""")
def lookup_products(t):
    calls = t.v_calls.filter("product_ids is not null").select("traj_id", "step", F.col("pos").alias("call_pos"), "product_ids")
    return C.lookup_products(calls, t.v_product.select("product_id", "price")).select(
        "traj_id", "step", "call_pos", F.col("pos").cast("bigint").alias("pos"), "product_id", "price")


@query("product_cache", """
select 'cached' as outcome, count(*) as n from v_product where shop_id is not null and product_id in (select product_id from v_gold)
union all select 'missing', count(distinct product_id) from v_gold where product_id not in (select product_id from v_product where shop_id is not null)
""")
def product_cache(t):
    cached, missing = C.product_cache(t.v_gold, t.v_product.filter("shop_id is not null"))
    return cached.agg(F.lit("cached").alias("outcome"), F.count("*").alias("n")).unionAll(
        missing.agg(F.lit("missing").alias("outcome"), F.count("*").alias("n")))


view("x_variant", """
select k, q, 'original' as variant, page, shop_id, price, sort, service from v_request
union all select k, q, 'next_page', cast(cast(page as int) + 1 as varchar), shop_id, price, sort, service from v_request
union all select k, q, 'drop_shop_id', page, null, price, sort, service from v_request where shop_id is not null
union all select k, q, 'drop_price', page, shop_id, null, sort, service from v_request where price is not null
union all select k, q, 'drop_sort', page, shop_id, price, null, service from v_request where sort is not null
union all select k, q, 'drop_service', page, shop_id, price, sort, null from v_request where service is not null
union all select k, q, 'drop_all_optional_filters', page, null, null, null, null from v_request
 where shop_id is not null or price is not null or sort is not null or service is not null
""")


@query("search_variants", f"select variant, q, page, {SHOWN}, count(*) as n from x_variant group by all")
def search_variants(t):
    out = C.search_variants(t.v_request)
    return out.groupBy("variant", "q", "page", *shown(out)).agg(F.count("*").alias("n"))


view("v_best", """
select title, max(product_id) as product_id from v_product group by title
""")
view("v_missing", """
select distinct r.k, b.product_id from v_request r join v_best b on lower(b.title) = lower(regexp_replace(r.q, ' *[0-9]$', ''))
""")


@query("ablation_recovery", HIT.replace("{req}", "x_variant") + """
select v.variant, count(distinct concat(cast(m.k as varchar), m.product_id)) as recovered
from x_variant v join placed p on v.q = p.q and v.page = p.page and v.shop_id is not distinct from p.shop_id and v.price is not distinct from p.price
  and v.sort is not distinct from p.sort and v.service is not distinct from p.service
  and p.position > 10 * (cast(p.page as int) - 1) and p.position <= 10 * cast(p.page as int) and cast(p.page as int) <= 5
join v_missing m on m.k = v.k and m.product_id = p.id group by 1
""")
def ablation_recovery(t):
    requests = t.v_request.select("k", *C.SEARCH_PARAMETERS).distinct()
    out = C.ablation_recovery(requests, items(t), t.v_missing, key="k")
    return out.groupBy("variant").agg(F.count("*").alias("recovered"))


view("v_text_vector", """
select p.product_id as text_id, e.embedding from (select product_id, n from v_product, (select max(vec_id) + 1 as n from embeddings) m) p join embeddings e
  on e.vec_id = cast(p.product_id as bigint) % p.n
""")


@query("semantic_match", """
select x.*, cast(similarity >= 0.2 as int) as matched from (
select a.g, a.r, round(list_cosine_similarity(va.embedding::double[], vb.embedding::double[]), 6) as similarity
from (select distinct g.product_id as g, r.product_id as r from v_gold g join v_recommended r on r.order_id = g.order_id and r.slot = g.slot
      where g.product_id <> r.product_id) a
join v_text_vector va on va.text_id = a.g join v_text_vector vb on vb.text_id = a.r) x
""")
def semantic_match(t):
    pairs = t.v_gold.withColumnRenamed("product_id", "g").join(
        t.v_recommended.withColumnRenamed("product_id", "r"), ["order_id", "slot"]).filter("g <> r")
    out = C.semantic_match(pairs, t.v_text_vector, left="g", right="r", threshold=0.2)
    return out.select("g", "r", F.round("similarity", 6).alias("similarity"), "matched")


SIG = """
select traj_id, concat('{', concat_ws(',', '"page":"' || page || '"', case when price is not null then '"price":"' || lower(price) || '"' end,
  '"q":"' || lower(trim(q)) || '"', case when service is not null then '"service":"' || lower(service) || '"' end,
  case when shop_id is not null then '"shop_id":"' || shop_id || '"' end, case when sort is not null then '"sort":"' || sort || '"' end), '}') as signature
from v_request
"""


@query("search_signature", f"select signature, count(*) as n from ({SIG}) s group by 1")
def search_signature(t):
    r = t.v_request
    return r.groupBy(C.search_signature(r).alias("signature")).agg(F.count("*").alias("n"))


@query("repeated_searches", f"""
select traj_id, cast(sum(n) as bigint) as total_searches, count(*) as unique_searches, count(*) filter (n > 1) as repeated_searches
from (select traj_id, signature, count(*) as n from ({SIG}) s group by 1, 2) c group by 1
""")
def repeated_searches(t):
    return C.repeated_searches(t.v_request, by="traj_id")


@query("keyword_match", """
select conv_id, turn, cast(contains(lower(text), lower(role)) or contains(lower(concat(role, ' turn')), lower(role)) as int) as any_text,
       cast(contains(lower(text), 'the') as int) as in_text from conversations
""")
def keyword_match(t):
    c = t.conversations
    return c.select("conv_id", "turn", C.keyword_match(F.col("role"), F.col("text"), F.concat("role", F.lit(" turn"))).alias("any_text"),
                    C.keyword_match(F.lit("THE"), F.col("text")).alias("in_text"))


@query("query_expansion", """
with w as (select conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as words, role from conversations),
c as (select conv_id, turn, 0 as o, clean as candidate from w
  union all select conv_id, turn, 1, array_to_string(words[1:12], ' ') from w where len(words) >= 12
  union all select conv_id, turn, 2, array_to_string(words[1:8], ' ') from w where len(words) >= 8
  union all select conv_id, turn, 3, array_to_string(words[1:5], ' ') from w where len(words) >= 5
  union all select conv_id, turn, 4, array_to_string(words[1:3], ' ') from w where len(words) >= 3
  union all select conv_id, turn, 5, array_to_string(list_concat(words[1:5], [role, 'shop']), ' ') from w
  union all select conv_id, turn, 6, concat(role, ' shop') from w)
select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by o) - 1 as int) as pos, md5(candidate) as digest
from (select conv_id, turn, candidate, min(o) as o from c where candidate <> '' group by 1, 2, 3) d
""")
def query_expansion(t):
    df = t.conversations.withColumn("vals", F.array("role", F.lit("shop")))
    return C.query_expansion(df, title="text", values="vals").select("conv_id", "turn", "pos", F.md5("candidate").alias("digest"))


@query("overlap_rank", """
with seg as (select c.conv_id, c.turn, coalesce(b.text, '') as title, c.role,
    generate_subscripts(string_split(c.text, chr(10)), 1) - 1 as pos, unnest(string_split(c.text, chr(10))) as segment
  from conversations c left join benchmark b on b.item_id = c.conv_id),
s as (select conv_id, turn, pos, list_distinct(list_filter(regexp_split_to_array(lower(segment), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as ws,
    list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as tw, [lower(role), 'la', 'the'] as vw
  from seg where trim(regexp_replace(segment, '\\s+', ' ', 'g')) <> '')
select conv_id, turn, cast(pos as int) as pos, overlap, rank from (
  select *, row_number() over (partition by conv_id, turn order by overlap desc, pos) as rank from (
    select conv_id, turn, pos, len(list_intersect(ws, tw)) + 2 * len(list_intersect(ws, vw)) as overlap from s) a) b where rank <= 4
""")
def overlap_rank(t):
    titles = t.benchmark.select(F.col("item_id").alias("conv_id"), F.col("text").alias("title"))
    df = t.conversations.join(titles, "conv_id", "left").select(
        "conv_id", "turn", F.split("text", "\n").alias("segments"), F.coalesce("title", F.lit("")).alias("title"),
        F.array("role", F.lit("la"), F.lit("the")).alias("vals"))
    out = C.overlap_rank(df, key=["conv_id", "turn"], segments="segments", title="title", values="vals")
    return out.select("conv_id", "turn", "pos", "overlap", "rank")


def built_index(t, corpus, parts=3):
    """An index of ``corpus`` (id, contents), appended to by hash of the id."""
    path = work_path(t.spark, "search-index")
    for part in range(parts):
        X.append_to_index(corpus.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part), path, width=512)
    return path


def document_index(t):
    return built_index(t, t.spread("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents")))


@query("search_index", "with d_corpus as (select doc_id as id, text as contents from documents), d_query as (select item_id as qid, text as q from benchmark), "
       + DOC_RANK + " select qid as item_id, id as doc_id, score, rank from d_rank where rank <= 20")
def search_index(t):
    out = X.search_index(t.benchmark, document_index(t), k=20, query_id="item_id", query_text="text", prune_above=0)
    return out.select("item_id", F.col("id").alias("doc_id"), "score", "rank")


@query("search_index_products", HIT_RANK + " select qid as q, id as product_id, score, rank from i_rank where rank <= 50")
def search_index_products(t):
    path = built_index(t, t.v_item.select(F.col("product_id").alias("id"), "contents"), parts=2)
    return X.search_index(t.v_request.select("q").distinct(), path, k=50, query_id="q", query_text="q").select("q", F.col("id").alias("product_id"), "score", "rank")


# every list of the index once more: lengths and largest counts by term, whatever the appends and blocks
@query("search_index_terms", """
with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as words from documents),
tf as (select doc_id, len(words) as dl, unnest(words) as term from w), c as (select doc_id, dl, term, count(*) as tf from tf group by 1, 2, 3)
select term, count(*) as df, sum(tf)::bigint as occurrences, max(tf) as max_tf, min(dl) as min_dl from c group by 1
""")
def search_index_terms(t):
    lists = X.index_postings(t.spark, document_index(t))
    return lists.groupBy("term").agg(
        F.sum("n").cast("bigint").alias("df"), F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("occurrences"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


@query("search_index_manifest", """
with w as (select len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as dl from documents)
select 3::bigint as appends, count(*) as documents, count(dl) as texts, sum(dl)::bigint as words from w
""")
def search_index_manifest(t):
    return X.index_manifest(t.spark, document_index(t)).agg(
        F.count("*").alias("appends"), F.sum("documents").alias("documents"), F.sum("texts").alias("texts"), F.sum("words").alias("words"))
