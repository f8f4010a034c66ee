"""B: catalogue cleaning. Nested results are compared as sorted text."""

from pyspark.sql import functions as F

from cartlight.operators import catalog as B
from cartlight.plans.registry import query, view

JUNK = ", ".join(f"'{w}'" for w in B.JUNK_WORDS)

# unpacked entries, written once more in SQL for the twins
view("x_sku", f"""
select product_id, dense_rank() over (partition by product_id order by sku_first) as sku_no, k, v from (
  select product_id, sku_id, k, v, min(pos) over (partition by product_id, sku_id) as sku_first,
         row_number() over (partition by product_id, sku_id, k order by pos desc) as newest
  from (select product_id, pos, lower(split_part(e, chr(1), 1)) as sku_id, lower(split_part(e, chr(1), 2)) as k,
               lower(split_part(e, chr(1), 3)) as v
        from (select product_id, unnest(string_split(sku, chr(2))) as e,
                     generate_subscripts(string_split(sku, chr(2)), 1) as pos from v_feed) x
        where len(string_split(e, chr(1))) = 3) y
  where v not in ({JUNK})) z
where newest = 1
""")
view("x_attr", f"""
select product_id, k, v, src, pos, row_number() over (partition by product_id, k, v order by src, pos) as nth from (
  select product_id, 2 as src, 0 as pos, lower(split_part(e, chr(1), 1)) as k, lower(split_part(e, chr(1), 2)) as v
  from (select product_id, unnest(string_split(spu, chr(2))) as e from v_feed) a where len(string_split(e, chr(1))) = 2
  union all
  select product_id, 1 as src, generate_subscripts(string_split(vals, chr(1)), 1) as pos, k, unnest(string_split(vals, chr(1))) as v
  from (select product_id, lower(split_part(e, chr(2), 1)) as k, lower(split_part(e, chr(2), 2)) as vals
        from (select product_id, unnest(string_split(cpv, chr(3))) as e from v_feed) b
        where len(string_split(e, chr(2))) = 4 and lower(split_part(e, chr(2), 3)) = 'y' and lower(split_part(e, chr(2), 4)) = 'y') c) d
where v not in ({JUNK})
""")
# keys stay even when every value is junk
view("x_attrkey", """
select product_id, k from x_attr union
select product_id, lower(split_part(e, chr(2), 1)) as k
from (select product_id, unnest(string_split(cpv, chr(3))) as e from v_feed) b
where len(string_split(e, chr(2))) = 4 and lower(split_part(e, chr(2), 3)) = 'y' and lower(split_part(e, chr(2), 4)) = 'y'
""")
view("x_keyfreq", """
select k, count(*) as n from (select product_id, k, 0 as sku_no from x_attrkey union all select product_id, k, sku_no from x_sku) u group by k
""")
view("x_valfreq", """
select v, count(*) as n from (select product_id, k, v from x_attr where nth = 1 union all select product_id, k, v from x_sku) u group by v
""")


def cleaned(t):
    return B.clean_feed(t.spread("v_feed"))


def _sku_text(col):
    """'1{color=red;size=4} 2{...}' with sorted keys."""
    one = F.transform(F.map_entries(col), lambda e: F.concat(
        e["key"].cast("string"), F.lit("{"),
        F.array_join(F.sort_array(F.transform(F.map_entries(e["value"]), lambda o: F.concat(o["key"], F.lit("="), o["value"]))), ";"),
        F.lit("}")))
    return F.array_join(F.sort_array(one), " ")


def _attr_text(col):
    one = F.transform(F.map_entries(col), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(F.sort_array(e["value"]), ",")))
    return F.array_join(F.sort_array(one), ";")


@query("drop_junk_value", f"""
select product_id, case when lower(brand_name) in ({JUNK}) then '' else brand_name end as brand from v_feed
""")
def drop_junk_value(t):
    return t.v_feed.select("product_id", B.drop_junk_value(F.col("brand_name")).alias("brand"))


@query("clean_text", """
select page_id, md5(substr(trim(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')), 1, 2000)) as digest from pages
""")
def clean_text(t):
    return t.pages.select("page_id", F.md5(B.clean_text(F.col("html"))).alias("digest"))


@query("clean_text_full")
def clean_text_full(t):
    return t.pages.select("page_id", F.length(B.clean_text(F.col("html"), full=True)).alias("n_chars"))


SKU_SQL = """
select product_id, string_agg(concat(cast(sku_no as varchar), '{', opts, '}'), ' ' order by sku_no) as sku_text
from (select product_id, sku_no, string_agg(concat(k, '=', v), ';' order by k) as opts from %s where sku_no <= 9 group by 1, 2) s group by 1
"""


@query("unpack_sku", SKU_SQL % "x_sku")
def unpack_sku(t):
    return t.v_feed.select("product_id", _sku_text(B.unpack_sku(F.col("sku"))).alias("sku_text"))


@query("unpack_spu", """
select product_id, string_agg(concat(k, '=', vs), ';' order by k) as spu_text
from (select product_id, k, string_agg(distinct v, ',' order by v) as vs from x_attr where src = 2 group by 1, 2) s group by 1
""")
def unpack_spu(t):
    return t.v_feed.select("product_id", _attr_text(B.unpack_spu(F.col("spu"))).alias("spu_text"))


@query("unpack_cpv", """
select product_id, string_agg(concat(k, '=', vs), ';' order by k) as cpv_text
from (select c.product_id, c.k, coalesce(string_agg(a.v, ',' order by a.v), '') as vs
      from x_attrkey c left join x_attr a on a.product_id = c.product_id and a.k = c.k and a.src = 1
      where c.k in ('kind', 'color') group by 1, 2) s group by 1
""")
def unpack_cpv(t):
    return t.v_feed.select("product_id", _attr_text(B.unpack_cpv(F.col("cpv"))).alias("cpv_text"))


@query("merge_attributes", """
select product_id, string_agg(concat(k, '=', vs), ';' order by k) as attr_text
from (select c.product_id, c.k, coalesce(string_agg(a.v, ',' order by a.v), '') as vs
      from x_attrkey c left join x_attr a on a.product_id = c.product_id and a.k = c.k and a.nth = 1 group by 1, 2) s group by 1
""")
def merge_attributes(t):
    return cleaned(t).select("product_id", _attr_text(F.col("attributes")).alias("attr_text"))


@query("attribute_frequency", """
select 'key' as kind, k as item, n from x_keyfreq union all select 'value', v, n from x_valfreq
""")
def attribute_frequency(t):
    keys, values = B.attribute_frequency(cleaned(t))
    return keys.select(F.lit("key").alias("kind"), F.col("k").alias("item"), "n").unionAll(
        values.select(F.lit("value").alias("kind"), F.col("v").alias("item"), "n"))


LONGTAIL = """
sku_kept as (
  select product_id, dense_rank() over (partition by product_id order by sku_no) as sku_no, k, v from x_sku
  where sku_no <= 9 and k in (select k from x_keyfreq where n >= 60) and v in (select v from x_valfreq where n >= 60)),
attr_kept as (
  select product_id, k, v from x_attr
  where nth = 1 and k in (select k from x_keyfreq where n >= 60) and v in (select v from x_valfreq where n >= 60))
"""


@query("filter_longtail", "with " + LONGTAIL + """
select f.product_id, coalesce(s.sku_text, '') as sku_text, coalesce(a.attr_text, '') as attr_text
from v_feed f
left join (""" + SKU_SQL % "sku_kept" + """) s on s.product_id = f.product_id
left join (select product_id, string_agg(concat(k, '=', vs), ';' order by k) as attr_text
  from (select product_id, k, string_agg(v, ',' order by v) as vs from attr_kept group by 1, 2) z group by 1) a on a.product_id = f.product_id
""")
def filter_longtail(t):
    out = B.filter_longtail(cleaned(t), threshold=60)
    return out.select("product_id", _sku_text(F.col("sku_options")).alias("sku_text"),
                      _attr_text(F.col("attributes")).alias("attr_text"))


@query("build_search_document", """
select f.product_id as id, concat(trim(replace(replace(replace(f.title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), chr(10), coalesce(s.vs, ''), chr(10), coalesce(a.vs, '')) as contents
from v_feed f left join (select product_id, string_agg(distinct v, ' ' order by v) as vs from x_sku where sku_no <= 9 group by 1) s on s.product_id = f.product_id
left join (select product_id, string_agg(distinct v, ' ' order by v) as vs from x_attr group by 1) a on a.product_id = f.product_id
""")
def build_search_document(t):
    return B.build_search_document(cleaned(t)).select("id", "contents")


@query("category_level1", """
select split_part(category, ' > ', 1) as level1, count(*) as n from v_product group by 1
""")
def category_level1(t):
    return t.v_product.groupBy(B.category_level1(F.col("category")).alias("level1")).agg(F.count("*").alias("n"))


@query("catalog_casts", """
select case when try_cast(sold_cnt as bigint) is null or try_cast(price as double) is null then 'rejected' else 'good' end as outcome,
       count(*) as n, round(sum(try_cast(price as double)), 2) as price_sum from v_feed group by 1
""")
def catalog_casts(t):
    good, bad = B.catalog_casts(t.v_feed)
    both = good.select(F.lit("good").alias("outcome"), "price_value").unionAll(
        bad.select(F.lit("rejected").alias("outcome"), "price_value"))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("price_value"), 2).alias("price_sum"))
