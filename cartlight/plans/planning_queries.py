"""D: planning of queries and vouchers."""

from pyspark.sql import functions as F

from cartlight.operators import planning as D
from cartlight.plans.registry import query, view
from cartlight.plans.scoring_queries import products_nested

view("v_spec_key", "select cast(s_suppkey as string) as sample_id from supplier")
view("v_voucher_base", """
select p.order_id as sample_id, p.total_price as total, p.voucher_type, p.discount_type,
  case when p.cust % 3 = 0 then 'easy' when p.cust % 3 = 1 then 'medium' else 'hard' end as difficulty_bucket from v_plan p
""")


def hint(key, seed):
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint)"


def hrange(key, low, high, seed):
    return f"cast({low} + floor({hint(key, seed)} / 4294967296.0::double * ({high} - ({low}) + 1)) as bigint)"


@query("sampling_pool", "select shop_id, count(*) as n, round(sum(price), 2) as total from v_product where price > 0 and shop_id is not null group by 1")
def sampling_pool(t):
    return D.sampling_pool(t.v_product.filter("shop_id is not null")).groupBy("shop_id").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


QUOTA = """
w(v, weight, ord) as (values {values}),
q0 as (select v, ord, floor(weight * n) as base, weight * n - floor(weight * n) as frac, weight * n as raw, n from w, (select count(*) as n from {table}) z),
q as (select v, ord, base + (row_number() over (order by frac desc, raw desc, ord) <= n - (select sum(base) from q0))::int as quota from q0),
c as (select v, sum(quota) over (order by ord) as hi, sum(quota) over (order by ord) - quota as lo from q),
"""


def quota_sql(weights, table):
    values = ", ".join(f"('{v}', {w}::double, {i})" for i, (v, w) in enumerate(weights.items()))
    return QUOTA.format(values=values, table=table)


@query("expand_quota", "with " + quota_sql(D.DIFFICULTY_WEIGHTS, "customer") + """
r as (select c_custkey, row_number() over (order by md5('s:' || c_custkey), c_custkey) as i from customer)
select r.c_custkey, c.v as difficulty from r join c on r.i > c.lo and r.i <= c.hi
""")
def expand_quota(t):
    out = D.expand_quota(t.customer, key="c_custkey", name="difficulty", weights=D.DIFFICULTY_WEIGHTS, seed="s")
    return out.select("c_custkey", "difficulty")


@query("assign_openers", "with " + quota_sql(D.OPENER_WEIGHTS, "customer") + """
r as (select c_custkey, row_number() over (order by md5('0:opener:' || c_custkey), c_custkey) as i from customer)
select r.c_custkey, c.v as opener_bucket from r join c on r.i > c.lo and r.i <= c.hi
""")
def assign_openers(t):
    return D.assign_openers(t.customer, key="c_custkey").select("c_custkey", "opener_bucket")


PAIRS = {f"{n}:{v}": w for (n, v), w in D.PRODUCT_VOUCHER_WEIGHTS.items()}


@query("build_specs", "with " + quota_sql(PAIRS, "supplier") + """
r as (select cast(s_suppkey as varchar) as sample_id, row_number() over (order by md5('0:pair:' || s_suppkey), cast(s_suppkey as varchar)) as i from supplier)
select r.sample_id, cast(split_part(c.v, ':', 1) as int) as n_products, split_part(c.v, ':', 2) as voucher_type from r join c on r.i > c.lo and r.i <= c.hi
""")
def build_specs(t):
    return D.build_specs(t.v_spec_key, key="sample_id").select("sample_id", "n_products", "voucher_type")


@query("spec_distribution", "with " + quota_sql(D.DISCOUNT_WEIGHTS, "supplier").rstrip().rstrip(",") + " select v as discount_type, cast(hi - lo as bigint) as n from c where hi > lo")
def spec_distribution(t):
    return D.build_specs(t.v_spec_key, key="sample_id").groupBy("discount_type").agg(F.count("*").alias("n"))


def assigned(t):
    specs = D.build_specs(t.v_spec_key, key="sample_id")
    excluded = t.v_product.filter("sku_size = '1'").select("product_id")
    return specs, D.assign_products(specs, t.v_product.filter("shop_id is not null"), excluded=excluded)


@query("assign_products")
def assign_products(t):
    return assigned(t)[1]


def assignment_check(specs, products, excluded, lines):
    """Rules that must hold, what is left over, and whether anything left over could still be served."""
    per = lines.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("shop_id").alias("a"), F.max("shop_id").alias("b")).join(specs, "sample_id")
    reused = lines.groupBy("product_id").count().filter("count > 1").agg(F.count("*"))
    used = lines.join(excluded, "product_id", "left_semi").agg(F.count("*"))
    rest = D.unassigned(specs, lines)
    free = products.join(excluded, "product_id", "left_anti").join(lines, "product_id", "left_anti")
    most = free.groupBy("shop_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    stuck = rest.agg(
        F.count_if((F.col("voucher_type") == "shop") & (F.col("n_products") <= most.scalar())).alias("shop"),
        F.count_if((F.col("voucher_type") == "platform") & (F.col("n_products") <= free.agg(F.count("*")).scalar())).alias("platform"),
        F.count("*").alias("rest"))
    shop = per.filter("voucher_type = 'shop'")
    return per.agg(
        reused.scalar().alias("reused"), F.count_if((F.col("voucher_type") == "shop") & (F.col("a") != F.col("b"))).alias("mixed_shops"),
        used.scalar().alias("excluded_used"), F.count_if(F.col("n") != F.col("n_products")).alias("wrong_size"),
        stuck.select("shop").scalar().alias("servable_by_a_shop"), stuck.select("platform").scalar().alias("servable_by_all"),
        (F.count("*") + stuck.select("rest").scalar()).alias("specs"), (F.coalesce(F.sum("n"), F.lit(0)) + free.agg(F.count("*")).scalar()).alias("products"),
        F.count_if((F.col("voucher_type") == "shop") & (F.col("n_products") == specs.filter("voucher_type = 'shop'").agg(F.max("n_products")).scalar())).alias("largest_served"))


# how many of the largest baskets of a shop are served depends on the counts alone
CHECK = """
, pool as (select product_id, shop_id from v_product where shop_id is not null and sku_size <> '1'),
big as (select n_products as n, count(*) as asked from s where voucher_type = 'shop' group by 1 order by 1 desc limit 1),
room as (select sum(floor(c / n)) as baskets from (select shop_id, count(*) as c from pool group by 1) x, big)
select 0::bigint as reused, 0::bigint as mixed_shops, 0::bigint as excluded_used, 0::bigint as wrong_size, 0::bigint as servable_by_a_shop, 0::bigint as servable_by_all,
  (select count(*) from s) as specs, (select count(*) from pool) as products, (select least(asked, baskets)::bigint from big, room) as largest_served
"""


@query("assign_products_check", "with " + quota_sql(PAIRS, "supplier") + """
r as (select cast(s_suppkey as varchar) as sample_id, row_number() over (order by md5('0:pair:' || s_suppkey), cast(s_suppkey as varchar)) as i from supplier),
s as (select r.sample_id, cast(split_part(c.v, ':', 1) as int) as n_products, split_part(c.v, ':', 2) as voucher_type from r join c on r.i > c.lo and r.i <= c.hi)
""" + CHECK)
def assign_products_check(t):
    specs, lines = assigned(t)
    return assignment_check(specs, t.v_product.filter("shop_id is not null"), t.v_product.filter("sku_size = '1'").select("product_id"), lines)


# many more specs than products: shops and the whole pool run dry
view("x_scarce_spec", """
select cast(o_orderkey as string) as sample_id, cast(1 + o_custkey % 7 as int) as n_products, case when o_custkey % 3 = 0 then 'platform' else 'shop' end as voucher_type from orders
""")


@query("assign_scarce_products_check", "with s as (select * from x_scarce_spec)" + CHECK)
def assign_scarce_products_check(t):
    products, excluded = t.v_product.filter("shop_id is not null"), t.v_product.filter("sku_size = '1'").select("product_id")
    return assignment_check(t.x_scarce_spec, products, excluded, D.assign_products(t.x_scarce_spec, products, excluded=excluded))


def bucket(values):
    return f"case difficulty_bucket when 'easy' then {values['easy']}::double when 'medium' then {values['medium']}::double else {values['hard']}::double end"


def side(table, i):
    return bucket({k: v[i] for k, v in table.items()})


view("x_built", f"""
select *, {hrange('sample_id', 'bl', 'greatest(bl, bu)', '0:budget')} as budget from (
 select *, greatest(ceil(price_after_voucher), ceil(price_after_voucher * ({side(D.BUDGET_SLACK, 0)}))) as bl, floor(price_after_voucher * ({side(D.BUDGET_SLACK, 1)})) as bu from (
  select *, case when discount_type = 'fixed' then total - face_value else greatest(total * (1 - discount), total - cap) end as price_after_voucher from (
   select *, case when discount_type = 'fixed' then {hrange('sample_id', 'fl', 'greatest(fl, floor(threshold * 0.5::double))', '0:face')} end as face_value,
     case when discount_type <> 'fixed' then pct / 100.0::double end as discount,
     case when discount_type <> 'fixed' then {hrange('sample_id', '(mc + 1)', 'threshold', '0:cap')} end as cap from (
    select *, greatest(1, floor(threshold * 0.1::double)) as fl, floor(threshold * pct / 100.0::double) as mc from (
     select *, least({hrange('sample_id', 'tl', 'greatest(tl, tu)', '0:threshold')}, cast(floor(total) as bigint)) as threshold, {hrange('sample_id', '10', '50', '0:percent')} as pct from (
      select *, greatest(1, ceil(total * ({side(D.THRESHOLD_RATIO, 0)}))) as tl, floor(total * ({side(D.THRESHOLD_RATIO, 1)})) as tu from v_voucher_base where total >= 100) a) b) c) d) e) f
""")


@query("build_voucher", "select sample_id, threshold, coalesce(face_value, -1) as face_value, round(coalesce(discount, -1), 4) as discount, coalesce(cap, -1) as cap, round(price_after_voucher, 4) as price_after_voucher, budget from x_built")
def build_voucher(t):
    v = D.build_voucher(t.v_voucher_base)
    minus = F.lit(-1)
    return v.select("sample_id", "threshold", F.coalesce("face_value", minus).alias("face_value"), F.round(F.coalesce("discount", minus.cast("double")), 4).alias("discount"),
                    F.coalesce("cap", minus).alias("cap"), F.round("price_after_voucher", 4).alias("price_after_voucher"), "budget")


TEXT = """concat(case when voucher_type = 'shop' then '1. The voucher only applies to the products from the same shop.' else '1. The voucher applies to all products.' end, chr(10),
 '2. It is valid only when the total price of the products exceeds `', threshold, '`.', chr(10), case when discount_type = 'fixed' then concat('3. It provides a fixed discount of `', face_value, '`.')
 else concat('3. It provides a percentage discount of `', pct, '%` with a cap of `', cap, '`.') end)"""


@query("describe_voucher", f"select sample_id, {TEXT} as sentences from x_built")
def describe_voucher(t):
    return D.build_voucher(t.v_voucher_base).select("sample_id", D.describe_voucher().alias("sentences"))


@query("parse_voucher_text", """
select sample_id, voucher_type as scope, threshold::double as threshold, budget::double as budget, discount_type, coalesce(face_value, -1)::double as face_value, round(coalesce(discount, -1), 4) as discount, coalesce(cap, -1)::double as cap, true as parse_ok from x_built
""")
def parse_voucher_text(t):
    v = D.build_voucher(t.v_voucher_base).withColumn("text", F.concat(F.lit("Looking for rings over there. "), D.budget_sentence()))
    p = D.parse_voucher_text(v.select("sample_id", "text"), text="text")
    minus = F.lit(-1.0)
    return p.select("sample_id", "scope", F.col("parsed_threshold").alias("threshold"), F.col("parsed_budget").alias("budget"), F.col("parsed_type").alias("discount_type"),
                    F.coalesce("parsed_value", minus).alias("face_value"), F.round(F.coalesce("parsed_rate", minus), 4).alias("discount"), F.coalesce("parsed_cap", minus).alias("cap"), "parse_ok")


COUNT = f"""case c when 'low' then case when u < 0.35 then 1 else 2 end when 'medium' then case when u < 0.45 then 2 else 3 end
  when 'high' then case when u < 0.3 then 3 when u < 0.75 then 4 else 5 end else case when u < 0.1 then 5 + s % 3 when u < 0.35 then 2 else 3 + s % 2 end end"""
view("x_target", f"""
select product_id, title, services, attr_brand, attr_type, attr_color, sku_size, cast({COUNT} as int) as target from (
 select *, {hint('product_id', '0:fields')} / 4294967296.0 as u, {hint('product_id', '0:spread')} as s,
   case when cast(sku_size as int) < 10 then 'low' when cast(sku_size as int) < 20 then 'medium' when cast(sku_size as int) < 30 then 'high' else 'free' end as c from v_product) p
""")


def targets(t):
    size = F.col("sku_size").cast("int")
    c = F.when(size < 10, "low").when(size < 20, "medium").when(size < 30, "high").otherwise("free")
    return t.v_product.select("product_id", D.target_field_count(c, F.col("product_id")).alias("target"))


@query("target_field_count", "select product_id, target from x_target")
def target_field_count(t):
    return targets(t)


@query("sample_constraints", """
with g as (
  select product_id, target, md5('0:' || product_id || ':sku_options:1') as h, 'size' as k, sku_size as v from x_target
  union all select product_id, target, md5('0:' || product_id || ':sku_options:2'), 'size', cast(cast(sku_size as int) + 1 as varchar) from x_target
  union all select product_id, target, md5('0:' || product_id || ':attributes:brand'), 'brand', attr_brand from x_target
  union all select product_id, target, md5('0:' || product_id || ':attributes:type'), 'type', attr_type from x_target
  union all select product_id, target, md5('0:' || product_id || ':attributes:color'), 'color', attr_color from x_target
  union all select product_id, target, md5('0:' || product_id || ':service:' || s), s, s from (select product_id, target, unnest(string_split(services, ',')) as s from x_target) u where s in ('freeShipping', 'COD')),
o as (select *, row_number() over (partition by product_id order by h) as n from (select *, row_number() over (partition by product_id, k order by h) as d from g) x where d = 1)
select t.product_id, coalesce(string_agg(o.k || '=' || o.v, ';' order by o.h), '') as chosen, 1 + count(o.k) as field_count
from x_target t left join o on o.product_id = t.product_id and o.n < t.target group by 1
""")
def sample_constraints(t):
    p = products_nested(t).select("product.*").join(targets(t), "product_id")
    out = D.sample_constraints(p)
    pairs = F.flatten(F.transform("chosen", lambda g: F.transform(F.arrays_zip(g["keys"].alias("a"), g["vals"].alias("b")), lambda z: F.concat(z["a"], F.lit("="), z["b"]))))
    return out.select("product_id", F.array_join(pairs, ";").alias("chosen"), F.col("field_count").cast("bigint").alias("field_count"))


@query("price_band", f"""
select product_id, case when ok then mode else '-' end as mode, case when ok then lo else -1 end as lo, case when ok and hi is not null then hi else -1 end as hi from (
 select *, lo >= 0 and price > lo and (hi is null or price < hi) as ok from (
  select product_id, price, case m when 0 then 'less than' when 1 then 'greater than' else 'between' end as mode,
    case m when 0 then 0 else cast(floor(price - {hrange('product_id', '0', 'floor(price)', '0:down')}) as bigint) end as lo, case when m <> 1 then cast(floor(price + {hrange('product_id', '0', 'floor(price)', '0:up')}) as bigint) end as hi
  from (select *, {hint('product_id', '0:mode')} % 3 as m from v_product) a) b) c
""")
def price_band(t):
    out = D.price_band(t.v_product)
    return out.select("product_id", F.coalesce("mode", F.lit("-")).alias("mode"), F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


@query("render_prompt", """
select order_id, md5(concat('Write one or more products: ', case when count(*) = 1 then any_value(concat('1. ', title, chr(10), '2. ', category))
  else string_agg(concat('## Product ', slot, chr(10), '1. ', title, chr(10), '2. ', category), chr(10) || chr(10) order by slot) end)) as digest
from v_gold g join v_product p on p.product_id = g.product_id group by 1
""")
def render_prompt(t):
    items = t.v_gold.join(t.v_product, "product_id").withColumn("req", F.array(F.concat(F.lit("1. "), "title"), F.concat(F.lit("2. "), "category")))
    out = D.render_prompt(items, by="order_id", pos="slot", requirements="req", template="Write <|task|>: <|requirements|>")
    return out.select("order_id", F.md5("prompt").alias("digest"))


@query("title_only_cap", """
select c_custkey, t = 0 or sum(t) over (order by c_custkey) <= (select ceil(sum(n) * 0.1) from (select 1 + c_custkey % 4 as n from customer) z) as accepted
from (select c_custkey, c_custkey % 3 as t from customer) c
""")
def title_only_cap(t):
    df = t.customer.select("c_custkey", (F.col("c_custkey") % 3).alias("t"), (1 + F.col("c_custkey") % 4).alias("n"))
    return D.title_only_cap(df, order="c_custkey", title_only="t", products="n", max_share=0.1).select("c_custkey", "accepted")


# one vector a step: the farthest from all those before it
MAXIMIN = """
with recursive w as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
v as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from w where list_dot_product(e, e) > 0),
steps(i, ids, us) as (
  select 1, [min(vec_id)], [arg_min(u, vec_id)] from v
  union all
  select i + 1, list_append(any_value(ids), arg_min(vec_id, o)), list_append(any_value(us), arg_min(u, o))
  from (select s.i, s.ids, s.us, v.vec_id, v.u, row(list_max(list_transform(s.us, lambda c: round(list_dot_product(v.u, c), 9))), v.vec_id) as o
        from steps s join v on not list_contains(s.ids, v.vec_id) where s.i < {k}) z group by i)
select unnest(ids) as vec_id, unnest(range(1, len(ids) + 1))::int as pick from (select ids from steps order by i desc limit 1) l
"""


@query("maximin_select_many", MAXIMIN.format(k=100))
def maximin_select_many(t):
    return D.maximin_coreset(t.embeddings, key="vec_id", embedding="embedding", k=100)


@query("maximin_select", MAXIMIN.format(k=8))
def maximin_select(t):
    keys = D.maximin_select(t.embeddings, key="vec_id", embedding="embedding", k=8)
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("vec_id"))
    return t.embeddings.filter(F.col("vec_id").isin(keys)).select("vec_id", place.cast("int").alias("pick"))


@query("validate_plan", """
with u as (select product_id, count(*) as uses from v_gold group by 1),
l as (select g.order_id, count(*) as n, max(uses) as uses, count(distinct p.shop_id) as shops, count(*) filter (p.shop_id is null) as unknown from v_gold g join v_product p on p.product_id = g.product_id join u on u.product_id = g.product_id group by 1)
select p.order_id as sample_id, concat_ws(';', case when p.cust % 41 = 0 then 'missing_prompt' end, case when p.price_after_voucher > p.budget then 'price_exceeds_budget' end,
  case when p.product_count + (p.cust % 43 = 0)::int <> l.n then 'product_count' end, case when p.voucher_type = 'shop' and l.shops > 1 then 'several_shops' end, case when l.uses > 1 then 'product_reused' end) as failed
from v_plan p join l on l.order_id = p.order_id
""")
def validate_plan(t):
    plans = t.v_plan.select(F.col("order_id").alias("sample_id"), F.when(F.col("cust") % 41 == 0, "").otherwise("text").alias("prompt"),
                            (F.col("product_count") + (F.col("cust") % 43 == 0).cast("int")).alias("n_products"), "voucher_type", "discount_type", "face_value", "discount", "cap", "budget", "price_after_voucher")
    lines = t.v_gold.join(t.v_product, "product_id").select(F.col("order_id").alias("sample_id"), "product_id", "shop_id", "title")
    return D.validate_plan(plans, lines).select("sample_id", F.array_join("failed", ";").alias("failed"))


@query("validate_final", """
select p.order_id, concat_ws(';', case when p.cust % 11 = 0 then 'missing_suffix' end, case when p.product_count > 6 then 'no_reward' end) as failed from v_plan p
""")
def validate_final(t):
    q = t.v_plan_text.join(t.v_plan.select("order_id", "product_count"), "order_id").withColumn("n_rewards", F.when(F.col("product_count") <= 6, F.col("product_count")))
    return D.validate_final(q).select("order_id", F.array_join("failed", ";").alias("failed"))
