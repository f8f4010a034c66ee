"""J: splits, features, audits, leakage."""

from pyspark.sql import functions as F

from cartlight.operators import splits as J
from cartlight.plans.registry import query, view

# one planned query per order
view("v_plan", """
select v.order_id, o.o_custkey as cust, v.voucher_type, v.discount_type, coalesce(v.threshold, 0) as threshold, v.face_value, v.discount, v.cap, v.budget,
  t.gold_total as total_price, cast(t.gold_count as int) as product_count, cast(t.gold_count * 2 + 1 as int) as constraint_count,
  round(case when v.discount_type = 'fixed' then t.gold_total - v.face_value else greatest(t.gold_total * (1 - v.discount), t.gold_total - v.cap) end, 2) as price_after_voucher,
  case when o.o_custkey % 4 = 0 then 'im_looking' when o.o_custkey % 4 = 1 then 'looking_for' when o.o_custkey % 4 = 2 then 'show_me' else 'find' end as opener,
  case when o.o_orderstatus = 'P' then 'test' else 'train' end as split
from v_voucher v join orders o on o.o_orderkey = v.order_id join v_gold_total t on t.order_id = v.order_id
""")
view("v_plan_text", """
select order_id, concat(case when cust % 9 = 0 then 'Get me' when opener = 'im_looking' then 'I''m looking for' when opener = 'looking_for' then 'Looking for' when opener = 'show_me' then 'Show me' else 'Find' end,
  ' a basket for number ', cast(cust as string), case when cust % 13 = 0 then ', a Red Bolt and a small ring' else '' end, case when cust % 17 = 0 then ' (100005)' else '' end,
  case when cust % 11 = 0 then '' else concat('. My budget is only `', cast(cast(budget as bigint) as string), '`, but I have a voucher with the following rules') end) as query,
  case when cust % 19 = 0 then 'other-model' else 'writer' end as model, case when cust % 23 = 0 then 'retry' else 'accepted' end as status
from v_plan
""")


@query("stable_query_id", """
select conv_id, turn, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as query_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as lower_id from conversations
""")
def stable_query_id(t):
    from cartlight.functions.hashing import stable_id
    return t.conversations.select("conv_id", "turn", stable_id(F.col("text")).alias("query_id"), stable_id(F.col("text"), lower=True).alias("lower_id"))


@query("largest_remainder_quota", """
with s as (select event_type, count(*) as size, count(*) * 777 / (select count(*) from events)::double as exact from events group by 1),
r as (select *, row_number() over (order by round(exact - floor(exact), 9) desc, size desc, event_type desc) as n, 777 - (select sum(floor(exact)) from s) as rest from s)
select event_type, cast(floor(exact) + (n <= rest)::int as bigint) as quota from r
""")
def largest_remainder_quota(t):
    sizes = t.events.groupBy("event_type").agg(F.count("*").alias("size"))
    n = t.events.agg(F.count("*")).scalar()
    return J.largest_remainder(sizes, total=777, exact=F.col("size") * 777 / n, tie=[F.desc("size"), F.desc("event_type")]).select("event_type", "quota")


@query("stratified_split", """
with n as (select count(*) as n, greatest(1, round_even(count(*) * 0.1, 0)) as want from v_strata),
s as (select lang, quality, count(*) as size, count(*) * any_value(want) / any_value(n)::double as exact from v_strata, n group by 1, 2),
q as (select *, row_number() over (partition by floor(exact) < size order by round(exact - floor(exact), 9) desc, size desc, lang desc, quality desc) as r, (select want from n) - (select sum(floor(exact)) from s) as rest from s),
k as (select lang, quality, floor(exact) + (r <= rest)::int as quota from q),
d as (select doc_id, lang, quality, row_number() over (partition by lang, quality order by md5('0:' || doc_id), doc_id) as r from v_strata)
select d.doc_id, case when d.r <= k.quota then 'val' else 'train' end as split from d join k on k.lang = d.lang and k.quality = d.quality
""")
def stratified_split(t):
    return J.stratified_split(t.v_strata, key="doc_id", strata=["lang", "quality"], val_size=0.1).select("doc_id", "split")


@query("trajectory_split", """
with r as (select conv_id, row_number() over (order by md5('0:' || conv_id), conv_id) as n, count(*) over () as total from (select distinct conv_id from conversations) c)
select c.conv_id, c.turn, case when r.n <= greatest(1, round_even(r.total * 0.2, 0)) then 'val' else 'train' end as split from conversations c join r on r.conv_id = c.conv_id
""")
def trajectory_split(t):
    return J.trajectory_split(t.conversations, key="conv_id", val_size=0.2).select("conv_id", "turn", "split")


view("x_feature", """
select order_id, voucher_type, discount_type, product_count, split, round((budget - price_after_voucher) / budget, 6) as budget_slack_ratio, round(threshold / total_price, 6) as threshold_ratio,
  case when (budget - price_after_voucher) / budget <= 0.03 then 'hard' when (budget - price_after_voucher) / budget <= 0.06 then 'medium' else 'easy' end as budget_difficulty,
  case when threshold / total_price >= 0.8 then 'hard' when threshold / total_price >= 0.5 then 'medium' else 'easy' end as threshold_difficulty,
  case when constraint_count <= 5 then 'low' when constraint_count <= 9 then 'medium' else 'high' end as constraint_complexity from v_plan
""")


@query("query_features", "select order_id, budget_slack_ratio, threshold_ratio, budget_difficulty, threshold_difficulty, constraint_complexity from x_feature")
def query_features(t):
    f = J.query_features(t.v_plan)
    return f.select("order_id", F.round("budget_slack_ratio", 6).alias("budget_slack_ratio"), F.round("threshold_ratio", 6).alias("threshold_ratio"),
                    "budget_difficulty", "threshold_difficulty", "constraint_complexity")


DIMS = ["voucher_type", "discount_type", "product_count", "budget_difficulty", "constraint_complexity"]


@query("distribution", " union all ".join(f"select split, '{d}' as dimension, cast({d} as varchar) as bucket, count(*) as n from x_feature group by split, {d}" for d in DIMS))
def distribution(t):
    return J.distribution(J.query_features(t.v_plan), DIMS, by=["split"])


view("v_split_line", "select p.order_id, g.product_id, p.split from v_plan p join v_gold g on g.order_id = p.order_id")


@query("product_overlap", "select order_id, product_id from v_split_line where split = 'test' and product_id in (select product_id from v_split_line where split <> 'test')")
def product_overlap(t):
    return J.product_overlap(t.v_split_line, split="split", query="order_id")


view("x_swap_base", """
select doc_id as query_id, lang, source, cast(floor(n_chars / 400) as bigint) as size_class, md5(text) as product_id,
       case when doc_id % 3 = 0 then 'test' else 'train' end as split
from documents
""")


# one conflict a step takes its nearest unused candidate
@query("swap_repair", """
with recursive conflicts as (
  select query_id, lang, source, size_class, row_number() over (order by query_id) as i from x_swap_base
  where split = 'test' and product_id in (select product_id from x_swap_base where split <> 'test')),
candidates as (
  select query_id, lang, source, size_class, md5('0:candidate:' || query_id) as h,
    md5('0:class:' || coalesce(lang, '~') || '|' || coalesce(source, '~') || '|' || coalesce(size_class::varchar, '~')) as ch
  from x_swap_base where split <> 'test' and product_id is not null and product_id in (select product_id from x_swap_base group by 1 having count(*) = 1)
  union all select query_id, lang, source, size_class, md5('0:candidate:' || query_id),
    md5('0:class:' || coalesce(lang, '~') || '|' || coalesce(source, '~') || '|' || coalesce(size_class::varchar, '~')) from x_swap_base where split <> 'test' and product_id is null),
steps(i, used, exact) as (
  select 0::bigint, []::bigint[], []::boolean[]
  union all
  select s.i + 1, list_append(any_value(s.used), arg_min(c.query_id, row(f.lang is distinct from c.lang or f.source is distinct from c.source,
      f.lang is distinct from c.lang, abs(f.size_class - c.size_class), f.source is distinct from c.source, c.ch, c.h))),
    list_append(any_value(s.exact), not min(f.lang is distinct from c.lang or f.source is distinct from c.source))
  from steps s join conflicts f on f.i = s.i + 1 join candidates c on not list_contains(s.used, c.query_id) group by s.i),
final as (select used, exact from steps order by i desc limit 1)
select query_id as removed, used[i] as replacement, exact[i] as exact from conflicts, final
""")
def swap_repair(t):
    base = t.x_swap_base
    return J.swap_repair(base.select("query_id", "lang", "source", "size_class", "split"), base.select("query_id", "product_id", "split"), split="split",
                         stratum=["lang", "source"], distance=[("lang", "equal"), ("size_class", "number"), ("source", "equal")])


@query("assert_partition", """
select 'in_two_splits' as rule, count(*) as n from (select user_id from (select distinct user_id, event_type from events) e group by 1 having count(*) > 1) x
union all select 'missing', count(*) from customer where c_custkey not in (select user_id from events)
union all select 'foreign', count(*) from (select distinct user_id, event_type from events) e where user_id not in (select c_custkey from customer)
union all select 'leaked_products', count(distinct product_id) from v_split_line where split = 'test' and product_id in (select product_id from v_split_line where split <> 'test')
""")
def assert_partition(t):
    parts = t.events.select("user_id", "event_type").distinct()
    universe = t.customer.select(F.col("c_custkey").alias("user_id"))
    lines = t.v_split_line.withColumnRenamed("order_id", "query_id")
    return J.assert_partition(parts, universe, key="user_id", split="split", lines=lines)


def audited(t):
    q = t.v_plan_text.join(t.v_plan.select("order_id", "cust", "opener"), "order_id")
    sent = F.col("cust").cast("string")
    queries = q.select(F.col("order_id").alias("sample_id"), F.col("order_id").alias("position"), "query", sent.alias("reward"),
                       F.when(F.col("cust") % 29 == 0, "changed").otherwise(sent).alias("voucher"), "model", "status", "opener")
    p = t.v_plan
    plans = p.filter("cust % 31 <> 0").select(
        F.col("order_id").alias("sample_id"), F.col("cust").cast("string").alias("plan_reward"), F.col("cust").cast("string").alias("plan_voucher"),
        "voucher_type", "discount_type", "threshold", "face_value", "discount", "cap", "budget", F.col("total_price").alias("total"),
        (F.col("price_after_voucher") + F.when(F.col("cust") % 37 == 0, 1.0).otherwise(0.0)).alias("price_after_voucher"), F.lit(1).alias("n_shops"))
    plans = plans.withColumn("n_shops", F.when(F.col("sample_id") % 5 == 0, 2).otherwise(1))
    products = t.v_gold.select(F.col("order_id").alias("sample_id"), "product_id").join(t.v_product.select("product_id", "title"), "product_id")
    excluded = t.v_product.filter("sku_size = '1'").select("product_id")
    return J.candidate_audit(queries, plans, products, excluded, model="writer", min_title=8)


view("x_audit", """
with q as (select x.*, p.cust, p.opener, p.voucher_type, p.discount_type, p.threshold, p.face_value, p.discount, p.cap, p.budget, p.total_price,
    p.price_after_voucher + case when p.cust % 37 = 0 then 1 else 0 end as claimed, lower(trim(regexp_replace(x.query, '\\s+', ' ', 'g'))) as norm
  from v_plan_text x join v_plan p on p.order_id = x.order_id),
f as (select norm, min(order_id) as first from q group by 1),
l as (select g.order_id, max((p.sku_size = '1')::int) as banned, max(contains(q.query, g.product_id)::int) as leak, max((len(p.title) >= 8 and contains(q.norm, lower(p.title)))::int) as copied
  from v_gold g join v_product p on p.product_id = g.product_id join q on q.order_id = g.order_id group by 1)
select q.order_id, query, concat_ws(';', case when cust % 31 = 0 then 'missing_plan' end, case when q.order_id > f.first then 'duplicate_query' end, case when model <> 'writer' then 'wrong_generator_model' end,
  case when status <> 'accepted' then 'generator_status_not_accepted' end, case when cust % 31 = 0 then 'reward_changed_by_generator' end,
  case when cust % 31 = 0 or cust % 29 = 0 then 'voucher_changed_by_generator' end, case when cust % 11 = 0 then 'missing_programmatic_voucher_suffix' end,
  case when cust % 9 = 0 then 'opener_mismatch' end, case when banned = 1 then 'test_product_overlap' end, case when leak = 1 then 'product_id_leakage' end, case when copied = 1 then 'full_title_copied' end,
  case when cust % 31 <> 0 and abs(case when discount_type = 'fixed' then total_price - face_value else greatest(total_price * (1 - discount), total_price - cap) end - claimed) > 1e-6 then 'voucher_price_mismatch' end,
  case when cust % 31 <> 0 and claimed > budget then 'budget_infeasible' end, case when cust % 31 <> 0 and threshold > total_price then 'threshold_infeasible' end,
  case when cust % 31 <> 0 and voucher_type = 'shop' and q.order_id % 5 = 0 then 'shop_scope_infeasible' end) as reasons
from q join f on f.norm = q.norm join l on l.order_id = q.order_id
""")


@query("candidate_audit", "select order_id as sample_id, reasons, reasons = '' as eligible from x_audit")
def candidate_audit(t):
    return audited(t).select("sample_id", F.array_join("reasons", ";").alias("reasons"), "eligible")


@query("audit_reasons", "select reason, count(*) as n from (select unnest(string_split(reasons, ';')) as reason from x_audit) r where reason <> '' group by 1")
def audit_reasons(t):
    return J.audit_reasons(audited(t))


@query("audit_report", """
with w as (select cast(len(string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' ')) as int) as w, row_number() over (order by len(string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' '))) - 1 as i, count(*) over () as n from x_audit where reasons = '')
select (select count(*) from x_audit) as generated, (select count(*) from x_audit where reasons = '') as static_eligible, (select count(*) from x_audit where reasons <> '') as repair,
  round((select avg((reasons = '')::int) from x_audit), 6) as eligible_rate, min(w) as min_words, max(w) filter (i = round_even((n - 1) * 0.5, 0)) as p50_words, max(w) filter (i = round_even((n - 1) * 0.95, 0)) as p95_words, max(w) as max_words from w
""")
def audit_report(t):
    return J.audit_report(audited(t)).withColumn("eligible_rate", F.round("eligible_rate", 6))


# one row a step: what it adds, given the values chosen so far
COVERAGE = """
with recursive f as (select x.order_id, x.voucher_type as a, x.discount_type as b, budget_difficulty as c, p.budget - p.price_after_voucher as budget_slack, case when budget_difficulty = 'hard' then 0.5 else 0.0 end + 0.1::double * x.product_count as bonus
  from x_feature x join v_plan p on p.order_id = x.order_id),
classes as (select * from (select *, row_number() over (partition by a, b, c order by round(bonus, 9) desc, budget_slack nulls first, order_id) as r from f) x where r <= {k}),
steps(i, ids, a, b, c) as (
  select 0, []::bigint[], []::varchar[], []::varchar[], []::varchar[]
  union all
  select i + 1, list_append(any_value(ids), arg_min(order_id, o)), list_append(any_value(sa), arg_min(a, o)), list_append(any_value(sb), arg_min(b, o)), list_append(any_value(sc), arg_min(c, o))
  from (select s.i, s.ids, s.a as sa, s.b as sb, s.c as sc, f.order_id, f.a, f.b, f.c,
          row(-round(1 / (1 + len(list_filter(s.a, lambda x: x = f.a)))::double + 1 / (1 + len(list_filter(s.b, lambda x: x = f.b)))::double + 1 / (1 + len(list_filter(s.c, lambda x: x = f.c)))::double + f.bonus, 9),
              f.budget_slack is not null, f.budget_slack, f.order_id) as o
        from steps s join classes f on not list_contains(s.ids, f.order_id) where s.i < {k}) z group by i)
select unnest(ids) as order_id, unnest(range(1, len(ids) + 1))::int as pick from (select ids from steps order by i desc limit 1) l
"""


@query("coverage_select", COVERAGE.format(k=12))
def coverage_select(t):
    f = J.query_features(t.v_plan)
    bonus = F.when(F.col("budget_difficulty") == "hard", 0.5).otherwise(0.0) + 0.1 * F.col("product_count")
    out = J.coverage_select(f, key="order_id", dimensions=["voucher_type", "discount_type", "budget_difficulty"], bonus=bonus, k=12, tie=[F.col("budget_slack")])
    return out.select("order_id", "pick")


@query("coverage_select_many", COVERAGE.format(k=100))
def coverage_select_many(t):
    """More rows than one fetch holds: the bounds and lists are widened on the way."""
    f = J.query_features(t.v_plan)
    bonus = F.when(F.col("budget_difficulty") == "hard", 0.5).otherwise(0.0) + 0.1 * F.col("product_count")
    out = J.coverage_select(f, key="order_id", dimensions=["voucher_type", "discount_type", "budget_difficulty"], bonus=bonus, k=100, tie=[F.col("budget_slack")], classes=3)
    return out.select("order_id", "pick")


@query("joint_panels", """
with s as (select voucher_type, discount_type, product_count, count(*) as size, count(*) * 100 / (select count(*) from x_feature)::double as exact, floor(count(*) / 2) as cap from x_feature group by 1, 2, 3),
b as (select *, least(floor(exact), cap) as base from s),
q as (select *, base + (base < cap and row_number() over (partition by base < cap order by round(exact - base, 9) desc, size desc, voucher_type desc, discount_type desc, product_count desc) <= 100 - (select sum(base) from b))::int as quota from b),
r as (select order_id, voucher_type, discount_type, product_count, row_number() over (partition by voucher_type, discount_type, product_count order by md5('0:' || order_id), order_id) as r from x_feature)
select r.order_id, case when r.r <= q.quota then 'calibration' else 'validation' end as panel
from r join q on q.voucher_type = r.voucher_type and q.discount_type = r.discount_type and q.product_count = r.product_count where r.r <= 2 * q.quota
""")
def joint_panels(t):
    f = J.query_features(t.v_plan)
    return J.joint_panels(f, key="order_id", strata=["voucher_type", "discount_type", "product_count"], size=100).select("order_id", "panel")


MARGINS = [["voucher_type"], ["discount_type"], ["product_count"], ["budget_difficulty"], ["voucher_type", "discount_type"], ["voucher_type", "product_count"]]


def panels_by_margins(f):
    return J.margin_panels(f, key="order_id", margins=MARGINS, size=100)


@query("margin_panels")
def margin_panels(t):
    return panels_by_margins(J.query_features(t.v_plan)).select("order_id", "panel")


# the twin knows each share and demands that no panel is off by a row
@query("margin_panels_check", " union all ".join(f"""
select '{",".join(m)}' as margin, concat_ws('|', {", ".join(f"cast({d} as varchar)" for d in m)}) as value, count(*) as n,
  round(100 * count(*) / (select count(*) from x_feature)::double, 6) as share, true as near_calibration, true as near_validation from x_feature group by {", ".join(m)}""" for m in MARGINS))
def margin_panels_check(t):
    f = J.query_features(t.v_plan)
    out = J.margin_report(f, panels_by_margins(f), margins=MARGINS, size=100)
    near = [(F.abs(f"{p}_off") < 1).alias(f"near_{p}") for p in ("calibration", "validation")]
    return out.select("margin", "value", "n", F.round("share", 6).alias("share"), *near)


@query("overlong_filter", "select count(*) filter (n_chars <= 5000) as kept, count(*) filter (n_chars > 5000) as dropped, max(n_chars) as max_tokens from documents")
def overlong_filter(t):
    _, report = J.overlong_filter(t.documents, tokens_col="n_chars", limit=5000)
    return report


@query("to_rl_example", """
select order_id, voucher_type, query, concat('{"voucher":{"voucher_type":"', voucher_type, '","discount_type":"', discount_type, '"},"product_count":', product_count, '}') as ground_truth
from v_plan join v_plan_text using (order_id)
""")
def to_rl_example(t):
    df = t.v_plan.join(t.v_plan_text, "order_id")
    out = J.to_rl_example(df, source="basket_query", system_prompt="You shop.", query="query",
                          ground_truth=F.struct(F.struct("voucher_type", "discount_type").alias("voucher"), "product_count"),
                          extra=F.struct("order_id", "voucher_type"))
    return out.select("extra_info.order_id", "extra_info.voucher_type", F.col("prompt")[1]["content"].alias("query"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query("enrich_example", """
select order_id, split, f.budget_difficulty, row_number() over (partition by split order by md5('0:' || order_id), order_id) - 1 as index from x_feature f
""")
def enrich_example(t):
    df = t.v_plan.select("order_id", "split", F.struct("cust").alias("extra_info"), *[c for c in t.v_plan.columns if c not in ("order_id", "split", "cust")])
    df = J.query_features(df)
    out = J.enrich_example(df, fields={"budget_difficulty": F.col("budget_difficulty")}, split="split", key="order_id")
    return out.select("order_id", "split", "extra_info.budget_difficulty", "extra_info.index")


MIXED = "select query_id, count(*) as n, count(*) filter (lo < hi) as mixed from (select query_id, uid, min(outcome) as lo, max(outcome) as hi from v_rollout group by 1, 2) g group by 1"


def priority(t):
    from cartlight.operators.groups import group_state
    groups = group_state(t.v_rollout, by=["query_id", "uid"])
    train = t.v_rollout.select("query_id").distinct()
    return J.priority_view(train, groups, query="query_id", min_mixed=5)


@query("priority_view", f"select query_id from ({MIXED}) m where mixed >= 5")
def priority_view(t):
    return priority(t)[0]


@query("priority_report", f"select count(*) as queries, sum(n)::bigint as groups, sum(mixed)::bigint as mixed_groups, round(sum(mixed) / sum(n)::double, 6) as mixed_rate from ({MIXED}) m where mixed >= 5")
def priority_report(t):
    return priority(t)[1].withColumn("mixed_rate", F.round("mixed_rate", 6))


TOK = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' '"


@query("contamination_scan", f"""
with d as (select doc_id, {TOK} as w from documents), b as (select item_id, {TOK} as w from benchmark)
select d.doc_id, b.item_id from d join b on contains(d.w, b.w) where len(string_split(b.w, ' ')) - 2 >= 5
""")
def contamination_scan(t):
    return J.contamination_scan(t.spread("documents"), t.benchmark, doc_id="doc_id", text="text", title_id="item_id", title="text")


@query("strata_panel", """
select lang, quality, doc_id from (select *, row_number() over (partition by lang, quality order by doc_id) as n from v_strata) x where n = 1
""")
def strata_panel(t):
    return J.strata_panel(t.v_strata, strata=["lang", "quality"], order="doc_id").select("lang", "quality", "doc_id")


@query("deterministic_sample", "select event_id from events order by md5('7:' || event_id), event_id limit 100")
def deterministic_sample(t):
    return J.deterministic_sample(t.events.select("event_id"), key="event_id", k=100, seed="7")


@query("exclusion_list", "select distinct product_id from v_split_line where split = 'test'")
def exclusion_list(t):
    return J.exclusion_list(t.v_split_line.filter("split = 'test'"))


@query("exclusion_check", """
select 'excluded_used' as rule, count(*) as n from v_split_line where split = 'train' and product_id in (select product_id from v_split_line where split = 'test')
union all select 'reused', count(*) from (select product_id from v_split_line where split = 'train' group by 1 having count(*) > 1) x
""")
def exclusion_check(t):
    return J.exclusion_check(t.v_split_line.filter("split = 'train'"), J.exclusion_list(t.v_split_line.filter("split = 'test'")))


@query("hard_budget_subset", """
select order_id, row_number() over (order by order_id) as hard_index from v_plan where budget <= price_after_voucher * 1.02::double + 1e-9 qualify hard_index >= 10
""")
def hard_budget_subset(t):
    return J.hard_budget_subset(t.v_plan, order="order_id", start=10).select("order_id", "hard_index")
