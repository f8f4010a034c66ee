"""H: history compression."""

from pyspark.sql import functions as F

from cartlight.operators import folding as H
from cartlight.plans.registry import query, view

view("v_candidate", """
select r.traj_id, r.step as source, r.rank_in_result as hit, r.product_id, p.shop_id, p.services, r.step * 10 + r.rank_in_result as place
from v_results r join v_product p on p.product_id = r.product_id
""")
view("x_first", """
select traj_id, product_id, min(step * 100 + pos * 10 + rank_in_result) as o from v_results group by 1, 2
""")
view("x_view_first", """
select traj_id, product_id, min(step * 100 + pos * 10 + i) as o from (
  select traj_id, step, pos, generate_subscripts(string_split(product_ids, ','), 1) as i, unnest(string_split(product_ids, ',')) as product_id
  from v_calls where name = 'view_product_information') v group by 1, 2
""")
view("v_text_step", """
select conv_id, turn, text, case when turn < 2 then text else concat(role, ' turn ', cast(turn as string)) end as folded from conversations
""")


@query("fold_state", """
with s as (select distinct traj_id, step from v_calls)
select s.traj_id, s.step, (select count(*) from v_calls c where c.traj_id = s.traj_id and c.step < s.step and c.name = 'find_product') as n_searches,
  coalesce((select string_agg(product_id, ',' order by o) from x_first f where f.traj_id = s.traj_id and f.o < s.step * 100), '') as candidates,
  coalesce((select string_agg(product_id, ',' order by o) from x_view_first f where f.traj_id = s.traj_id and f.o < s.step * 100), '') as viewed,
  coalesce((select max_by(product_ids, step * 10 + pos) from v_calls c where c.traj_id = s.traj_id and c.step < s.step and c.name = 'recommend_product'),
           (select max_by(product_ids, step * 10 + pos) from v_calls c where c.traj_id = s.traj_id and c.step < s.step and c.name = 'budget_check'), '') as selected_ids
from s
""")
def fold_state(t):
    out = H.fold_state(t.v_results, t.v_calls)
    return out.select("traj_id", "step", "n_searches", F.array_join("candidates", ",").alias("candidates"),
                      F.array_join("viewed", ",").alias("viewed"), "selected_ids")


@query("cap_recent", """
with s as (select distinct traj_id, step from v_calls),
l as (select s.traj_id, s.step, f.product_id, f.o, row_number() over (partition by s.traj_id, s.step order by f.o desc) as newest from s join x_first f on f.traj_id = s.traj_id and f.o < s.step * 100)
select s.traj_id, s.step, coalesce(string_agg(l.product_id, ',' order by l.o) filter (newest <= 3), '') as candidates
from s left join l on l.traj_id = s.traj_id and l.step = s.step group by 1, 2
""")
def cap_recent(t):
    out = H.fold_state(t.v_results, t.v_calls, max_items=3)
    return out.select("traj_id", "step", F.array_join("candidates", ",").alias("candidates"))


@query("cap_by_priority", """
with p as (select traj_id, split_part(product_ids, ',', 1) as product_id from (select traj_id, max_by(product_ids, step * 10 + pos) as product_ids from v_calls where name = 'recommend_product' group by 1) r),
r as (select f.traj_id, f.product_id, f.o, p.product_id is not null as pri, row_number() over (partition by f.traj_id order by (p.product_id is null), f.o desc) as n
  from x_first f left join p on p.traj_id = f.traj_id and p.product_id = f.product_id)
select traj_id, product_id, row_number() over (partition by traj_id order by (not pri), o) as place from r where n <= 3
""")
def cap_by_priority(t):
    items = t.v_results.groupBy("traj_id", "product_id").agg(
        F.min(F.col("step") * 100 + F.col("pos") * 10 + F.col("rank_in_result")).alias("o"))
    last = t.v_calls.filter("name = 'recommend_product'").groupBy("traj_id").agg(
        F.max(F.struct("step", "pos", "product_ids"))["product_ids"].alias("ids"))
    priority = last.select("traj_id", F.split_part("ids", F.lit(","), F.lit(1)).alias("product_id"), F.lit(1).alias("priority"))
    out = H.cap_by_priority(items, priority, key=["traj_id"], item="product_id", order="o", k=3)
    return out.select("traj_id", "product_id", "place")


@query("focused_candidates", """
with h as (select order_id, product_id, slot as rank, shop_id from (select g.order_id, g.product_id, g.slot, coalesce(p.shop_id, '-') as shop_id from v_gold g join v_product p on p.product_id = g.product_id) x),
f as (select distinct order_id, shop_id from h where rank <= 2),
m as (select h.*, row_number() over (partition by h.order_id order by rank) as x from h join f on f.order_id = h.order_id and f.shop_id = h.shop_id where rank > 3)
select order_id, product_id, cast(rank as int) as place from h where rank <= 3 union all select order_id, product_id, cast(3 + x as int) from m where x <= 3
""")
def focused_candidates(t):
    hits = t.v_gold.join(t.v_product.select("product_id", F.coalesce("shop_id", F.lit("-")).alias("shop_id")), "product_id").withColumnRenamed("slot", "rank")
    focus = hits.filter("rank <= 2").select("order_id", "shop_id")
    return H.focused_candidates(hits, focus, key=["order_id"], n=3).select("order_id", "product_id", F.col("place").cast("int").alias("place"))


@query("shop_groups", """
with k as (select * from v_candidate where coalesce(shop_id, '') <> ''),
b as (select *, row_number() over (partition by traj_id order by n desc, first) as group_rank from (select traj_id, shop_id, count(*) as n, min(place) as first from k group by 1, 2) x),
l as (select *, row_number() over (partition by traj_id, shop_id order by place) as r from k)
select b.traj_id, b.shop_id, b.n, b.group_rank,
  (select string_agg(product_id, ',' order by place) from l where l.traj_id = b.traj_id and l.shop_id = b.shop_id and r <= 8) as product_ids,
  (select string_agg(distinct s, ',' order by s) from (select unnest(string_split(services, ',')) as s from k where k.traj_id = b.traj_id and k.shop_id = b.shop_id) u where s <> '') as services
from b where group_rank <= 6
""")
def shop_groups(t):
    return H.shop_groups(t.v_candidate)


@query("balanced_candidates", """
select traj_id, source, product_id, n as place from (
 select traj_id, source, product_id, row_number() over (partition by traj_id order by hit, source) as n from v_candidate) x where n <= 4
""")
def balanced_candidates(t):
    return H.balanced_candidates(t.v_candidate.drop("place"), by=["traj_id"], source="source", order="hit", k=4).select(
        "traj_id", "source", "product_id", "place")


WORDS = "case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')) end"
SAVE = f"""
select conv_id, turn, raw as raw_tokens, folded as folded_tokens, case when raw > 0 then 1 - folded / raw::double else 0 end as saving
from (select conv_id, turn, cast(sum({WORDS.format(c='text')}) over (partition by conv_id order by turn) as bigint) as raw, cast({WORDS.format(c='folded')} as int) as folded from v_text_step) x
"""


@query("folding_savings", f"select conv_id, turn, raw_tokens, folded_tokens, round(saving, 6) as saving from ({SAVE}) s")
def folding_savings(t):
    out = H.folding_savings(t.v_text_step, by="conv_id", order="turn", raw_text="text", folded_text="folded")
    return out.withColumn("saving", F.round("saving", 6))


@query("savings_summary", f"""
select count(*) as n_steps, round(avg(raw_tokens), 6) as mean_raw, round(avg(folded_tokens), 6) as mean_folded, max(raw_tokens) as max_raw, max(folded_tokens) as max_folded,
  round(avg(saving), 6) as mean_saving, round(min(saving), 6) as min_saving from ({SAVE}) s
""")
def savings_summary(t):
    out = H.savings_summary(H.folding_savings(t.v_text_step, by="conv_id", order="turn", raw_text="text", folded_text="folded"))
    return out.select("n_steps", "max_raw", "max_folded", *[F.round(c, 6).alias(c) for c in ["mean_raw", "mean_folded", "mean_saving", "min_saving"]])


@query("view_shortlist", """
with a as (select traj_id, unnest(string_split(product_ids, ',')) as product_id from (select traj_id, min_by(product_ids, step * 10 + pos) as product_ids from v_calls where name = 'view_product_information' group by 1) x),
n as (select traj_id, count(distinct product_id) as n_asked from a group by 1),
f as (select *, row_number() over (partition by traj_id order by seen_at) as turn from (select traj_id, product_id, min(hit * 100 + source) as seen_at from v_candidate where hit <= 1 group by 1, 2) y),
r as (select f.traj_id, f.product_id from f left join n on n.traj_id = f.traj_id where f.turn <= greatest(0, 4 - coalesce(n_asked, 0)))
select coalesce(r.traj_id, a.traj_id) as traj_id, coalesce(r.product_id, a.product_id) as product_id, a.product_id is not null as asked
from r full outer join a on a.traj_id = r.traj_id and a.product_id = r.product_id
""")
def view_shortlist(t):
    first = t.v_calls.filter("name = 'view_product_information'").groupBy("traj_id").agg(F.min(F.struct("step", "pos", "product_ids")).alias("c"))
    originals = first.select("traj_id", F.posexplode(F.split("c.product_ids", ",")).alias("place", "product_id"))
    hits = t.v_candidate.withColumn("rank", F.col("hit"))
    return H.view_shortlist(hits, originals, by="traj_id", per_search=1, max_ids=4)


@query("folding_report", f"""
select *, round((full_chars - folded_chars) / full_chars::double * 100, 2) as full_chars_savings_pct, case when full_tokens > 0 then round((full_tokens - folded_tokens) / full_tokens::double * 100, 2) else 0 end as full_tokens_savings_pct
from (select role, cast(sum(len(c.text)) as bigint) as full_chars, cast(sum({WORDS.format(c='c.text')}) as bigint) as full_tokens, cast(sum(len(folded)) as bigint) as folded_chars,
  cast(sum({WORDS.format(c='folded')}) as bigint) as folded_tokens, bool_and(len(folded) <= len(c.text) + 20) as all_ok, count(*) as n_steps
  from v_text_step s join conversations c on c.conv_id = s.conv_id and c.turn = s.turn group by 1) x
""")
def folding_report(t):
    rows = t.v_text_step.join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"]).withColumn(
        "ok", F.length("folded") <= F.length("text") + 20)
    return H.folding_report(rows, by=["role"], texts={"full": "text", "folded": "folded"}, check="ok")
