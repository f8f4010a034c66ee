"""Shared views over the driver's tables, in SQL both engines accept."""

from cartlight.plans.registry import view

view("v_sold", """
select l_partkey, min(l_suppkey) as shop, cast(sum(l_quantity) as bigint) as sold
from lineitem group by l_partkey
""")

# one row per product; ids are strings of six digits
view("v_product", """
select cast(100000 + p.p_partkey as string) as product_id,
       cast(s.shop as string) as shop_id,
       p.p_name as title,
       p.p_brand as brand,
       concat(p.p_type, ' > ', p.p_brand) as category,
       p.p_retailprice as price,
       coalesce(s.sold, 0) as sold_count,
       lower(p.p_brand) as attr_brand,
       lower(p.p_type) as attr_type,
       split_part(p.p_name, ' ', 1) as attr_color,
       split_part(p.p_name, ' ', 2) as attr_kind,
       cast(p.p_size as string) as sku_size,
       concat_ws(',', case when p.p_size <= 15 then 'official' end,
                      case when p.p_size between 10 and 35 then 'freeShipping' end,
                      case when p.p_size >= 30 then 'COD' end) as services
from part p left join v_sold s on s.l_partkey = p.p_partkey
""")

# raw feed row with packed fields
view("v_feed", """
select cast(100000 + p_partkey as string) as product_id,
       cast(p_size as string) as shop_id,
       case when p_size = 1 then 'No Brand' when p_size = 2 then 'N/A' else p_brand end as brand_name,
       replace(concat(p_type, '-', p_brand), 'PROMO', 'HOME') as category_hierarchy,
       concat(' ', p_name, ' &amp; ', p_type, ' &lt;', p_brand, '&gt; ') as title,
       cast(p_retailprice as string) as price,
       case when p_size = 3 then 'many' else cast(p_size * 7 as string) end as sold_cnt,
       concat('s1', chr(1), 'Size', chr(1), cast(p_size as string), chr(2),
              's1', chr(1), 'Color', chr(1), split_part(p_name, ' ', 1), chr(2),
              's2', chr(1), 'Size', chr(1), cast(p_size + 1 as string), chr(2),
              's2', chr(1), 'Color', chr(1), case when p_size < 5 then 'Other' else 'Mixed' end, chr(2),
              's3', chr(1), 'Color', chr(1), 'Unknown', chr(2), 'broken', chr(2),
              's2', chr(1), 'Size', chr(1), cast(p_size + 2 as string)) as sku,
       concat('Brand', chr(1), p_brand, chr(2), 'Kind', chr(1), split_part(p_name, ' ', 2), chr(2),
              'Kind', chr(1), split_part(p_name, ' ', 2), chr(2), 'Kind', chr(1), p_type, chr(2),
              'Line', chr(1), 'NA') as spu,
       concat('Kind', chr(2), p_type, chr(1), 'New', chr(1), 'Solid', chr(2), 'Y', chr(2), 'Y', chr(3),
              'Color', chr(2), split_part(p_name, ' ', 1), chr(2), 'Y', chr(2),
              case when p_size < 25 then 'Y' else 'N' end, chr(3), 'Bad', chr(2), 'x') as cpv
from part
""")

view("v_basket_line", """
select distinct l_orderkey as order_id, cast(100000 + l_partkey as string) as product_id from lineitem
""")

# wanted basket: all distinct parts of the order, numbered
view("v_gold", """
select order_id, product_id,
       cast(row_number() over (partition by order_id order by product_id) as int) as slot
from v_basket_line
""")

# recommended basket: the parts that were not returned
view("v_recommended", """
select order_id, product_id,
       cast(row_number() over (partition by order_id order by product_id) as int) as slot
from (select l_orderkey as order_id, cast(100000 + l_partkey as string) as product_id
      from lineitem group by l_orderkey, l_partkey having sum(case when l_returnflag = 'R' then 1 else 0 end) = 0) r
""")

view("v_gold_total", """
select g.order_id, round(sum(p.price), 2) as gold_total, count(*) as gold_count
from v_gold g join v_product p on p.product_id = g.product_id group by g.order_id
""")

# one voucher per order
view("v_voucher", """
select o.o_orderkey as order_id,
       case when o.o_orderpriority in ('1-URGENT', '2-HIGH') then 'shop' else 'platform' end as voucher_type,
       case when o.o_orderstatus = 'F' then 'fixed' else 'percentage' end as discount_type,
       case when o.o_orderpriority = '5-LOW' and o.o_orderstatus = 'P' then cast(null as double)
            else floor(t.gold_total * 0.5) end as threshold,
       case when o.o_orderstatus = 'F' then floor(t.gold_total * 0.125) end as face_value,
       case when o.o_orderstatus <> 'F' then cast(0.2 as double) end as discount,
       case when o.o_orderstatus <> 'F' then floor(t.gold_total * 0.25) end as cap,
       case when o.o_orderpriority = '3-MEDIUM' then floor(t.gold_total * 0.75)
            else floor(t.gold_total * 0.875) end as budget
from orders o join v_gold_total t on t.order_id = o.o_orderkey
""")

view("v_event", """
select event_id, ts, user_id, event_type, value,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
       cast(floor(event_id / 8) as bigint) as traj_id,
       cast(event_id % 8 as int) as step
from events
""")

# sampled rollouts: groups of eight, six runs
view("v_rollout", """
select traj_id as uid, step as sample, event_id,
       concat('t0', cast(traj_id % 3 as string), '_top_p09_seed', cast(cast(floor(traj_id / 3) as bigint) % 2 as string), '_g8') as run_id,
       cast(traj_id % 3 as int) as temperature_code,
       cast(cast(floor(traj_id / 3) as bigint) % 2 as int) as seed,
       cast(floor(traj_id / 6) as bigint) as query_id,
       case when event_type = 'purchase' then 1 else 0 end as outcome,
       case when event_type in ('purchase', 'signup') then 1 else 0 end as paper,
       value / cast(487 as double) as score,
       cast(k * 97 + 40 as int) as response_tokens,
       case when k >= 98 then 1 else 0 end as truncated,
       case when event_type = 'error' and k < 10 then 1 else 0 end as server_error,
       case when event_type = 'error' and k >= 90 then 1 else 0 end as json_failure,
       cast(1 + k % 9 as int) as turns,
       user_id, ts, k, event_type
from v_event
""")

# tool calls: eight turns per trajectory, the last turn may close it
view("v_calls", """
select traj_id, step, pos, name, user_id, ts, value, k,
       case when name = 'find_product' then concat(case when k < 50 then 'Red ring ' else 'blue bolt' end, cast(cast(floor(k / 20) as int) as string)) end as q,
       case when name = 'find_product' then cast(1 + k % 5 as string) end as page,
       case when name = 'find_product' and k >= 60 then cast(cast(floor(k / 10) as int) as string) end as shop_param,
       case when name in ('view_product_information', 'budget_check', 'recommend_product')
            then concat(cast(100000 + cast(floor(k / 20) as int) as string), ',', cast(100001 + cast(floor(k / 20) as int) as string)) end as product_ids,
       case when name = 'terminate' then case when k < 70 then 'success' else 'failure' end end as status,
       case when name = 'find_product' then k % 4 end as n_results
from (
  select traj_id, step, 0 as pos, user_id, ts, value, k,
         case when step = 0 then 'find_product'
              when step < 7 and event_type in ('click', 'error') then 'find_product'
              when step < 7 and event_type in ('view', 'purchase', 'signup') then 'view_product_information'
              when event_type in ('purchase', 'view', 'click') then 'recommend_product'
              when event_type = 'signup' then 'terminate'
              else 'shell' end as name
  from v_event
  union all
  select traj_id, step, 1 as pos, user_id, ts, value, k,
         case when step < 7 then 'budget_check' else 'terminate' end as name
  from v_event
  where (step between 1 and 6 and event_type = 'signup') or (step = 7 and event_type in ('purchase', 'view'))
) c
""")

# products shown by each search: n_results consecutive ids from the search's own start
view("v_results", """
select c.traj_id, c.step, c.pos, r.i as rank_in_result,
       cast(100000 + cast(floor(c.k / 20) as int) + r.i as string) as product_id
from v_calls c join (select 0 as i union all select 1 as i union all select 2 as i) r on r.i < c.n_results
where c.name = 'find_product'
""")

# one message per turn, as tagged text
view("v_message", """
select traj_id, step, max(user_id) as user_id, max(k) as k,
       concat('<think>turn ', cast(step as string), ' of ', cast(traj_id as string), '</think>',
              chr(10), '<tool_call>[', max(case when pos = 0 then call end),
              coalesce(max(case when pos = 1 then concat(', ', call) end), ''), ']',
              case when max(k) >= 97 then '' else '</tool_call>' end,
              case when max(k) < 3 then '<response>done</response>' else '' end) as content
from (
  select traj_id, step, pos, user_id, k,
         concat('{"name": "', name, '", "parameters": {',
                case when name = 'find_product' then concat('"q": "', q, '", "page": "', page, '"')
                     when name = 'terminate' then concat('"status": "', status, '"')
                     when name = 'shell' then '"cmd": "ls"'
                     else concat('"product_ids": "', product_ids, '"') end, '}}') as call
  from v_calls) c
group by traj_id, step
""")

view("v_strata", """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from documents d join labels l on l.doc_id = d.doc_id
""")
