"""G: trajectory parsing, validity and state."""

from pyspark.sql import functions as F

from cartlight.operators import trajectory as G
from cartlight.operators import voucher as V
from cartlight.operators.search import search_signature
from cartlight.plans.registry import query, view

view("v_call_obs", """
select traj_id, step, pos, name, q, page, product_ids, status, n_results, k,
  case when name in ('find_product', 'view_product_information') then case when k = 4 then cast(null as string) else 'list' end
       when name = 'budget_check' then case when k % 10 = 9 then 'error' else 'dict' end
       when name = 'shell' then 'error' else 'text' end as obs_kind,
  case when name = 'budget_check' then case when k % 4 = 0 then 0 else 1 end end as within_budget,
  case when name = 'budget_check' then case when k % 6 = 0 then 0 else 1 end end as budget_parsed,
  case when k % 9 = 0 then 1 else 0 end as issue
from v_calls
""")
# products seen in observations: search results and viewed products
view("v_seen", """
select r.traj_id, r.step, r.pos, 'find_product' as name, r.rank_in_result, r.product_id, p.price, p.shop_id, cast(null as string) as detail
from v_results r join v_product p on p.product_id = r.product_id
union all
select c.traj_id, c.step, c.pos, c.name, i.i as rank_in_result, p.product_id, cast(null as double) as price, cast(null as string) as shop_id, p.title as detail
from v_calls c join (select 1 as i union all select 2 as i) i on 1 = 1
join v_product p on p.product_id = split_part(c.product_ids, ',', i.i)
where c.name = 'view_product_information'
""")
view("v_used", """
select c.traj_id, c.step, split_part(c.product_ids, ',', i.i) as product_id
from v_calls c join (select 1 as i union all select 2 as i) i on 1 = 1
where c.name in ('view_product_information', 'recommend_product')
""")
# long texts with repeated sentences
view("v_output", """
select conv_id, turn, role,
  case when turn % 3 = 0 then concat(text, chr(10), repeat(concat(substr(text, 1, 60), ' and so on it goes.', chr(10)), 3 + cast(conv_id % 3 as int))) else text end as output,
  case when conv_id % 7 = 0 then 'token_limit' when conv_id % 7 = 1 then 'JSON decode' when conv_id % 7 = 2 then 'connection error' else 'stop' end as finish_reason
from conversations
""")

BODY = "regexp_extract(content, '<tool_call>(.+?)</tool_call>', 1, 's')"


@query("parse_message", f"""
select traj_id, step, case when k >= 97 then 'exactly_one_tool_call_block_required' else '' end as format_error,
  regexp_extract(content, '<think>(.+?)</think>', 1, 's') as think,
  case when k >= 97 then '' else array_to_string(list_transform(cast(json_extract({BODY}, '$[*].name') as varchar[]), lambda x: trim(x, '"')), ',') end as names,
  case when k >= 97 and k < 3 then 'done' else '' end as response
from v_message
""")
def parse_message(t):
    out = G.parse_message(t.v_message)
    return out.select("traj_id", "step", F.coalesce("format_error", F.lit("")).alias("format_error"), "think",
                      F.coalesce(F.array_join(F.transform("calls", lambda c: c["name"]), ","), F.lit("")).alias("names"),
                      F.coalesce("response", F.lit("")).alias("response"))


@query("salvage_json")
def salvage_json(t):
    cut = F.regexp_replace("content", r"(?s)^.*?<tool_call>|\]</tool_call>.*$", "")
    return t.v_message.select("traj_id", "step", G.salvage_json(cut).alias("calls"))


@query("render_message", """
select conv_id, turn, md5(concat('<user>', replace(replace(concat('<think>', text), '<think>', '[think]'), '</think>', '[/think]'), '</user>',
  case when role = 'assistant' then concat(chr(10), '<tool_call>[]</tool_call>') else '' end)) as digest from conversations
""")
def render_message(t):
    parts = {"user": F.concat(F.lit("<think>"), F.col("text")), "tool_call": F.when(F.col("role") == "assistant", "[]"), "response": F.lit("")}
    return t.conversations.select("conv_id", "turn", F.md5(G.render_message(parts)).alias("digest"))


@query("tool_call_id", """
select traj_id, step, pos, substr(replace(replace(replace(to_base64(unhex(md5(concat(name, chr(10), '{''q'': ''', q, ''', ''page'': ''', page, '''}')))), '=', ''), '+', '-'), '/', '_'), 1, 8) as call_id
from v_calls where name = 'find_product'
""")
def tool_call_id(t):
    params = F.create_map(F.lit("q"), F.col("q"), F.lit("page"), F.col("page"))
    return t.v_calls.filter("name = 'find_product'").select(
        "traj_id", "step", "pos", G.tool_call_id(F.col("name"), G.parameter_text(params)).alias("call_id"))


@query("format_valid", """
select traj_id, step, cast(k < 97 and len(regexp_extract_all(content, '<response>')) <= 1 as int) as ok from v_message
""")
def format_valid(t):
    return t.v_message.select("traj_id", "step", G.format_valid(F.col("content")).alias("ok"))


@query("format_valid_text", """
select conv_id, turn, cast(conv_id % 5 in (0, 4) as int) as ok from conversations
""")
def format_valid_text(t):
    c = F.col("conv_id") % 5
    text = G.sanitize(F.col("text"))
    body = (F.when(c == 0, F.concat(F.lit("<think>"), text, F.lit('</think><tool_call>[{"name": "a", "parameters": {}}]</tool_call>')))
            .when(c == 1, F.concat(F.lit("<think>"), text, F.lit('<tool_call>[]</tool_call></think>')))
            .when(c == 2, F.concat(F.lit('<tool_call>[{"name": "a", "parameters": {}}]</tool_call>'), text))
            .when(c == 3, F.concat(F.lit("<think>"), text, F.lit('</think><tool_call>[{"name": 5, "parameters": {}}]</tool_call>')))
            .otherwise(F.concat(F.lit("<think>"), text, F.lit('</think><response>fine</response>'))))
    return t.conversations.select("conv_id", "turn", G.format_valid(body).alias("ok"))


@query("tool_valid", """
select traj_id, round(avg(case when name = 'shell' or obs_kind is null or obs_kind = 'error' then 0 else 1 end), 6) as tool_valid, count(*) as n_calls from v_call_obs group by 1
""")
def tool_valid(t):
    out = G.tool_valid(t.v_call_obs)
    return out.select("traj_id", F.round("tool_valid", 6).alias("tool_valid"), "n_calls")


# the state machine as a recursive walk over the turns
@query("workflow_valid", """
with recursive turn as (select traj_id, step, row_number() over (partition by traj_id order by step) as n, list_distinct(list(name)) as names from v_calls group by 1, 2),
walk(traj_id, n, phase, saw, pending, ok) as (
  select distinct traj_id, cast(0 as bigint), 'SEARCH', false, false, true from turn
  union all
  select t.traj_id, t.n,
    case when t.names = ['find_product'] then case when w.phase = 'DECISION' then 'SELECT' else 'SEARCH' end
         when list_has_any(t.names, ['budget_check']) then 'DECISION' when list_has_any(t.names, ['view_product_information']) then 'SELECT'
         when list_has_any(t.names, ['terminate']) then 'DONE' else w.phase end,
    w.saw or list_contains(t.names, 'find_product'),
    case when t.names = ['find_product'] then false when list_contains(t.names, 'budget_check') then false
         when list_contains(t.names, 'view_product_information') then true else w.pending end,
    w.ok and not list_contains(t.names, 'shell') and w.phase <> 'DONE'
      and not (list_contains(t.names, 'find_product') and len(t.names) > 1)
      and list_contains(t.names, 'terminate') = list_contains(t.names, 'recommend_product')
      and not (list_contains(t.names, 'recommend_product') and list_has_any(t.names, ['view_product_information', 'budget_check']))
      and case when t.names = ['find_product'] then true
               when list_has_any(t.names, ['view_product_information', 'budget_check']) then w.saw and w.phase in ('SEARCH', 'SELECT')
                 and (not list_contains(t.names, 'budget_check') or w.pending or list_contains(t.names, 'view_product_information'))
               else w.phase = 'DECISION' end
  from walk w join turn t on t.traj_id = w.traj_id and t.n = w.n + 1)
select traj_id, cast(bool_and(ok) as int) as workflow_valid from walk group by 1
""")
def workflow_valid(t):
    return G.workflow_valid(t.v_calls)


@query("final_recommendation", """
select traj_id, coalesce(max_by(product_ids, step * 10 + pos) filter (name = 'recommend_product'), '') as recommended_ids,
  coalesce(bool_or(name = 'terminate' and status = 'success'), false) as terminate_success from v_calls group by 1
""")
def final_recommendation(t):
    return G.final_recommendation(t.v_calls)


@query("parse_product_ids", """
select traj_id, step, pos, array_to_string(case when step % 2 = 0 then list_filter(list_transform(string_split(concat(' ', product_ids, ', ,7'), ','), lambda x: trim(x)), lambda x: x <> '')
  else regexp_extract_all(concat('ids ', replace(product_ids, ',', ' and '), ' or 77'), '[0-9]{5,}') end, '|') as ids
from v_calls where product_ids is not null
""")
def parse_product_ids(t):
    text = F.when(F.col("step") % 2 == 0, F.concat(F.lit(" "), "product_ids", F.lit(", ,7"))).otherwise(
        F.concat(F.lit("ids "), F.replace("product_ids", F.lit(","), F.lit(" and ")), F.lit(" or 77")))
    return t.v_calls.filter("product_ids is not null").select(
        "traj_id", "step", "pos", F.array_join(G.parse_product_ids(text), "|").alias("ids"))


@query("pair_calls_observations", """
select traj_id, step, pos, obs_kind is null as missing_observation, coalesce(obs_kind, '-') as obs_kind from v_call_obs
""")
def pair_calls_observations(t):
    cid = G.tool_call_id(F.col("name"), F.concat_ws(":", "step", "pos"))
    calls = t.v_calls.withColumn("tool_call_id", cid)
    obs = t.v_call_obs.filter("obs_kind is not null").select("traj_id", "step", cid.alias("tool_call_id"), "obs_kind")
    return G.pair_calls_observations(calls, obs).select(
        "traj_id", "step", "pos", "missing_observation", F.coalesce("obs_kind", F.lit("-")).alias("obs_kind"))


@query("product_evidence", """
select traj_id, product_id, max((name = 'find_product')::int) as searched, max((name <> 'find_product')::int) as viewed,
  coalesce(max_by(price, step * 10 + pos) filter (price is not null), -1) as price, coalesce(max_by(detail, step * 10 + pos) filter (detail is not null), '-') as detail
from v_seen group by 1, 2
""")
def product_evidence(t):
    out = G.product_evidence(t.v_seen, ["price", "detail"])
    return out.select("traj_id", "product_id", "searched", "viewed", F.coalesce("price", F.lit(-1.0)).alias("price"),
                      F.coalesce("detail", F.lit("-")).alias("detail"))


@query("trajectory_state", """
select traj_id, coalesce(b, r, '') as selected_ids, coalesce(r, '') as recommended_ids, attempted as budget_attempted, ok as terminate_success, n as n_terminations from (
select traj_id, max_by(product_ids, step * 10 + pos) filter (name = 'recommend_product') as r, max_by(product_ids, step * 10 + pos) filter (name = 'budget_check') as b,
  max((name = 'budget_check')::int) as attempted, max((name = 'terminate' and status = 'success')::int) as ok, count(*) filter (name = 'terminate') as n from v_calls group by 1) x
""")
def trajectory_state(t):
    return G.trajectory_state(t.v_calls)


RUN = """
with recursive s as (select conv_id, turn, generate_subscripts(p, 1) as n, lower(trim(regexp_replace(unnest(p), '\\s+', ' ', 'g'))) as s
  from (select conv_id, turn, string_split_regex(regexp_replace(output, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as p from v_output) x),
r(conv_id, turn, n, prev, run) as (
  select distinct conv_id, turn, cast(0 as bigint), cast('' as varchar), 0 from s
  union all
  select s.conv_id, s.turn, s.n, case when len(s.s) >= 30 then s.s else '' end, case when len(s.s) < 30 then 0 when s.s = r.prev then r.run + 1 else 1 end
  from r join s on s.conv_id = r.conv_id and s.turn = r.turn and s.n = r.n + 1),
m as (select conv_id, turn, max(run) as longest from r group by 1, 2)
"""


@query("runaway_text", RUN + """
select o.conv_id, o.turn, len(o.output) >= 160 and m.longest >= 4 as runaway from v_output o join m on m.conv_id = o.conv_id and m.turn = o.turn
""")
def runaway_text(t):
    return t.v_output.select("conv_id", "turn", G.runaway_text(F.col("output"), tail=None).alias("runaway"))


@query("failure_flags", RUN + """
select finish_reason, count(*) as n, count(*) filter (finish_reason = 'connection error' or contains(lower(output), 'connection error')) as server,
  count(*) filter (finish_reason = 'JSON decode') as json, count(*) filter (finish_reason = 'token_limit') as truncation,
  count(*) filter (len(o.output) >= 160 and m.longest >= 4) as runaway
from v_output o join m on m.conv_id = o.conv_id and m.turn = o.turn group by 1
""")
def failure_flags(t):
    out = G.failure_flags(t.v_output, text_columns=["finish_reason"], output="output", tail=None)
    return out.groupBy("finish_reason").agg(
        F.count("*").alias("n"), F.count_if("is_server_error").alias("server"), F.count_if("is_json_decode").alias("json"),
        F.count_if("is_truncation").alias("truncation"), F.count_if("is_runaway").alias("runaway"))


@query("step_mask_reasons", """
with r as (
 select traj_id, step, 'missing_observation::' || name as reason from v_call_obs where obs_kind is null
 union select traj_id, step, 'tool_error::' || name from v_call_obs where obs_kind = 'error'
 union select traj_id, step, 'empty_find_product_result' from v_call_obs where name = 'find_product' and n_results = 0
 union select traj_id, step, 'budget_check_not_within_budget' from v_call_obs where name = 'budget_check' and within_budget = 0
 union select a.traj_id, a.step, 'selection_led_to_failure_feedback' from v_call_obs a join v_call_obs b on b.traj_id = a.traj_id and b.step = a.step + 1
   where a.name in ('view_product_information', 'budget_check') and b.issue = 1)
select s.traj_id, s.step, coalesce(string_agg(r.reason, ';' order by r.reason), '') as reasons
from (select distinct traj_id, step from v_call_obs) s left join r on r.traj_id = s.traj_id and r.step = s.step group by 1, 2
""")
def step_mask_reasons(t):
    out = G.step_mask_reasons(t.v_call_obs)
    return out.select("traj_id", "step", F.array_join("reasons", ";").alias("reasons"))


@query("trajectory_quality_issue", """
with b as (select c.traj_id, c.step * 10 + c.pos as o, c.name, c.budget_parsed,
   (select max_by(p.within_budget, p.step * 10 + p.pos) from v_call_obs p where p.traj_id = c.traj_id and p.name = 'budget_check' and p.step * 10 + p.pos < c.step * 10 + c.pos) as last_within from v_call_obs c),
i as (select traj_id, o, case when name = 'budget_check' and budget_parsed = 0 then 'budget_unparseable_or_failed'
   when name = 'recommend_product' and last_within is null then 'recommend_without_budget_calculation'
   when name = 'recommend_product' and last_within = 0 then 'recommend_after_not_within_budget' end as issue, name from b)
select traj_id, coalesce(min_by(issue, o) filter (issue is not null), case when count(*) filter (name = 'recommend_product') = 0 then 'missing_recommend_product' else 'clean' end) as issue from i group by 1
""")
def trajectory_quality_issue(t):
    return G.trajectory_quality_issue(t.v_call_obs).select("traj_id", F.coalesce("issue", F.lit("clean")).alias("issue"))


@query("state_invariants", """
select u.traj_id, u.step, bool_and(coalesce(f.first_seen < u.step, false)) as ids_known, count(*) as n_ids
from v_used u left join (select traj_id, product_id, min(step) as first_seen from v_seen group by 1, 2) f on f.traj_id = u.traj_id and f.product_id = u.product_id group by 1, 2
""")
def state_invariants(t):
    return G.state_invariants(t.v_used, t.v_seen)


@query("duplicate_call_in_turn", """
select uid as traj_id, turns as step, concat('{"q":"', lower(event_type), '"}') as signature, count(*) as n from v_rollout group by 1, 2, 3 having count(*) > 1
""")
def duplicate_call_in_turn(t):
    calls = t.v_rollout.select(F.col("uid").alias("traj_id"), F.col("turns").alias("step"), F.upper("event_type").alias("q"))
    return G.duplicate_call_in_turn(calls, signature=search_signature(calls))


@query("search_trace", """
with turn as (select traj_id, step, max((name = 'view_product_information')::int) * max((name = 'budget_check')::int) as decides,
   count(*) filter (name = 'find_product' and n_results > 0) as nonempty from v_calls group by 1, 2)
select c.traj_id, c.step, c.n_results, c.n_results = 0 as empty,
  case when coalesce((select max(decides) from turn t where t.traj_id = c.traj_id and t.step < c.step), 0) = 1 then 'DECISION'
       when coalesce((select sum(nonempty) from turn t where t.traj_id = c.traj_id and t.step < c.step and t.decides = 0), 0) >= 2 then 'CANDIDATE_SELECT'
       else 'CANDIDATE_SEARCH' end as phase
from v_calls c where c.name = 'find_product'
""")
def search_trace(t):
    return G.search_trace(t.v_calls).select("traj_id", "step", "n_results", "empty", "phase")


def check_turns(t):
    """One row per turn with its found, viewed and checked ids; a turn holds two calls at most."""
    found = t.v_results.groupBy("traj_id", "step").agg(F.collect_set("product_id").alias("found"))
    ids = F.split("product_ids", ",")
    rest = t.v_calls.groupBy("traj_id", "step").agg(
        F.max(F.when(F.col("name") == "view_product_information", ids)).alias("viewed"),
        F.max(F.when((F.col("name") == "budget_check") & (F.col("k") % 10 != 9), ids)).alias("checked"))
    return rest.join(found, ["traj_id", "step"], "left")


# a serial replay of the rules, turn by turn
WALK = """
with recursive f as (select traj_id, step, list(distinct product_id) as found from v_results group by 1, 2),
c as (select traj_id, step, string_split(max(product_ids) filter (name = 'view_product_information'), ',') as viewed,
   string_split(max(product_ids) filter (name = 'budget_check' and k % 10 <> 9), ',') as checked from v_calls group by 1, 2),
turn as (select c.traj_id, c.step, row_number() over (partition by c.traj_id order by c.step) as n, coalesce(f.found, cast([] as varchar[])) as found,
   coalesce(c.viewed, cast([] as varchar[])) as viewed, coalesce(c.checked, cast([] as varchar[])) as checked
   from c left join f on f.traj_id = c.traj_id and f.step = c.step),
walk(traj_id, n, step, active, seen, searched, view_step, ok, checked) as (
  select distinct traj_id, cast(0 as bigint), cast(-1 as int), cast([] as varchar[]), cast([] as varchar[]), cast(-1 as int), cast(-1 as int), false, cast([] as varchar[]) from turn
  union all
  select traj_id, n, step, case when ok then checked else active end, seen, searched, view_step, ok, checked from (
    select r.*, len(r.checked) > 0 and r.view_step > r.searched and len(list_distinct(r.checked)) = len(r.checked) and list_has_all(r.active, r.checked)
        and list_sort(r.checked) in (list_sort(list_distinct(r.viewed)), list_sort(r.seen)) as ok
    from (select t.traj_id, t.n, t.step, t.viewed, t.checked, list_distinct(list_concat(w.active, t.found)) as active,
        list_distinct(list_concat(case when len(t.found) > 0 then cast([] as varchar[]) else w.seen end, t.viewed)) as seen,
        case when len(t.found) > 0 then t.step else w.searched end as searched, case when len(t.viewed) > 0 then t.step else w.view_step end as view_step
      from walk w join turn t on t.traj_id = w.traj_id and t.n = w.n + 1) r) s)
"""


@query("valid_checks", WALK + "select traj_id, step, array_to_string(checked, ',') as budget_ids from walk where ok")
def valid_checks(t):
    return G.valid_checks(check_turns(t))


def turn_states(t):
    checks = G.valid_checks(check_turns(t)).select("traj_id", "step", F.lit(1).alias("check"))
    turns = t.v_calls.groupBy("traj_id", "step").agg(
        F.count_if((F.col("name") == "find_product") & (F.col("n_results") > 0)).alias("nonempty"),
        F.max(F.col("name").isin("view_product_information", "budget_check").cast("int")).alias("selects"))
    return turns.join(checks, ["traj_id", "step"], "left").withColumn("check", F.coalesce("check", F.lit(0)))


@query("state_of_turns", """
with turn as (select traj_id, step, count(*) filter (name = 'find_product' and n_results > 0) as nonempty,
   max((name in ('view_product_information', 'budget_check'))::int) as selects, max((name = 'budget_check' and k % 10 <> 9)::int) as chk from v_calls group by 1, 2),
f as (select t.traj_id, t.step, (select sum(nonempty) from turn p where p.traj_id = t.traj_id and p.step <= t.step) as n_found,
   (select max(step) from turn p where p.traj_id = t.traj_id and p.step <= t.step and nonempty > 0) as last_found,
   (select max(step) from turn p where p.traj_id = t.traj_id and p.step <= t.step and selects > 0) as last_select,
   (select max(step) from turn p where p.traj_id = t.traj_id and p.step <= t.step and chk > 0) as last_check from turn t)
select traj_id, step, case when last_check is null then case when last_found is null then 'CANDIDATE_SEARCH'
   when n_found < 2 and coalesce(last_select, -1) <= last_found then 'CANDIDATE_SEARCH' else 'CANDIDATE_SELECT' end
   when coalesce(last_found, -1) > last_check then 'CANDIDATE_SELECT' else 'DECISION' end as state from f
""")
def state_of_turns(t):
    turns = t.v_calls.groupBy("traj_id", "step").agg(
        F.count_if((F.col("name") == "find_product") & (F.col("n_results") > 0)).alias("nonempty"),
        F.max(F.col("name").isin("view_product_information", "budget_check").cast("int")).alias("selects"),
        F.max(((F.col("name") == "budget_check") & (F.col("k") % 10 != 9)).cast("int")).alias("check"))
    return G.state_of_turns(turns).select("traj_id", "step", "state")


@query("state_of_checked_turns", WALK + """,
call as (select traj_id, step, count(*) filter (name = 'find_product' and n_results > 0) as nonempty,
   max((name in ('view_product_information', 'budget_check'))::int) as selects from v_calls group by 1, 2),
g as (select c.traj_id, c.step, sum(nonempty) over w as n_found, max(case when nonempty > 0 then c.step end) over w as last_found,
   max(case when selects > 0 then c.step end) over w as last_select, max(v.step) over w as last_check
   from call c left join (select traj_id, step from walk where ok) v on v.traj_id = c.traj_id and v.step = c.step
   window w as (partition by c.traj_id order by c.step)),
s as (select traj_id, step, case when last_check is null then case when last_found is null then 'nothing_found'
   when n_found < 2 and coalesce(last_select, -1) <= last_found then 'first_results' else 'choosing' end
   when last_found > last_check then 'new_results_after_check' else 'checked' end as reason from g)
select traj_id, step, reason, case when reason in ('nothing_found', 'first_results') then 'CANDIDATE_SEARCH'
   when reason = 'checked' then 'DECISION' else 'CANDIDATE_SELECT' end as state from s
""")
def state_of_checked_turns(t):
    return G.state_of_turns(turn_states(t)).select("traj_id", "step", "state", "reason")


@query("local_evaluation", """
with f as (select traj_id, max_by(product_ids, step * 10 + pos) as ids from v_calls where name = 'recommend_product' group by 1),
i as (select traj_id, unnest(string_split(ids, ',')) as product_id from f),
s as (select traj_id, product_id, min_by(price, step * 100 + pos * 10 + rank_in_result) as price, min_by(shop_id, step * 100 + pos * 10 + rank_in_result) as shop_id from v_seen where name = 'find_product' group by 1, 2),
b as (select i.traj_id, count(*) as n, count(*) filter (s.price is null) as missing, round(coalesce(sum(s.price), 0), 2) as total, count(distinct s.shop_id) as n_shops from i left join s on s.traj_id = i.traj_id and s.product_id = i.product_id group by 1)
select traj_id, n as n_recommended, missing as n_missing, total,
  case when total >= 1000 and n_shops <= 1 and total > 0 then round(greatest(total * 0.8, total - 300), 2) else total end as payable from b
""")
def local_evaluation(t):
    base = G.local_evaluation(G.final_recommendation(t.v_calls).filter("recommended_ids <> ''"), t.v_seen.filter("name = 'find_product'"))
    voucher = base.withColumns({
        "voucher_type": F.lit("shop"), "threshold": F.lit(1000.0), "discount_type": F.lit("percentage"), "face_value": F.lit(None).cast("double"),
        "discount": F.lit(0.2), "cap": F.lit(300.0), "budget": F.lit(1500.0)})
    return V.payable_total(voucher, null_threshold="zero").select("traj_id", "n_recommended", "n_missing", "total", "payable")
