"""O, Q: training sets and insight reports."""

from pyspark.sql import functions as F

from cartlight.functions.text import word_count
from cartlight.operators import insight as Q
from cartlight.operators import training as O
from cartlight.plans.registry import query, view
from cartlight.plans.scoring_queries import products_nested

WORDS = "case when trim(regexp_replace({c}, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ')) end"

view("v_turn", "select conv_id, turn, concat(role, ': ', text) as user_text, concat('<state> {\"turn\": ', cast(turn as string), '} </state>') as reply, role from conversations")


@query("prefix_examples", """
select conv_id, turn, md5((select string_agg(p.user_text || '|' || p.reply, '|' order by p.turn) from v_turn p where p.conv_id = t.conv_id and p.turn <= t.turn)) as digest,
  (select string_agg(case when p.turn = t.turn then '1' else '0' end, '' order by p.turn) from v_turn p where p.conv_id = t.conv_id and p.turn <= t.turn) as mask
from v_turn t
""")
def prefix_examples(t):
    out = O.prefix_examples(t.v_turn, by="conv_id", order="turn", user="user_text", assistant="reply")
    return out.select("conv_id", "turn", F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("digest"),
                      F.array_join(F.transform("assistant_loss_mask", lambda x: x.cast("string")), "").alias("mask"))


@query("recovery_turns", """
select uid, sample, coalesce(lag(server_error + json_failure + truncated) over (partition by uid order by sample), 0) > 0 or k < 3 as recovery from v_rollout
""")
def recovery_turns(t):
    masked = (F.col("server_error") + F.col("json_failure") + F.col("truncated")) > 0
    out = O.recovery_turns(t.v_rollout, by="uid", order="sample", masked=masked, feedback=F.col("k") < 3)
    return out.select("uid", "sample", "recovery")


@query("sft_report", """
select run_id, count(*) as rows, count(*) filter (truncated = 1 and response_tokens <= 9000) as masked, count(*) filter (truncated = 0 and response_tokens <= 9000) as kept, count(*) filter (response_tokens > 9000) as dropped_overlong,
  sum(response_tokens)::bigint as total, round(avg(response_tokens), 6) as mean, quantile_cont(response_tokens, 0.5)::double as p50, round(quantile_cont(response_tokens::double, 0.9), 4) as p90,
  round(quantile_cont(response_tokens::double, 0.95), 4) as p95, round(quantile_cont(response_tokens::double, 0.99), 4) as p99, max(response_tokens) as max
from v_rollout group by 1
""")
def sft_report(t):
    out = O.sft_report(t.v_rollout.withColumn("masked", F.col("truncated") == 1), by=["run_id"], masked="masked", length="response_tokens", limit=9000)
    return out.select("run_id", "rows", "masked", "kept", "dropped_overlong", "total", F.round("mean", 6).alias("mean"), "p50", *[F.round(c, 4).alias(c) for c in ("p90", "p95", "p99")], "max")


@query("split_actions", """
select traj_id, step, pos, name, cast(sum(case when name = 'find_product' and prev = 'find_product' then 0 else 1 end) over (partition by traj_id order by step * 10 + pos) as bigint) as turn
from (select *, lag(name) over (partition by traj_id order by step * 10 + pos) as prev from v_calls) c
""")
def split_actions(t):
    calls = t.v_calls.select("traj_id", "step", "pos", "name", (F.col("step") * 10 + F.col("pos")).alias("o"))
    return O.split_actions(calls, by=["traj_id"], order="o").select("traj_id", "step", "pos", "name", "turn")


@query("turn_transitions", """
select label, next_label, count(*) as n from (select name as label, lead(name) over (partition by traj_id order by step * 10 + pos) as next_label from v_calls) c where next_label is not null group by 1, 2
""")
def turn_transitions(t):
    calls = t.v_calls.select("traj_id", "name", (F.col("step") * 10 + F.col("pos")).alias("o"))
    return O.turn_transitions(calls, by=["traj_id"], order="o", label="name")


@query("upsample_by_tool", """
select traj_id, step, pos, name, cast(unnest(range(case name when 'recommend_product' then 3 when 'terminate' then 2 else 1 end)) as int) as duplicate_index from v_calls
""")
def upsample_by_tool(t):
    out = O.upsample_by_tool(t.v_calls, {"recommend_product": 3, "terminate": 2}, tool="name")
    return out.select("traj_id", "step", "pos", "name", "duplicate_index")


@query("sft_rows", f"""
select conv_id, turn, 3 + {WORDS.format(c='text')} as token_length, 3 + {WORDS.format(c='text')} > 200 as overlong from conversations
""")
def sft_rows(t):
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit("You shop.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    out = O.sft_rows(t.conversations.withColumn("prompt", prompt), prompt="prompt", completion=F.lit("ok"), extra=F.struct("conv_id", "turn"), limit=200)
    return out.select("extra_info.conv_id", "extra_info.turn", "token_length", "overlong")


@query("rewrite_state_blocks", """
select conv_id, turn, 1 as state_count, md5(concat('new system|', user_text, '<state>{"turn": ', turn, ',"folded":1}</state>|', reply)) as digest from v_turn
""")
def rewrite_state_blocks(t):
    def m(role, c):
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    df = t.v_turn.select("conv_id", "turn", F.array(m("system", F.lit("old")), m("user", F.concat("user_text", F.regexp_replace("reply", r"\} <", " <"))), m("assistant", F.col("reply"))).alias("messages"))
    out = O.rewrite_state_blocks(df, messages="messages", replacement='$1,"folded":1}', system=F.lit("new system"))
    return out.select("conv_id", "turn", "state_count", F.md5(F.array_join(F.transform("messages", lambda x: x["content"]), "|")).alias("digest"))


@query("message_loss_mask", """
select conv_id, string_agg(case when role = 'assistant' and turn % 3 <> 0 then '1' else '0' end, '' order by turn) as mask from conversations group by 1 having count(*) filter (role = 'system' and turn > 0) = 0
""")
def message_loss_mask(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = t.conversations.groupBy("conv_id").agg(rows.alias("messages"))
    df = df.withColumn("keep", F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: (m["turn"] % 3 != 0).cast("int")))
    out = O.message_loss_mask(df, messages="messages", assistant_mask="keep", strict=False).filter("mask_error is null")
    return out.select("conv_id", F.array_join(F.transform("loss_mask", lambda x: x.cast("string")), "").alias("mask"))


def summary_sql(table, cols):
    return " union all ".join(
        f"select '{c}' as metric, count(*) as n, min({c})::double as min, max({c})::double as max, round(avg({c}), 6) as mean, (list_sort(list({c}))[count(*) // 2 + 1])::double as median from {table}" for c in cols)


@query("token_summary", summary_sql("v_rollout", ["response_tokens", "turns", "k"]))
def token_summary(t):
    return Q.summary(t.v_rollout, ["response_tokens", "turns", "k"]).withColumn("mean", F.round("mean", 6))


def share_sql(dim, expr, table, where="true"):
    return f"select '{dim}' as dimension, cast({expr} as varchar) as bucket, count(*) as n, round(count(*) / (select count(*) from {table} where {where})::double, 6) as share from {table} where {where} group by 2"


view("v_line_info", """
select g.order_id, g.product_id, p.category, case when p.price < 930 then 'less than' when p.price < 960 then 'between' end as price_mode, 4 + cast(length(p.services) > 0 as int) as n_fields
from v_gold g join v_product p on p.product_id = g.product_id
""")


@query("query_insight", " union all ".join([
    share_sql("product_count", "product_count", "v_plan"), share_sql("category", "split_part(category, ' > ', 1)", "v_line_info"),
    share_sql("n_fields", "n_fields", "v_line_info"), share_sql("price_mode", "coalesce(price_mode, 'no')", "v_line_info")]))
def query_insight(t):
    return Q.query_insight(t.v_plan, t.v_line_info).withColumn("share", F.round("share", 6))


@query("query_token_summary", f"select count(*) as n, min(w)::double as min, max(w)::double as max, round(avg(w), 6) as mean, (list_sort(list(w))[count(*) // 2 + 1])::double as median from (select {WORDS.format(c='query')} as w from v_plan_text) x")
def query_token_summary(t):
    out = Q.summary(t.v_plan_text.select(word_count(F.col("query")).alias("tokens")), ["tokens"])
    return out.select("n", "min", "max", F.round("mean", 6).alias("mean"), "median")


@query("catalog_insight", """
select count(distinct product_id) as unique_products, (select count(*) from (select distinct k, v from (
  select 'brand' as k, attr_brand as v from v_product union all select 'type', attr_type from v_product union all select 'color', attr_color from v_product
  union all select 'size', sku_size from v_product union all select 'size', cast(cast(sku_size as int) + 1 as varchar) from v_product union all select null, unnest(string_split(services, ',')) from v_product) f) d) as unique_fields
from v_product
""")
def catalog_insight(t):
    return Q.catalog_insight(products_nested(t).select("product.*"))


@query("field_count_distribution", share_sql("n_fields", "5 + len(string_split(services, ','))", "v_product"))
def field_count_distribution(t):
    return Q.field_count_distribution(products_nested(t).select("product.*")).withColumn("share", F.round("share", 6))


@query("rollout_counts", """
select traj_id, count(distinct step) as steps, count(distinct q) as queries, count(*) filter (name = 'find_product' and cast(page as int) > 1) as page_turns, count(*) filter (shop_param is not null) as in_shop_searches,
  count(*) filter (name = 'view_product_information') as views, cast(0 as bigint) as web_searches from v_calls group by 1
""")
def rollout_counts(t):
    return Q.rollout_counts(t.v_calls)


@query("rollout_insight", "with c as (select traj_id, count(distinct step) as steps, count(distinct q) as queries, count(*) filter (name = 'view_product_information') as views from v_calls group by 1) " + summary_sql("c", ["steps", "queries", "views"]))
def rollout_insight(t):
    return Q.summary(Q.rollout_counts(t.v_calls), ["steps", "queries", "views"]).withColumn("mean", F.round("mean", 6))


@query("model_pivot", """
select event_type as metric, max(v) filter (m = 'm0') as m0, max(v) filter (m = 'm1') as m1, max(v) filter (m = 'm2') as m2 from (select event_type, concat('m', user_id % 3) as m, round(avg(value), 6) as v from events group by 1, 2) x group by 1
""")
def model_pivot(t):
    m = t.events.groupBy(F.col("event_type").alias("metric"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model")).agg(F.round(F.avg("value"), 6).alias("value"))
    return Q.model_pivot(m, models=["m0", "m1", "m2"])


@query("context_audit", " union all ".join(f"""
select '{c}' as measure, {n} as limit, max({e})::bigint as max_tokens, arg_max(conv_id, {e} * 1000000 - conv_id * 100 - turn) as max_conv_id, arg_max(turn, {e} * 1000000 - conv_id * 100 - turn) as max_turn, count(*) filter ({e} > {n}) as failures, count(*) filter ({e} > {n}) = 0 as passes from conversations"""
    for c, n, e in [("words", 150, WORDS.format(c="text")), ("chars", 100000, "len(text)")]))
def context_audit(t):
    df = t.conversations.select("conv_id", "turn", word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))
    return Q.context_audit(df, {"words": 150, "chars": 100000}, id_columns=["conv_id", "turn"])


@query("quality_ratios", """
select count(*) as n, round(avg(e), 6) as empty_ratio, round(avg(z), 6) as null_result_ratio, round(avg(1 - m), 6) as unterminated_ratio from (
 select traj_id, max((k < 2)::int) as e, max((obs_kind is null)::int) as z, max((name = 'terminate')::int) as m from v_call_obs group by 1) x
""")
def quality_ratios(t):
    per = t.v_call_obs.groupBy("traj_id").agg(F.bool_or(F.col("k") < 2).alias("has_empty"), F.bool_or(F.col("obs_kind").isNull()).alias("has_null_result"),
                                              F.bool_or(F.col("name") == "terminate").alias("has_terminate"))
    out = Q.quality_ratios(per)
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])
