"""I: rejection sampling, voting, merging."""

from pyspark.sql import functions as F

from cartlight.functions.text import word_count
from cartlight.operators import selection as I
from cartlight.operators import trajectory as G
from cartlight.plans.registry import query, view

# attempts: eight files per query
view("v_attempt", """
select uid as query_id, sample as file_no, event_id, case when event_type in ('purchase', 'signup') then 1.0 else 0.5 end as rule,
  case when k < 60 then 1 else 0 end as budget, case when k % 3 = 0 then 0 else 1 end as shop, turns as n_steps,
  case when event_type = 'error' then cast(0 as double) else 1 / cast(turns as double) end as length_score, case when k >= 97 then 0 else 1 end as format_ok
from v_rollout
""")
PASS = "rule >= 1 and budget >= 1"


def passed():
    return I.gate_success(task="voucher")


@query("gate_success", f"""
select event_id, rule >= 1 as product, rule >= 1 and shop >= 1 as shop_task, {PASS} as voucher, rule >= 1 or budget >= 1 as voucher_lenient from v_attempt
""")
def gate_success(t):
    return t.v_attempt.select("event_id", I.gate_success(task="product").alias("product"), I.gate_success(task="shop").alias("shop_task"),
                              passed().alias("voucher"), I.gate_success(task="voucher", mode="lenient").alias("voucher_lenient"))


@query("best_of_n", f"""
select query_id, file_no, n_steps from (select *, row_number() over (partition by query_id order by length_score desc, file_no) as n from v_attempt where {PASS} and length_score > 0) x where n = 1
""")
def best_of_n(t):
    return I.best_of_n(t.v_attempt, by="query_id", passed=passed()).select("query_id", "file_no", "n_steps")


@query("multi_vote", f"""
select query_id, file_no, passed from (select query_id, file_no, {PASS} as passed, row_number() over (partition by query_id order by ({PASS}) desc, md5('0:' || query_id || ':' || file_no)) as n from v_attempt) x where n = 1
""")
def multi_vote(t):
    return I.multi_vote(t.v_attempt, by="query_id", passed=passed()).select("query_id", "file_no", "passed")


@query("flatten_calls", """
select traj_id, step, call, obs, row_number() over (partition by traj_id order by step, pos) as new_step from (
  select traj_id, step, row_number() over (partition by traj_id, step order by pos) - 1 as pos, name as call, obs_kind as obs from v_call_obs where obs_kind is not null) x
""")
def flatten_calls(t):
    steps = t.v_call_obs.filter("obs_kind is not null").groupBy("traj_id", "step").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "obs_kind"))).alias("c"))
    steps = steps.select("traj_id", "step", F.transform("c", lambda x: x["name"]).alias("calls"), F.transform("c", lambda x: x["obs_kind"]).alias("observations"))
    return I.flatten_calls(steps).select("traj_id", "step", F.col("call").alias("call"), F.col("observation").alias("obs"), "new_step")


@query("sft_from_best", f"""
select b.query_id, m.step, len(string_split(m.content, ' ')) as tokens from (select query_id, min(file_no) as f from v_attempt where {PASS} group by 1) b
join v_message m on m.traj_id = b.query_id where m.k < 97 and len(string_split(trim(regexp_replace(m.content, '\\s+', ' ', 'g')), ' ')) <= 14
""".replace("len(string_split(m.content, ' ')) as tokens", "len(string_split(trim(regexp_replace(m.content, '\\s+', ' ', 'g')), ' ')) as tokens"))
def sft_from_best(t):
    good = t.v_attempt.filter(passed()).select(F.col("query_id").alias("traj_id")).distinct()
    steps = t.v_message.join(good, "traj_id", "left_semi")
    tokens = word_count(F.col("content"))
    rows = I.sft_from_best(steps, format_ok=G.format_valid(F.col("content")) == 1, instruction=F.lit("shop"), input_text=F.col("traj_id").cast("string"),
                           output=F.col("content"), tokens=tokens, limit=14)
    return rows.select(F.col("traj_id").alias("query_id"), "step", tokens.alias("tokens"))


@query("stage_funnel", f"""
select count(*) as total, count(*) filter (a > 0) as success, count(*) filter (b > 0) as well_formed, count(*) filter (c > 0) as short from (
 select query_id, max(({PASS})::int) as a, max(({PASS} and format_ok = 1)::int) as b, max(({PASS} and format_ok = 1 and n_steps <= 4)::int) as c from v_attempt group by 1) q
""")
def stage_funnel(t):
    return I.stage_funnel(t.v_attempt, by="query_id", gates={"success": passed(), "well_formed": F.col("format_ok") == 1, "short": F.col("n_steps") <= 4})


@query("fail_cases", f"""
with s as (select query_id from (select distinct query_id from v_attempt) d order by md5('0:' || query_id), query_id limit 50),
g as (select query_id, file_no from (select *, row_number() over (partition by query_id order by length_score desc, file_no) as n from v_attempt where {PASS} and length_score > 0 and query_id in (select query_id from s)) x where n = 1)
select query_id, file_no, 'success' as "case" from g
union all select query_id, max(file_no), 'failure' from v_attempt where query_id in (select query_id from s) and query_id not in (select query_id from g) group by 1
""")
def fail_cases(t):
    return I.fail_cases(t.v_attempt, by="query_id", passed=passed())


view("v_primary", "select query_id as query, file_no, event_id as idx, rule >= 1 and budget >= 1 as success from v_attempt where file_no = 0")
view("v_retry", "select query_id as query, file_no, event_id as idx, rule >= 1 and budget >= 1 as success from v_attempt where file_no > 4")
MERGE = """
with p as (select query, min(idx) as original_idx from v_primary group by 1),
u as (select idx as original_idx, 0 as priority, idx, query from v_primary where success union all
      select p.original_idx, 1, r.idx, r.query from v_retry r join p on p.query = r.query where r.success),
n as (select *, row_number() over (partition by original_idx order by priority, idx) as n from u)
"""


@query("merge_runs", MERGE + "select original_idx, priority, idx from n where n = 1")
def merge_runs(t):
    merged, _ = I.merge_runs(t.v_primary, t.v_retry)
    return merged.select("original_idx", "priority", "idx")


@query("merge_runs_skipped", MERGE + "select original_idx, priority, idx from n where n > 1")
def merge_runs_skipped(t):
    _, skipped = I.merge_runs(t.v_primary, t.v_retry)
    return skipped.select("original_idx", "priority", "idx")


@query("filter_by_length", "select doc_id, n_chars from documents where n_chars <= 2000")
def filter_by_length(t):
    return I.filter_by_length(t.documents.select("doc_id", "n_chars"), length=F.col("n_chars"), limit=2000)


@query("length_filter_report", """
select lang, count(*) filter (n_chars <= 2000) as kept, count(*) filter (n_chars > 2000) as dropped, max(n_chars) filter (n_chars <= 2000) as max_kept, max(n_chars) as max_seen from documents group by 1
""")
def length_filter_report(t):
    return I.length_filter_report(t.documents, length=F.col("n_chars"), limit=2000, by=["lang"])


@query("empty_completion", """
select conv_id, bool_or(trim(regexp_replace(case when turn = 3 then concat(' ', chr(10)) else text end, '\\s+', '', 'g')) = '') as has_empty_completion from conversations group by 1
""")
def empty_completion(t):
    c = t.conversations.withColumn("content", F.when(F.col("turn") == 3, " \n").otherwise(F.col("text")))
    return I.empty_completion(c, by="conv_id", content="content")


@query("drop_samples", "select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 100)")
def drop_samples(t):
    drops = t.events.filter("event_type = 'error' and value > 100").select("user_id")
    return I.drop_samples(t.events, drops, key="user_id").select("event_id", "user_id")
