"""K: grouped rollout statistics."""

from pyspark.sql import functions as F

from cartlight.operators import groups as K
from cartlight.plans.registry import query, view

view("v_sample", """
select *, case when k % 50 = 7 then 0 else 1 end as format, case when k % 20 = 3 then 0 else 1 end as workflow_valid, 60.0 + seed as elapsed from v_rollout
""")
view("v_step", """
select traj_id as uid, step as sample, cast(user_id % 10 as int) as train_step, cast(floor(user_id / 10) as bigint) as prompt,
  case when event_type = 'purchase' then 1 else 0 end as outcome, case when event_type in ('purchase', 'signup') then 1 else 0 end as paper,
  case when k >= 95 then 1 else 0 end as truncated, case when k = 0 then 1 else 0 end as server_error, case when k = 1 then 1 else 0 end as json_failure,
  cast(k * 97 + 40 as int) as response_tokens from v_event
""")
view("x_group", """
select run_id, uid, count(*) as n, cast(sum(outcome) as bigint) as won, min(outcome) as lo, max(outcome) as hi, cast(sum(paper) as bigint) as paper_won, min(paper) as plo, max(paper) as phi from v_rollout group by 1, 2
""")
view("v_curve", """
select user_id % 10 as pilot, cast(k % 13 as int) as step, round(avg(value) / 500, 6) as terminal_asr, round(avg(case when event_type = 'signup' then 1 else 0 end), 6) as paper_asr,
  round(avg(case when event_type = 'view' then 1 else 0 end), 6) as mixed_rate, round(avg(case when k > 90 then 1 else 0 end), 6) as truncation, round(min(value) - 1, 6) as kl
from v_event group by 1, 2
""")


def rnd(df, cols, n=6):
    return [F.round(c, n).alias(c) for c in cols]


@query("query_key", """
select event_id, substr(sha1(case when event_id % 3 = 0 then cast(uid as varchar) else event_type end), 1, 16) as query_key from v_rollout
""")
def query_key(t):
    df = t.v_rollout.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("")).alias("prompt_id_raw"), F.col("uid").alias("u"), "event_type")
    df = df.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("prompt_id"), F.col("u").alias("uid"))
    return df.select("event_id", K.query_key(df).alias("query_key"))


@query("outcome_columns", """
select event_id, case when k < 30 then paper when k < 80 then cast(event_type <> 'error' as int) * cast(k % 2 = 0 as int) else -1 end as paper_outcome,
  case when k < 30 then 'paper_asr' when k < 80 then 'rule*budget' else 'missing' end as paper_source,
  case when k >= 80 then -1 when k < 30 then paper * cast(turns > 3 as int) else cast(event_type <> 'error' as int) * cast(k % 2 = 0 as int) * cast(turns > 3 as int) end as terminal_outcome,
  case when k >= 80 then 'terminal_asr' when k % 4 = 0 then 'paper_asr*terminate' else 'paper_asr*terminate_success' end as terminal_source
from v_rollout
""")
def outcome_columns(t):
    k = F.col("k")
    df = t.v_rollout.select(
        "event_id", F.when(k < 30, F.col("paper")).alias("paper_asr"), F.when(k < 80, (F.col("event_type") != "error").cast("int")).alias("rule"),
        (k % 2 == 0).cast("int").alias("budget"), F.when(k % 4 != 0, (F.col("turns") > 3).cast("int")).alias("terminate_success"),
        (F.col("turns") > 3).cast("int").alias("terminate"))
    out = K.outcome_columns(df)
    return out.select("event_id", F.coalesce("paper_outcome", F.lit(-1)).alias("paper_outcome"), "paper_source",
                      F.coalesce("terminal_outcome", F.lit(-1)).alias("terminal_outcome"), "terminal_source")


@query("group_state", """
select uid, count(*) as samples, cast(sum(outcome) as bigint) as successes, case when max(outcome) = 0 then 'all_fail' when min(outcome) = 1 then 'all_success' else 'mixed' end as state, count(*) = 8 as complete from v_rollout group by 1
""")
def group_state(t):
    return K.group_state(t.v_rollout, by=["uid"]).select("uid", "samples", "successes", "state", "complete")


@query("mixed_selection", """
select event_id, uid, outcome from v_rollout where uid in (select uid from (select uid, row_number() over (order by min(event_id)) as n from v_rollout group by 1 having min(outcome) < max(outcome)) x where n <= 50)
""")
def mixed_selection(t):
    return K.mixed_selection(t.v_rollout, by="uid", order="event_id", max_groups=50).select("event_id", "uid", "outcome")


@query("run_summary", """
select g.run_id, cast(sum(n) as bigint) as rows, count(*) as queries, round(sum(won) / sum(n)::double, 6) as terminal_asr, round(sum(paper_won) / sum(n)::double, 6) as paper_asr,
  count(*) filter (hi = 0) as terminal_all_fail, count(*) filter (lo < hi) as terminal_mixed, count(*) filter (lo = 1) as terminal_all_success,
  round(avg((lo < hi)::int), 6) as mixed_terminal_rate, round(avg(phi), 6) as paper_pass_at_g, round(avg(hi), 6) as terminal_pass_at_g,
  any_value(s.failure_rate) as failure_rate, any_value(s.infra) as infrastructure_failure_rate, any_value(s.p50) as response_tokens_p50, any_value(s.p95) as response_tokens_p95,
  any_value(s.mx) as response_tokens_max, any_value(s.steps) as steps_mean, any_value(s.fmt) as format_mean, any_value(round(s.r / s.el, 6)) as trajectories_per_second
from x_group g join (select run_id, count(*) as r, max(elapsed)::double as el, round(avg(greatest(server_error, json_failure, truncated)), 6) as failure_rate, round(avg(greatest(server_error, json_failure)), 6) as infra,
  quantile_cont(response_tokens, 0.5)::double as p50, round(quantile_cont(response_tokens, 0.95)::double, 6) as p95, max(response_tokens) as mx, round(avg(turns), 6) as steps, round(avg(format), 6) as fmt from v_sample group by 1) s on s.run_id = g.run_id
group by g.run_id
""")
def run_summary(t):
    out = K.run_summary(t.v_sample.withColumn("elapsed", F.col("elapsed").cast("double")), elapsed="elapsed")
    return out.select("run_id", "rows", "queries", "terminal_all_fail", "terminal_mixed", "terminal_all_success", "response_tokens_p50", "response_tokens_max",
                      *rnd(out, ["terminal_asr", "paper_asr", "mixed_terminal_rate", "paper_pass_at_g", "terminal_pass_at_g", "failure_rate",
                                 "infrastructure_failure_rate", "response_tokens_p95", "steps_mean", "format_mean", "trajectories_per_second"]))


def resampled(values, by, key, value, draws, seed="0"):
    """The same resampling with replacement in DuckDB text."""
    p = f"partition by {by}" if by else ""
    b = f"{by}, " if by else ""
    join = f"a.{by} = c.{by} and " if by else ""
    return f"""
b_num as (select {b}{value} as v, row_number() over ({p} order by md5('{seed}:' || cast({key} as varchar)), {key}) as i, count(*) over ({p}) as n from {values}),
b_slot as (select {b}n, i, unnest(range(1, {draws + 1})) as draw from b_num),
b_pick as (select {b}draw, cast(floor(cast('0x' || substr(md5('{seed}:' || draw || ':' || i), 1, 8) as bigint) / 4294967296.0 * n) + 1 as bigint) as i from b_slot),
b_mean as (select {'a.' + b if by else ''}draw, avg(v) as mean from b_pick a join b_num c on {join}a.i = c.i group by {'a.' + by + ', ' if by else ''}draw)
"""


def boot(values, by, key, value, draws, seed="0"):
    """The Poisson bootstrap of ``pool_configs`` in DuckDB text: how often each row counts in each draw."""
    b = f"{by}, " if by else ""
    weight = " + ".join(f"(d >= '{step}')::int" for step in K.poisson_steps())
    return f"""
b_digit as (select {b}v, draw, substr(md5('{seed}:' || ((draw - 1) // 4) || ':' || k), 8 * ((draw - 1) % 4) + 1, 8) as d
  from (select {b}{value} as v, cast({key} as varchar) as k, unnest(range(1, {draws + 1})) as draw from {values}) x where v is not null),
b_mean as (select {b}draw, sum(v * w) / nullif(sum(w), 0)::double as mean from (select *, {weight} as w from b_digit) y group by {b}draw)
"""


@query("bootstrap_ci", "with mixed as (select run_id, uid, (lo < hi)::int as mixed from x_group)," + resampled("mixed", "run_id", "uid", "mixed", 100) + """
select m.run_id, m.n, round(m.mean, 6) as mean, round(c.lo, 6) as ci_low, round(c.hi, 6) as ci_high from (select run_id, count(*) as n, avg(mixed) as mean from mixed group by 1) m
join (select run_id, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from b_mean group by 1) c on c.run_id = m.run_id
""")
def bootstrap_ci(t):
    groups = K.group_state(t.v_rollout, by=["run_id", "uid"]).select("run_id", "uid", (F.col("state") == "mixed").cast("int").alias("mixed"))
    out = K.bootstrap_ci(groups, by=["run_id"], key="uid", value="mixed", draws=100)
    return out.select("run_id", "n", *rnd(out, ["mean", "ci_low", "ci_high"]))


PAIRS = """
with a as (select query_id, avg(outcome) as v from v_rollout where seed = 0 group by 1), b as (select query_id, avg(outcome) as v from v_rollout where seed = 1 group by 1),
d as (select a.query_id, b.v - a.v as d from a join b on a.query_id = b.query_id),
"""


@query("paired_bootstrap", PAIRS + resampled("d", "", "query_id", "d", 100) + """
select (select count(*) from d) as n, round((select avg(d) from d), 6) as mean_difference, round(quantile_cont(mean, 0.025), 6) as ci_low, round(quantile_cont(mean, 0.975), 6) as ci_high,
  round(avg((mean > 0)::int), 6) as probability_positive from b_mean
""")
def paired_bootstrap(t):
    rates = t.v_rollout.groupBy("seed", "query_id").agg(F.avg("outcome").alias("v"))
    out = K.paired_bootstrap(rates.filter("seed = 0"), rates.filter("seed = 1"), key="query_id", value="v", draws=100)
    return out.select("n", *rnd(out, ["mean_difference", "ci_low", "ci_high", "probability_positive"]))


@query("bucket_metrics", """
select 'lang' as dimension, lang as bucket, source as model, count(*) as queries, count(*) as trajectories, round(avg(quality), 6) as mean from v_strata group by 2, 3
union all select 'toxic', cast(toxic as varchar), source, count(*), count(*), round(avg(quality), 6) from v_strata group by 2, 3
""")
def bucket_metrics(t):
    out = K.bucket_metrics(t.v_strata, model="source", dimensions=["lang", "toxic"], value="quality", key="doc_id")
    return out.select("dimension", "bucket", F.col("source").alias("model"), "queries", "trajectories", F.round("mean", 6).alias("mean"))


view("x_run", """
select g.run_id, cast(sum(n) as bigint) as rows, avg((n = 8)::int) as complete, avg(won / n::double) as terminal_asr, avg(hi) as pass_at_g, avg((lo < hi)::int) as mixed, any_value(s.fail) as failure_rate, any_value(s.fmt) as format_mean, any_value(s.wf) as workflow_mean, any_value(s.tok) as tok, any_value(s.seed) as seed, any_value(s.code) as code
from x_group g join (select run_id, avg(greatest(server_error, json_failure, truncated)) as fail, avg(format) as fmt, avg(workflow_valid) as wf, avg(response_tokens) as tok, min(seed) as seed, min(temperature_code) as code from v_sample group by 1) s on s.run_id = g.run_id group by g.run_id
""")
GATES = """
select *, concat_ws(';', case when format_mean < 0.98 then 'format_below_threshold' end, case when failure_rate > 0.031 then 'failure_rate_above_threshold' end,
  case when workflow_mean < (select avg(workflow_mean) from x_run where seed = 0) - 0.002 then 'workflow_below_baseline_tolerance' end) as gate_reasons from x_run
"""


def gated(t):
    runs = K.run_summary(t.v_sample)
    meta = t.v_sample.select("run_id", "seed", "temperature_code").distinct()
    return K.gates(runs.join(meta, "run_id"), max_failure_rate=0.031, workflow_drop_max=0.002, baseline=F.col("seed") == 0)


@query("gates", f"select run_id, gate_reasons, gate_reasons = '' as gate_eligible from ({GATES}) g")
def gates(t):
    return gated(t).select("run_id", F.array_join("gate_reasons", ";").alias("gate_reasons"), "gate_eligible")


@query("rank_runs", f"""
select run_id, row_number() over (order by round(mixed, 9) desc, round(pass_at_g, 9) desc, round(terminal_asr, 9) desc, tok, run_id) as rank from ({GATES}) g where not contains(gate_reasons, 'format')
""")
def rank_runs(t):
    runs = gated(t).withColumns({
        "ok": ~F.array_contains("gate_reasons", "format_below_threshold"), "m": F.round("mixed_terminal_rate", 9),
        "p": F.round("terminal_pass_at_g", 9), "a": F.round("terminal_asr", 9)})
    keys = [("m", True), ("p", True), ("a", True), ("response_tokens_mean", False)]
    return K.rank_runs(runs, keys=keys, eligible="ok").select("run_id", "rank")


@query("pool_configs", "with good as (select run_id, code from x_run), mixed as (select r.code, g.run_id || ':' || g.uid as uid, (g.lo < g.hi)::int as mixed, g.won, g.n from x_group g join good r on r.run_id = g.run_id),"
       + boot("mixed", "code", "uid", "mixed", 60) + """
select m.code as temperature_code, 2 as run_count, 2 as eligible_run_count, m.n as observations, round(m.mr, 6) as mixed_rate, round(m.ta, 6) as terminal_asr, round(c.lo, 6) as ci_low, round(c.hi, 6) as ci_high,
  row_number() over (order by c.lo desc, m.mr desc, m.ta desc, m.code) as rank
from (select code, count(*) as n, avg(mixed) as mr, sum(won) / sum(n)::double as ta from mixed group by 1) m
join (select code, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from b_mean group by 1) c on c.code = m.code
""")
def pool_configs(t):
    groups = K.group_state(t.v_rollout, by=["run_id", "uid"]).withColumn("mixed", (F.col("state") == "mixed").cast("int"))
    runs = t.v_rollout.select("run_id", "temperature_code").distinct().withColumn("gate_eligible", F.lit(True))
    out = K.pool_configs(groups, runs, config=["temperature_code"], draws=60)
    return out.select("temperature_code", "run_count", "eligible_run_count", "observations", "rank", *rnd(out, ["mixed_rate", "terminal_asr", "ci_low", "ci_high"]))


@query("group_variance_report", """
select g.run_id, count(*) as prompts, round(avg(m), 6) as mean_of_means, round(avg(v), 6) as mean_of_vars, round(max(v), 6) as max_var, any_value(s.rows) as rows, any_value(s.m2) as score_mean, any_value(s.v2) as score_var
from (select run_id, uid, avg(score) as m, var_pop(score) as v from v_rollout group by 1, 2) g
join (select run_id, count(*) as rows, round(avg(score), 6) as m2, round(var_pop(score), 6) as v2 from v_rollout group by 1) s on s.run_id = g.run_id group by g.run_id
""")
def group_variance_report(t):
    out = K.group_variance_report(t.v_rollout, run=["run_id"], group="uid", value="score")
    return out.select("run_id", "prompts", "rows", *rnd(out, ["mean_of_means", "mean_of_vars", "max_var", "score_mean", "score_var"]))


@query("top_variance_groups", """
select run_id, uid, round(var, 6) as var, rank from (select run_id, uid, var, row_number() over (partition by run_id order by round(var, 9) desc, uid) as rank from (select run_id, uid, var_pop(score) as var from v_rollout group by 1, 2) g) r where rank <= 10
""")
def top_variance_groups(t):
    out = K.top_variance_groups(t.v_rollout, run=["run_id"], group="uid", value="score")
    return out.select("run_id", "uid", F.round("var", 6).alias("var"), "rank")


CKPT = "select train_step as checkpoint, avg(1 - truncated) as pm, var_pop(1 - truncated) as pv, avg(response_tokens / 1000.0) as tm, var_pop(response_tokens / 1000.0::double) as tv from v_step group by 1"


@query("checkpoint_select", f"""
select checkpoint, round(tv, 6) as task_var, round(tm, 6) as task_mean from ({CKPT}) c where pm >= 0.9 and pv <= 0.05 order by tv desc, tm desc limit 1
""")
def checkpoint_select(t):
    c = t.v_step.groupBy(F.col("train_step").alias("checkpoint")).agg(
        F.avg(1 - F.col("truncated")).alias("protocol_mean"), F.var_pop(1 - F.col("truncated")).alias("protocol_var"),
        F.avg(F.col("response_tokens") / 1000).alias("task_mean"), F.var_pop(F.col("response_tokens") / 1000).alias("task_var"))
    out = K.checkpoint_select(c)
    return out.select("checkpoint", F.round("task_var", 6).alias("task_var"), F.round("task_mean", 6).alias("task_mean"))


@query("best_checkpoint", """
with ok as (select * from v_curve where step % 3 = 0),
b as (select pilot, step as best_step, terminal_asr as best_rate from (select *, row_number() over (partition by pilot order by terminal_asr desc, paper_asr desc, truncation, kl, step) as n from ok where truncation <= 0.5) x where n = 1),
l as (select pilot, terminal_asr - before as gain from (select pilot, step, terminal_asr, lag(terminal_asr) over (partition by pilot order by step) as before, row_number() over (partition by pilot order by step desc) as n from ok) y where n = 1),
z as (select pilot, max(terminal_asr) as baseline from v_curve where step = 0 group by 1)
select b.pilot, b.best_step, b.best_rate, coalesce(z.baseline, 0) as baseline, b.best_step > 0 and b.best_rate >= coalesce(z.baseline, 0) + 0.05 as goal_met,
  coalesce(l.gain >= 0.02, false) and not (b.best_step > 0 and b.best_rate >= coalesce(z.baseline, 0) + 0.05) as extend
from b left join l on l.pilot = b.pilot left join z on z.pilot = b.pilot
""")
def best_checkpoint(t):
    v = t.v_curve.select("pilot", "step", "terminal_asr", F.col("paper_asr").cast("double"), F.col("truncation").cast("double").alias("infra"),
                         F.col("truncation").cast("double").alias("truncation"), F.col("kl").alias("tokens"))
    return K.best_checkpoint(v, by=["pilot"], health=F.col("truncation") <= 0.5, saved=F.col("step") % 3 == 0)


AUC = """select pilot, sum((step - x0) * (terminal_asr + y0) / 2) / nullif(max(step) - min(step), 0) as auc, count(*) as points from (
  select pilot, step, terminal_asr, lag(step) over (partition by pilot order by step) as x0, lag(terminal_asr) over (partition by pilot order by step) as y0 from v_curve) c group by 1"""


@query("curve_auc", f"select pilot, round(auc, 6) as auc, points from ({AUC}) a")
def curve_auc(t):
    out = K.curve_auc(t.v_curve, by=["pilot"], x="step", y="terminal_asr")
    return out.withColumn("auc", F.round("auc", 6))


@query("pilot_ranking", f"""
select a.pilot, round(a.auc, 6) as auc, l.terminal_asr as last_terminal, l.paper_asr::double as last_paper, m.tr::double as max_truncation, m.kl as max_abs_kl, row_number() over (order by auc desc, l.terminal_asr desc, l.paper_asr desc) as rank
from ({AUC}) a join (select * from (select *, row_number() over (partition by pilot order by step desc) as n from v_curve) x where n = 1) l on l.pilot = a.pilot
join (select pilot, max(truncation) as tr, max(abs(kl)) as kl from v_curve group by 1) m on m.pilot = a.pilot
""")
def pilot_ranking(t):
    v = t.v_curve.select("pilot", "step", "terminal_asr", *[F.col(c).cast("double").alias(c) for c in ["paper_asr", "mixed_rate", "truncation", "kl"]])
    out = K.pilot_ranking(v, by="pilot")
    return out.select("pilot", F.round("auc", 6).alias("auc"), "last_terminal", "last_paper", "max_truncation", "max_abs_kl", "rank")


@query("validation_record", """
select r.*, m.* exclude (train_step) from (select train_step, cast(sum(n) as bigint) as trajectories, count(*) as queries, round(avg(m), 6) as terminal_asr, round(avg((lo < hi)::int), 6) as mixed_rate
  from (select train_step, prompt, count(*) as n, avg(outcome) as m, min(outcome) as lo, max(outcome) as hi from v_step group by 1, 2) g group by 1) r
join (select train_step, round(avg(paper), 6) as paper_asr, round(avg(truncated), 6) as truncation, round(avg(json_failure), 6) as json_failure, quantile_cont(response_tokens, 0.5)::double as response_p50,
  round(quantile_cont(response_tokens, 0.95)::double, 6) as response_p95, max(response_tokens) as response_max from v_step group by 1) m on m.train_step = r.train_step
""")
def validation_record(t):
    out = K.validation_record(t.v_step, step="train_step", group="prompt")
    return out.select("train_step", "trajectories", "queries", "response_p50", "response_max",
                      *rnd(out, ["terminal_asr", "mixed_rate", "paper_asr", "truncation", "json_failure", "response_p95"]))


@query("dynamic_record", """
select train_step, cast(sum(n) as bigint) as trajectories, count(*) as groups, count(*) filter (hi = 0) as all_fail, count(*) filter (lo < hi) as mixed, count(*) filter (lo = 1) as all_success,
  round(avg((lo < hi)::int), 6) as mixed_yield, round(sum(won) / sum(n)::double, 6) as raw_reward
from (select train_step, prompt, count(*) as n, sum(outcome) as won, min(outcome) as lo, max(outcome) as hi from v_step group by 1, 2) g group by 1
""")
def dynamic_record(t):
    out = K.dynamic_record(t.v_step, step="train_step", group="prompt")
    return out.select("train_step", "trajectories", "groups", "all_fail", "mixed", "all_success", *rnd(out, ["mixed_yield", "raw_reward"]))


@query("consecutive_runs", """
select user_id, event_id, run_no, cast(floor((row_number() over (partition by user_id, run_no order by event_id) - 1) / 2) as int) as chunk_no from (
  select user_id, event_id, event_type, cast(sum(s) over (partition by user_id order by event_id) as bigint) as run_no from (
    select user_id, event_id, event_type, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as s from events) a) b
""")
def consecutive_runs(t):
    out = K.consecutive_runs(t.events, by=["user_id"], order="event_id", value="event_type", chunk=2)
    return out.select("user_id", "event_id", "run_no", "chunk_no")


@query("splice_baseline", """
select step, terminal_asr, src from (select step, terminal_asr, 'reused' as src from v_curve where pilot = 1 and step < 4
union all select step, terminal_asr, 'current' from v_curve where pilot = 2 and step not in (select step from v_curve where pilot = 1 and step < 4)) u
""")
def splice_baseline(t):
    cur = t.v_curve.filter("pilot = 2").select("step", "terminal_asr", F.lit("current").alias("src"))
    old = t.v_curve.filter("pilot = 1 and step < 4").select("step", "terminal_asr", F.lit("reused").alias("src"))
    return K.splice_baseline(cur, old)


@query("align_runs", """
select coalesce(a.step, b.step) as step, coalesce(a.terminal_asr, -1) as left_terminal_asr, coalesce(b.terminal_asr, -1) as right_terminal_asr
from (select * from v_curve where pilot = 1 and step > 2) a full outer join (select * from v_curve where pilot = 2 and step < 9) b on a.step = b.step
""")
def align_runs(t):
    out = K.align_runs(t.v_curve.filter("pilot = 1 and step > 2"), t.v_curve.filter("pilot = 2 and step < 9"), step="step", value="terminal_asr")
    return out.na.fill(-1.0)
