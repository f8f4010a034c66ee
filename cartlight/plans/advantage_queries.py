"""L, M, P: advantages, validation metrics, load balancing."""

from pyspark.sql import functions as F

from cartlight.operators import advantage as L
from cartlight.operators import balance as P
from cartlight.operators import validation as M
from cartlight.plans.registry import query, view

view("v_token", """
select uid, sample, score, 1 - truncated as mask, k / cast(100 as double) as baseline from v_rollout
""")
view("x_stat", """
select uid, count(*) as n, avg(score) as m, stddev_samp(score) as s, sum(score * response_tokens) / sum(response_tokens) as opo from v_rollout group by 1
""")


def adv(t, name, **options):
    out = L.advantage(name, t.v_rollout, **options)
    return out.select("event_id", F.round("advantage", 6).alias("advantage"))


J = "from v_rollout r join x_stat g on g.uid = r.uid"


@query("grpo_advantage", f"select event_id, round((score - m) / (s + 1e-6), 6) as advantage {J}")
def grpo_advantage(t):
    return adv(t, "grpo")


@query("grpo_advantage_unscaled", f"select event_id, round(score - m, 6) as advantage {J}")
def grpo_advantage_unscaled(t):
    return adv(t, "grpo", scale=False)


@query("grpo_passk", """
select event_id, round(case when n = 1 then (score - nxt) / (s + 1e-6) else 0.0 end, 6) as advantage from (
 select r.*, g.s, row_number() over (partition by r.uid order by score desc, sample) as n, lead(score) over (partition by r.uid order by score desc, sample) as nxt from v_rollout r join x_stat g on g.uid = r.uid) x
""")
def grpo_passk(t):
    return adv(t, "grpo_passk")


@query("rloo", f"select event_id, round(score * n / (n - 1) - m * n / (n - 1), 6) as advantage {J}")
def rloo(t):
    return adv(t, "rloo")


@query("opo", f"select event_id, round(score - opo, 6) as advantage {J}")
def opo(t):
    return adv(t, "opo")


@query("gpg", f"select event_id, round((score - m) * (select count(*) / cast(count(*) filter (score <> 0) as double) from v_rollout) / 2.0, 6) as advantage {J}")
def gpg(t):
    return adv(t, "gpg", f_norm=2.0)


@query("rfpp_baseline", f"""
with c as (select event_id, score - m as x, response_tokens as w {J}),
s as (select sum(w * x) / sum(w) as m, sum(w) as n from c), v as (select sum(w * (x - s.m) ^ 2) / (any_value(s.n) - 1) as v from c, s)
select event_id, round((x - s.m) / sqrt(v.v + 1e-8), 6) as advantage from c, s, v
""")
def rfpp_baseline(t):
    return adv(t, "rfpp_baseline")


def token_arrays(t):
    """One row per sample group with its eight positions in order."""
    rows = F.array_sort(F.collect_list(F.struct("sample", "score", "mask", "baseline")))
    g = t.v_token.groupBy("uid").agg(rows.alias("r"))

    def field(name):
        return F.transform("r", lambda x: x[name].cast("double")).alias(name)

    return g.select("uid", field("score"), field("mask"), field("baseline"))


RECUR = """
with recursive t as (select uid, 8 - sample as n, sample, score, mask, baseline from v_token),
w(uid, n, sample, run, out, last, nxt) as (
  select distinct uid, cast(0 as bigint), cast(-1 as int), cast(0 as double), cast(0 as double), cast(0 as double), cast(0 as double) from t
  union all
  select t.uid, cast(t.n as bigint), t.sample, (t.score + 0.9 * w.run) * t.mask, t.score + 0.9 * w.run,
    (t.score + 0.9 * w.nxt - t.baseline + 0.9 * 0.8 * w.last) * t.mask + (1 - t.mask) * w.last, t.baseline * t.mask + (1 - t.mask) * w.nxt
  from w join t on t.uid = w.uid and t.n = w.n + 1)
"""


@query("discounted_return", RECUR + "select uid, sample as pos, round(out, 6) as returns from w where n > 0")
def discounted_return(t):
    out = token_arrays(t).select("uid", F.posexplode(L.discounted_return(F.col("score"), F.col("mask"), gamma=0.9)).alias("pos", "v"))
    return out.select("uid", "pos", F.round("v", 6).alias("returns"))


@query("gae", RECUR + "select uid, sample as pos, round(last, 6) as advantage from w where n > 0")
def gae(t):
    a = L.gae(F.col("score"), F.col("baseline"), F.col("mask"), gamma=0.9, lam=0.8)
    return token_arrays(t).select("uid", F.posexplode(a).alias("pos", "v")).select("uid", "pos", F.round("v", 6).alias("advantage"))


@query("whiten", """
select uid, sample, round((score - m) / sqrt(v + 1e-8), 6) as whitened from v_token, (select avg(score) as m, var_samp(score) as v from v_token where mask = 1) s
""")
def whiten(t):
    df = t.v_token
    return df.select("uid", "sample", F.round(L.whiten(df, value="score", mask="mask"), 6).alias("whitened"))


@query("remax", """
select uid, sample, round(sum(score * mask) over (partition by uid order by sample desc), 6) as returns, round(sum(score * mask) over (partition by uid order by sample desc) - baseline * mask, 6) as advantage from v_token
""")
def remax(t):
    out = L.remax(t.v_token, by="uid", pos="sample", reward="score", mask="mask", baseline="baseline")
    return out.select("uid", "sample", F.round("returns", 6).alias("returns"), F.round("advantage", 6).alias("advantage"))


@query("reweight", """
select event_id, round(score * score + 1e-8, 6) as pow_weight, case when score = hi or score = lo then 1.0::double else 0.0::double end as ends_weight, case when score = hi then 0.4::double else 0.1::double end as random_weight
from v_rollout, (select max(score) as hi, min(score) as lo from v_rollout) s
""")
def reweight(t):
    out = t.v_rollout.select("event_id", "score")
    for method, name in [("pow", "pow_weight"), ("max_min", "ends_weight"), ("max_random", "random_weight")]:
        out = L.reweight(out, method=method).withColumnRenamed("weight", name)
    return out.select("event_id", F.round("pow_weight", 6).alias("pow_weight"), F.round("ends_weight", 6).alias("ends_weight"), F.round("random_weight", 6).alias("random_weight"))


@query("resample", """
with w as (select event_id, round(value, 2) as wt, md5('0:' || event_id) as h from events),
c as (select event_id, wt, sum(cast(wt * 100 as bigint)) over (order by h, event_id) as hi from w),
d as (select cast('0x' || substr(md5('0:draw:' || event_id), 1, 8) as bigint) / 4294967296.0 * (select max(hi) from c) as d from events)
select event_id, count(*) as copies from d asof join c on d.d < c.hi group by 1
""")
def resample(t):
    # whole weights, so that sums are exact in any order
    w = t.events.select("event_id", F.round(F.round("value", 2) * 100).cast("bigint").cast("double").alias("weight"))
    return L.resample(w, key="event_id")


@query("overlong_penalty", """
select event_id, round(least(-(response_tokens - 6000) / 2000.0::double * 0.5, 0.0), 6) as penalty from v_rollout
""")
def overlong_penalty(t):
    p = L.overlong_penalty(F.col("response_tokens"), max_length=8000, buffer=2000, factor=0.5)
    return t.v_rollout.select("event_id", F.round(p, 6).alias("penalty"))


@query("data_metrics", """
select run_id, round(avg(score), 6) as score_mean, max(score) as score_max, min(score) as score_min, round(avg(response_tokens), 6) as response_tokens_mean, max(response_tokens) as response_tokens_max,
  min(response_tokens) as response_tokens_min, round(avg((response_tokens = 9643)::int), 6) as response_tokens_clip_ratio, round(1 - var_samp(score - turns / 9.0::double) / (var_samp(score) + 1e-5), 6) as explained_variance
from v_rollout group by 1
""")
def data_metrics(t):
    df = t.v_rollout.withColumn("v", F.col("turns") / F.lit(9.0))
    out = L.data_metrics(df, stats=["score", "response_tokens"], clip={"response_tokens": 9643}, values=("score", "v"), by=["run_id"])
    return out.select("run_id", "score_max", "score_min", "response_tokens_max", "response_tokens_min",
                      *[F.round(c, 6).alias(c) for c in ["score_mean", "response_tokens_mean", "response_tokens_clip_ratio", "explained_variance"]])


@query("reduce_by_name", """
select key, round(case when contains(key, 'max') then max(value) when contains(key, 'min') then min(value) else avg(value) end, 6) as value from (
  select concat(event_type, case when k < 30 then '/max' when k < 60 then '/min' else '/mean' end) as key, value from v_event) m group by 1
""")
def reduce_by_name(t):
    m = t.v_event.select(F.concat("event_type", F.expr("case when k < 30 then '/max' when k < 60 then '/min' else '/mean' end")).alias("key"), "value")
    return L.reduce_by_name(m).select("key", F.round("value", 6).alias("value"))


@query("throughput", """
with s as (select train_step, sum(response_tokens)::bigint as r, sum(response_tokens + 100)::bigint as a from v_step group by 1),
g as (select cast(user_id % 10 as int) as train_step, case when event_type in ('click', 'view') then 'gen' when event_type = 'error' then 'adv' else 'step' end as stage, round(sum(value), 2) as seconds from v_event group by 1, 2)
select g.train_step, stage, seconds, round(case when stage <> 'step' then seconds * 1000 / case when stage = 'gen' then r else a end else -1 end, 6) as ms_per_token, round(case when stage = 'step' then a / (seconds * 8) else -1 end, 6) as tokens_per_second
from g join s on s.train_step = g.train_step
""")
def throughput(t):
    tokens = t.v_step.select("train_step", "response_tokens", F.lit(100).alias("prompt_tokens"))
    stage = F.expr("case when event_type in ('click', 'view') then 'gen' when event_type = 'error' then 'adv' else 'step' end")
    timings = t.v_event.groupBy((F.col("user_id") % 10).cast("int").alias("train_step"), stage.alias("stage")).agg(F.round(F.sum("value"), 2).alias("seconds"))
    out = L.throughput(tokens, timings, by="train_step", workers=8)
    return out.select("train_step", "stage", "seconds", F.round(F.coalesce("ms_per_token", F.lit(-1.0)), 6).alias("ms_per_token"),
                      F.round(F.coalesce("tokens_per_second", F.lit(-1.0)), 6).alias("tokens_per_second"))


def long_values(t):
    return M.numeric_values(t.v_rollout, ["score", "turns", "event_type"], keys=["run_id", "uid"])


@query("mean_std_at_n", """
select run_id, variable, n, count(*) as prompts, round(avg(m), 6) as mean, round(avg(s), 6) as std from (
 select run_id, uid, 'score' as variable, count(*) as n, avg(score) as m, stddev_pop(score) as s from v_rollout group by 1, 2
 union all select run_id, uid, 'turns', count(*), avg(turns), stddev_pop(turns) from v_rollout group by 1, 2) p group by 1, 2, 3
""")
def mean_std_at_n(t):
    out = M.mean_std(long_values(t), source="run_id", prompt="uid")
    return out.select("run_id", "variable", "n", "prompts", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("best_worst_at_n", """
with o as (select uid, score as x, row_number() over (partition by uid order by score) as i from v_rollout),
m as (select uid, n, sum(x * ((i / 8.0::double) ^ n - ((i - 1) / 8.0::double) ^ n)) as best, sum(x * x * ((i / 8.0::double) ^ n - ((i - 1) / 8.0::double) ^ n)) as b2,
  sum(x * (((9 - i) / 8.0::double) ^ n - ((8 - i) / 8.0::double) ^ n)) as worst, sum(x * x * (((9 - i) / 8.0::double) ^ n - ((8 - i) / 8.0::double) ^ n)) as w2
  from o, (select unnest([2, 4, 8]) as n) ns group by 1, 2)
select uid, n, round(best, 6) as best_mean, round(sqrt(greatest(b2 - best * best, 0)), 5) as best_std, round(worst, 6) as worst_mean, round(sqrt(greatest(w2 - worst * worst, 0)), 5) as worst_std from m
""")
def best_worst_at_n(t):
    values = M.numeric_values(t.v_rollout, ["score"], keys=["uid"]).select("uid", "x")
    out = M.best_worst(values, keys=["uid"])
    return out.select("uid", "n", F.round("best_mean", 6).alias("best_mean"), F.round("best_std", 5).alias("best_std"),
                      F.round("worst_mean", 6).alias("worst_mean"), F.round("worst_std", 5).alias("worst_std"))


@query("majority_vote_at_n", """
with num as (select uid, event_type, score, row_number() over (partition by uid order by md5('0:' || sample), sample) as i, count(*) over (partition by uid) as n from v_rollout),
slot as (select distinct uid, n, draw, s from num, (select unnest(range(1, 21)) as draw) d, (select unnest(range(1, 5)) as s) e),
pick as (select uid, draw, s, cast(floor(cast('0x' || substr(md5('0:' || uid || ':' || draw || ':' || s), 1, 8) as bigint) / 4294967296.0 * n) + 1 as bigint) as i from slot),
vote as (select p.uid, draw, event_type, count(*) as votes, min(s) as first, min_by(score, s) as v from pick p join num on num.uid = p.uid and num.i = p.i group by 1, 2, 3),
win as (select uid, draw, v from (select *, row_number() over (partition by uid, draw order by votes desc, first) as r from vote) x where r = 1)
select uid, round(avg(v), 6) as maj_mean, round(stddev_pop(v), 6) as maj_std from win group by 1
""")
def majority_vote_at_n(t):
    out = M.majority_vote(t.v_rollout, keys=["uid"], sample="sample", pred="event_type", value="score", n=4, draws=20)
    return out.select("uid", F.round("maj_mean", 6).alias("maj_mean"), F.round("maj_std", 6).alias("maj_std"))


@query("score_by_source", """
select event_type as source, round(avg(m), 6) as test_score, count(*) as items from (select event_type, user_id, avg(value) as m from events group by 1, 2) i group by 1
""")
def score_by_source(t):
    out = M.score_by_source(t.events, source="event_type", item="user_id", score="value")
    return out.select(F.col("event_type").alias("source"), F.round("test_score", 6).alias("test_score"), "items")


DEAL = """
select doc_id, n_chars, cast(case when m < {k} then m else 2 * {k} - 1 - m end as {type}) as bin from (
  select doc_id, n_chars, (row_number() over (order by n_chars desc, doc_id) - 1) % (2 * {k}) as m from documents) r
"""


@query("balance_by_length", "select doc_id, bin from (" + DEAL.format(k=16, type="int") + ") d")
def balance_by_length(t):
    return P.balance_by_length(t.documents.select("doc_id", "n_chars"), key="doc_id", length="n_chars", k=16).select("doc_id", "bin")


# one document a step goes to the first bin that holds it
@query("pack_micro_batches", """
with recursive items as (select doc_id, n_chars as size, row_number() over (order by n_chars desc, doc_id) as i from documents),
steps(i, loads, bin) as (
  select 0::bigint, []::bigint[], 0::bigint
  union all
  select n.i, case when n.b > len(n.loads) then list_append(n.loads, n.size) else n.loads[:n.b - 1] || [n.loads[n.b] + n.size] || n.loads[n.b + 1:] end, n.b
  from (select x.i, x.size, s.loads, coalesce(list_position(list_transform(s.loads, lambda l: l + x.size <= 200000), true), len(s.loads) + 1)::bigint as b
        from steps s join items x on x.i = s.i + 1) n)
select doc_id, bin - 1 as bin, (select max(bin) from steps) as bin_count from items join steps using (i)
""")
def pack_micro_batches(t):
    return P.pack_micro_batches(t.documents.select("doc_id", "n_chars"), key="doc_id", length="n_chars", max_tokens=200000).select("doc_id", "bin", "bin_count")


# four lengths fill most of the bins: hot lengths, and the bounds on bins and their number
@query("pack_micro_batches_check", """
select count(*) as n_rows, sum(l_quantity)::bigint as total, 0::bigint as above_limit, 0::bigint as empty_bins, ceil(sum(l_quantity) / 64.0)::bigint as least_bins, true as few_bins from lineitem
""")
def pack_micro_batches_check(t):
    lines = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("size"))
    packed = P.pack_micro_batches(lines, key="line", length="size", max_tokens=64)
    bins = packed.groupBy("bin", "bin_count").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    least = F.ceil(F.sum("size") / 64).cast("bigint")
    return bins.agg(F.sum("n").alias("n_rows"), F.sum("size").alias("total"), F.count_if(F.col("size") > 64).alias("above_limit"), (F.max("bin_count") - F.count("*")).alias("empty_bins"),
                    least.alias("least_bins"), (F.max("bin_count") <= 11 * least / 9 + 1).alias("few_bins"))


@query("imbalance_report", """
with d as (""" + DEAL.format(k=16, type="bigint") + """), u as (select 'dealt' as binning, bin, n_chars from d union all select 'by_id', doc_id % 16, n_chars from documents)
select binning, count(*) as bins, min(t) as min_total, max(t) as max_total, max(t) - min(t) as spread from (select binning, bin, sum(n_chars)::bigint as t from u group by 1, 2) x group by 1
""")
def imbalance_report(t):
    dealt = P.balance_by_length(t.documents.select("doc_id", "n_chars"), key="doc_id", length="n_chars", k=16)
    return P.imbalance_report(dealt.withColumn("raw", F.col("doc_id") % 16), bins={"dealt": "bin", "by_id": "raw"}, length="n_chars")
