"""R: streaming jobs over the events table; each drains into a table that is read back."""

from pyspark.sql import functions as F

from cartlight.plans.registry import query, view
from cartlight.plans.sources_queries import dump
from cartlight.session import work_path
from cartlight.streaming import jobs as R


def event_stream(t):
    """The events file as a stream; event time is UTC."""
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sample_stream(t):
    return event_stream(t).select(F.floor(F.col("event_id") / 8).cast("bigint").alias("uid"), "ts", (F.col("event_type") == "purchase").cast("int").alias("outcome"))


@query("stream_rollouts", """
select 'valid' as outcome, count(*) as n from v_event where k < 97 union all select 'half_written', count(*) from v_event where k >= 97
""")
def stream_rollouts(t):
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(F.col("k") >= 97, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    path = dump(t, t.v_event.withColumn("line", line).select(cut.alias("value")).repartition(4), "text")
    rows = R.stream_rollouts(t.spark, path, "event_id bigint, event_type string, value double", max_files=2)
    good, bad = work_path(t.spark, "good"), work_path(t.spark, "bad")
    R.start_split(rows, good, bad, checkpoint=work_path(t.spark, "ck")).awaitTermination()
    n = F.count("*").alias("n")
    return t.spark.read.parquet(good).agg(F.lit("valid").alias("outcome"), n).unionAll(t.spark.read.parquet(bad).agg(F.lit("half_written").alias("outcome"), n))


@query("stream_group_completion", """
select uid, count(*)::int as samples, sum(outcome)::int as successes, case when max(outcome) = 0 then 'all_fail' when min(outcome) = 1 then 'all_success' else 'mixed' end as state from v_rollout group by 1
""")
def stream_group_completion(t):
    return R.run_to_table(R.stream_group_completion(sample_stream(t)), "groups")


view("x_stream_group", """
select floor(event_id / 8) as uid, min(case when event_type = 'purchase' then 1 else 0 end) as lo, max(case when event_type = 'purchase' then 1 else 0 end) as hi from events group by floor(event_id / 8)
""")
# batches arrive by quarters of the uids
FILLED = """
with b as (select uid, lo, hi, floor(uid * 4 / (select max(uid) + 1 from x_stream_group)) as batch from x_stream_group),
m as (select batch, sum(count(*) filter (lo < hi)) over (order by batch) - count(*) filter (lo < hi) as before from b group by batch),
seen as (select b.* from b join m on m.batch = b.batch and m.before < 100)
"""


def filled(t):
    """Groups in four batches by uid, taken until 100 mixed ones are accepted."""
    groups = R.run_to_table(R.stream_group_completion(sample_stream(t)), "groups")
    path = work_path(t.spark, "group-batches")
    quarter = F.floor(F.col("uid") * 4 / (groups.agg(F.max("uid") + 1).scalar()))
    for i in range(4):
        groups.filter(quarter == i).coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(groups.schema).option("maxFilesPerTrigger", 1).parquet(path)
    accepted, ledger = work_path(t.spark, "accepted"), work_path(t.spark, "ledger")
    R.fill_mixed_batch(stream, accepted, ledger, checkpoint=work_path(t.spark, "ck"), target=100, order=["uid"])
    return accepted, ledger


@query("stream_mixed_batch", FILLED + """
select count(*) as generated, least(count(*) filter (lo < hi), 100) as accepted, count(*) filter (lo < hi) as mixed, count(*) filter (hi = 0) as all_fail, count(*) filter (lo = 1) as all_success,
  round(avg((lo < hi)::int), 6) as acceptance_rate, count(*) filter (lo < hi) >= 100 as done from seen
""")
def stream_mixed_batch(t):
    out = R.ledger_progress(t.spark, filled(t)[1])
    return out.select("generated", "accepted", "mixed", "all_fail", "all_success", F.round("acceptance_rate", 6).alias("acceptance_rate"), "done")


@query("stream_mixed_groups", "select cast(uid as bigint) as uid from x_stream_group where lo < hi order by uid limit 100")
def stream_mixed_groups(t):
    return R.accepted_groups(t.spark, *filled(t)).select("uid")


@query("stream_dedupe", "select distinct user_id from events")
def stream_dedupe(t):
    return R.run_to_table(R.stream_dedupe(event_stream(t).select("user_id", "ts"), key="user_id", delay="60 days").select("user_id"), "dedupe")


def health(t, **options):
    rows = event_stream(t).select("ts", "user_id", (F.col("event_type") == "error").alias("failed"))
    out = R.run_to_table(R.stream_health(rows, max_failure_rate=0.2, **options), "health")
    return out.select(*options.get("by", []), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "failures", F.round("failure_rate", 6).alias("failure_rate"), "above_gate")


# windows that end after the last watermark stay open
CLOSED = "(select max(ts) - interval 1 hour from events)"


@query("stream_health", f"""
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, count(*) filter (event_type = 'error') as failures, round(avg((event_type = 'error')::int), 6) as failure_rate,
  avg((event_type = 'error')::int) > 0.2 as above_gate from events group by date_trunc('day', ts) having date_trunc('day', ts) + interval 1 day <= {CLOSED}
""")
def stream_health(t):
    return health(t)


@query("stream_health_sliding", f"""
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, count(*) filter (event_type = 'error') as failures, round(avg((event_type = 'error')::int), 6) as failure_rate, avg((event_type = 'error')::int) > 0.2 as above_gate
from (select event_type, time_bucket(interval 12 hours, ts, timestamp '2024-01-01') - i * interval 12 hours as w from events, (select unnest([0, 1]) as i) u) x group by w having w + interval 1 day <= {CLOSED}
""")
def stream_health_sliding(t):
    return health(t, slide="12 hours")


@query("stream_health_session", f"""
with g as (select user_id, ts, event_type, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as s from events),
n as (select *, sum(s) over (partition by user_id order by ts) as sid from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, count(*) filter (event_type = 'error') as failures, round(avg((event_type = 'error')::int), 6) as failure_rate, avg((event_type = 'error')::int) > 0.2 as above_gate
from n group by user_id, sid having max(ts) + interval 6 hours <= {CLOSED}
""")
def stream_health_session(t):
    return health(t, session_gap="6 hours", by=["user_id"])
