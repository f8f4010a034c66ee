"""A: scans, sources, sinks. Files are derived from the tables and written to the shared folder."""

from pyspark.sql import functions as F

from cartlight.plans.registry import query, view
from cartlight.session import work_path
from cartlight.sources import files as A

EVENT = "event_id bigint, user_id bigint, event_type string, value double, props string"


def dump(t, df, fmt="json", **options):
    """Write a derived table below the shared folder and return its path."""
    path = work_path(t.spark, "derived")
    writer = df.write.format(fmt)
    for k, v in options.items():
        writer = writer.partitionBy(v) if k == "partition_by" else writer.option(k, v)
    writer.save(path)
    return path


def event_rows(t):
    return t.events.select("event_id", "user_id", "event_type", "value", "props")


@query("read_jsonl", "select event_id, user_id, event_type, value, props from events")
def read_jsonl(t):
    return A.read_jsonl(t.spark, dump(t, event_rows(t)), EVENT)


@query("read_catalog", "select product_id, title, price, sold_count from v_product")
def read_catalog(t):
    docs = t.v_product.select(F.col("product_id").alias("id"), F.col("title").alias("contents"), F.struct("product_id", "title", "price", "sold_count").alias("product"))
    path = dump(t, docs, compression="gzip")
    return A.read_catalog(t.spark, path, partitions=8).select("product_id", "title", "price", "sold_count")


@query("read_rollouts", """
select traj_id, name, count(*) as n, min(pos) as first_pos from (select traj_id, name, row_number() over (partition by traj_id order by step, pos) - 1 as pos from v_calls) c group by 1, 2
""")
def read_rollouts(t):
    one = F.struct("step", "pos", "name")
    rows = t.v_calls.groupBy("traj_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    text = rows.select(F.to_json(F.transform("s", lambda x: F.struct(F.struct(
        F.concat(F.lit("traj "), F.col("traj_id").cast("string")).alias("query")).alias("extra_info"),
        F.struct(x["name"].alias("content")).alias("completion")))).alias("value"))
    steps = A.read_rollouts(t.spark, dump(t, text, "text"))
    out = steps.select(F.substring_index("step.extra_info.query", " ", -1).cast("bigint").alias("traj_id"), F.col("step.completion.content").alias("name"), "pos")
    return out.groupBy("traj_id", "name").agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


@query("read_step_dumps", "select train_step as dump_step, count(*) as n, sum(outcome)::bigint as won from v_step group by 1")
def read_step_dumps(t):
    path = dump(t, t.v_step.select("train_step", "uid", "outcome").repartition("train_step"), partition_by="train_step")
    rows = A.read_step_dumps(t.spark, path, "uid bigint, outcome int", pattern=r"train_step=(\d+)/")
    return rows.groupBy("dump_step").agg(F.count("*").alias("n"), F.sum("outcome").alias("won"))


@query("read_tolerant", """
select 'valid' as outcome, count(*) as n, sum(event_id)::bigint as id_sum from v_event where k < 97 union all select 'half_written', count(*), 0 from v_event where k >= 97
""")
def read_tolerant(t):
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.when(F.col("k") >= 97, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    path = dump(t, t.v_event.withColumn("line", line).select(cut.alias("value")), "text")
    good, bad = A.read_tolerant(t.spark, path, "event_id bigint, event_type string, value double")
    return good.agg(F.lit("valid").alias("outcome"), F.count("*").alias("n"), F.sum("event_id").alias("id_sum")).unionAll(
        bad.agg(F.lit("half_written").alias("outcome"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("id_sum")))


@query("read_parquet_concat", """
select event_id, coalesce(value, -1) as value, coalesce(user_id, -1) as user_id from (
select event_id, value, null as user_id from events where event_type = 'view' union all select event_id, null, user_id from events where event_type <> 'view') u
""")
def read_parquet_concat(t):
    a = dump(t, t.events.filter("event_type = 'view'").select("event_id", "value"), "parquet")
    b = dump(t, t.events.filter("event_type <> 'view'").select("event_id", "user_id"), "parquet")
    return A.read_parquet_concat(t.spark, [a, b]).select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query("parse_metric_log", """
select event_id, cast(step as int) as step, 'actor/value' as key, value from (select event_id, traj_id % 50 as step, value, k from v_event) e
union all select event_id, cast(step as int), 'size=large', cast(k as double) from (select event_id, traj_id % 50 as step, k from v_event where k % 10 <> 0) e
""")
def parse_metric_log(t):
    esc = "\u001b[32m"
    line = F.concat(F.lit("INFO " + esc + "[step "), (F.col("traj_id") % 50).cast("string"), F.lit("]\u001b[0m actor/value="), F.col("value").cast("string"),
                    F.lit(", size=large="), F.when(F.col("k") % 10 == 0, "nan").otherwise(F.col("k").cast("string")), F.lit(", note, bad=x"))
    logs = t.v_event.select("event_id", line.alias("value"))
    return A.parse_metric_log(logs).select("event_id", "step", "key", "value")


@query("write_table")
def write_table(t):
    base = t.events.select("event_id", "event_type", "value")
    out = None
    for fmt in ("json", "parquet", "csv"):
        path = work_path(t.spark, "sink")
        A.write_table(base, path, fmt=fmt)
        reader = t.spark.read.schema("event_id bigint, event_type string, value double").option("header", "true")
        part = reader.format(fmt).load(path).agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        out = part if out is None else out.unionAll(part)
    return out


# a folder an event type: lines in event order, every ninth one blank
@query("file_manifest", """
with l as (select event_type, event_id, case when event_id % 9 = 4 then ' ' else event_id || ',' || user_id end as line from events)
select event_type, count(*) filter (trim(line) <> '') as rows, sum(length(line) + 1)::bigint as bytes, sha256(string_agg(line || chr(10), '' order by event_id)) as sha256 from l group by 1
""")
def file_manifest(t):
    line = F.when(F.col("event_id") % 9 == 4, " ").otherwise(F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string")))
    lines = t.events.select("event_type", "event_id", line.alias("value")).repartition("event_type").sortWithinPartitions("event_type", "event_id")
    path = dump(t, lines.select("event_type", "value"), "text", partition_by="event_type")
    return A.file_manifest(t.spark, path, glob="*.txt").select(F.regexp_extract("file", "event_type=([^/]*)/", 1).alias("event_type"), "rows", "bytes", "sha256")


def ordered_text(t):
    """One text file per row range, lines in event order; every ninth line is blank."""
    line = F.when(F.col("event_id") % 9 == 4, "").otherwise(F.concat_ws(",", F.col("event_id").cast("string"), "event_type"))
    return dump(t, t.events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(line.alias("value")), "text")


@query("line_subset")
def line_subset(t):
    out = A.line_subset(t.spark, ordered_text(t), limit=50)
    return out.select("line_no", F.split_part("value", F.lit(","), F.lit(1)).cast("bigint").alias("event_id"))


@query("resume_pending", """
select user_id, min(event_id) as event_id from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 80) group by 1
""")
def resume_pending(t):
    done = t.events.filter("event_type = 'purchase' and value > 80").select("user_id")
    return A.resume_pending(t.events, done, query="user_id", order="event_id")


@query("row_align_check", """
select event_id as line_no, case when k < 99 then event_type else '-' end as left_key, case when k > 0 then case when k % 40 = 7 then 'swapped' else event_type end else '-' end as right_key
from v_event where k = 99 or k = 0 or k % 40 = 7
""")
def row_align_check(t):
    left = t.v_event.filter("k < 99").select(F.col("event_id").alias("line_no"), "event_type")
    right = t.v_event.filter("k > 0").select(F.col("event_id").alias("line_no"), F.when(F.col("k") % 40 == 7, "swapped").otherwise(F.col("event_type")).alias("event_type"))
    return A.row_align_check(left, right, key="event_type").na.fill("-")


view("v_metric_row", "select cast(user_id % 10 as int) as step, event_type as key, round(avg(value), 4) as value from events group by 1, 2")


@query("metrics_wide", """
select step, max(value) filter (key = 'click') as click, max(value) filter (key = 'error') as error, max(value) filter (key = 'purchase') as purchase, max(value) filter (key = 'signup') as signup, max(value) filter (key = 'view') as view
from v_metric_row group by 1
""")
def metrics_wide(t):
    return A.metrics_wide(t.v_metric_row)


@query("run_metadata", """
select distinct run_id, temperature_code / 10.0::double * 10 / case when temperature_code = 0 then 1 else 10 end as temperature, 0.9::double as top_p, seed::double as seed, 8.0::double as group_size from v_rollout
""".replace("temperature_code / 10.0::double * 10 / case when temperature_code = 0 then 1 else 10 end", "temperature_code / 10.0::double"))
def run_metadata(t):
    return A.run_metadata(t.v_rollout.select("run_id").distinct(), name="run_id")


@query("select_ranges", "select event_id from events where event_id between 10 and 500 or event_id = 7 or event_id between 600 and 900")
def select_ranges(t):
    return A.select_ranges(t.events.select("event_id"), "10-500, 7,600-900", line="event_id")


@query("range_rows", "select traj_id, unnest(range(least(a, b), greatest(a, b) + 1)) as line_no from (select traj_id, min(k) as a, max(k) as b from v_event group by 1) x union select traj_id, cast(200 as bigint) from v_event")
def range_rows(t):
    sets = t.v_event.groupBy("traj_id").agg(F.concat(F.min("k").cast("string"), F.lit("-"), F.max("k").cast("string"), F.lit(", 200,")).alias("r"))
    return A.range_rows(sets, text="r")


@query("last_rollout_per_query", "select user_id, max(event_id) as line_no from events group by 1")
def last_rollout_per_query(t):
    rows = t.events.select("user_id", F.col("event_id").alias("line_no"))
    return A.last_rollout_per_query(rows, query="user_id", order=[F.col("line_no")])
