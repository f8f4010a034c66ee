"""Readers on hand-made files, and streaming jobs over several batches."""

import hashlib
import os
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Row
from pyspark.sql import functions as F

from cartlight.operators.groups import group_state
from cartlight.sources import files as A
from cartlight.streaming import jobs as R


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_step_dumps_take_the_step_from_the_name(spark, tmp_path):
    for step in (3, 12):
        write(tmp_path / "dump" / f"{step}.jsonl", "".join(f'{{"score": {step + i}}}\n' for i in range(2)))
    rows = A.read_step_dumps(spark, str(tmp_path / "dump"), "score int").collect()
    assert sorted((r.dump_step, r.score) for r in rows) == [(3, 3), (3, 4), (12, 12), (12, 13)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(4000)]
    path = write(tmp_path / "big.txt", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = A.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = {r.line_no: r.value for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(lines))
    kept = A.line_subset(spark, path, limit=15)
    assert sorted(r.line_no for r in kept.collect()) == [i for i in range(15) if i % 7]


def test_half_written_line_is_set_apart(spark, tmp_path):
    path = write(tmp_path / "live.jsonl", '{"a": 1}\n\n{"a": 2}\n{"a": ')
    good, bad = A.read_tolerant(spark, path, "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ['{"a": ']


def test_metric_log(spark, tmp_path):
    text = "\u001b[36m(worker)\u001b[0m [step 3] actor/kl=0.5, loss=inf, note, x=y=2\nno step here\n[step 4] actor/kl=nan, t=1e3\n"
    df = spark.read.text(write(tmp_path / "run.log", text))
    assert sorted((r.step, r.key, r.value) for r in A.parse_metric_log(df).collect()) == [(3, "actor/kl", 0.5), (3, "x=y", 2.0), (4, "t", 1000.0)]


def test_sink_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    A.write_table(df, str(tmp_path / "out"), fmt="csv")
    try:
        A.write_table(df, str(tmp_path / "out"), fmt="csv")
        raise AssertionError("expected a refusal")
    except Exception as exc:
        assert "exists" in str(exc).lower()
    A.write_table(df, str(tmp_path / "out"), fmt="csv", force=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_manifest(spark, tmp_path):
    import hashlib

    body = '{"a": 1}\n\n{"a": 2}\n'
    write(tmp_path / "m" / "0.jsonl", body)
    row = A.file_manifest(spark, str(tmp_path / "m")).first()
    assert (row.rows, row.bytes, row.sha256) == (2, len(body), hashlib.sha256(body.encode()).hexdigest())


def test_rollout_lines(spark, tmp_path):
    step = '{"prompt": [], "completion": {"content": "c%d", "message": {"tool_call": [{"name": "n", "parameters": {"page": 2}}]}}, "extra_info": {"step": %d, "query": "q"}}'
    text = "[" + ",".join(step % (i, i) for i in range(3)) + "]\n\n[" + step % (9, 9) + "]\n"
    rows = A.read_rollouts(spark, write(tmp_path / "r.jsonl", text)).orderBy("line_no", "pos").collect()
    assert [(r.line_no, r.pos, r.step.completion.content) for r in rows] == [(0, 0, "c0"), (0, 1, "c1"), (0, 2, "c2"), (2, 0, "c9")]
    assert rows[0].step.completion.message.tool_call[0].parameters == {"page": "2"}


def test_ranges(spark):
    df = spark.range(1, 30).withColumnRenamed("id", "line_no")
    assert [r.line_no for r in A.select_ranges(df, "1-3, 9,20-21").collect()] == [1, 2, 3, 9, 20, 21]


def batches(spark, path, frames):
    """Parquet files with growing modification times, one per batch."""
    os.makedirs(path)
    for i, rows in enumerate(frames):
        pdf = pd.DataFrame(rows, columns=["uid", "ts", "outcome"])
        pdf["ts"] = pd.to_datetime(pdf["ts"], utc=True).astype("datetime64[us, UTC]")
        name = f"{path}/{i}.parquet"
        pdf.to_parquet(name)
        at = time.time() - 1000 + i * 10
        os.utime(name, (at, at))
    return spark.readStream.schema("uid bigint, ts timestamp, outcome bigint").option("maxFilesPerTrigger", 1).parquet(path)


def test_groups_complete_over_batches_and_short_ones_expire(spark, tmp_path):
    frames = [
        [(1, "2024-01-01 00:00", 0)] * 5 + [(2, "2024-01-01 00:00", 1)] * 3,
        [(1, "2024-01-01 00:05", 1)] * 3 + [(3, "2024-01-01 00:05", 0)] * 8,
        [(4, "2024-01-02 00:00", 1)] * 8,
        [(4, "2024-01-03 00:00", 1)],
    ]
    stream = batches(spark, str(tmp_path / "in"), frames)
    out = R.run_to_table(R.stream_group_completion(stream, timeout_ms=3_600_000), "test-groups")
    got = {r.uid: (r.samples, r.successes, r.state) for r in out.collect()}
    assert got == {1: (8, 3, "mixed"), 2: (3, 3, "expired"), 3: (8, 0, "all_fail"), 4: (8, 8, "all_success")}


def test_stream_end_state_equals_batch(spark, tables):
    from cartlight.plans.streaming_queries import sample_stream

    got = R.run_to_table(R.stream_group_completion(sample_stream(tables)), "test-groups")
    want = group_state(tables.v_rollout, by=["uid"]).select("uid", F.col("samples").cast("int"), F.col("successes").cast("int"), "state")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def group_files(path, batches):
    """One file a batch, in order of their times."""
    schema = pa.schema([("uid", pa.int64()), ("state", pa.string())])
    os.makedirs(path, exist_ok=True)
    for rows in batches:
        i = len([n for n in os.listdir(path) if n.endswith(".parquet")])
        pq.write_table(pa.table({"uid": [u for u, _ in rows], "state": [s for _, s in rows]}, schema), f"{path}/{i:03d}.parquet")
        os.utime(f"{path}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


M, W, L = "mixed", "all_success", "all_fail"
BATCHES = [[(1, M), (2, L), (3, M)], [(9, M), (8, M), (7, W), (6, M)], [(10, M), (11, M)]]


def fill(spark, tmp, target, checkpoint="ck"):
    stream = spark.readStream.schema("uid long, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp / "groups"))
    done = R.fill_mixed_batch(stream, str(tmp / "accepted"), str(tmp / "ledger"), checkpoint=str(tmp / checkpoint), target=target, order=["uid"])
    row = R.ledger_progress(spark, str(tmp / "ledger")).first()
    assert row.done == done
    return done, row.generated, row.mixed, sorted(r.uid for r in R.accepted_groups(spark, str(tmp / "accepted"), str(tmp / "ledger")).collect())


def test_stream_ends_at_its_target(spark, tmp_path):
    """The second batch is cut in order, the third is not touched; a larger target goes on with the third."""
    group_files(tmp_path / "groups", BATCHES)
    for _ in range(2):  # a restart neither adds nor loses one
        assert fill(spark, tmp_path, 4) == (True, 7, 5, [1, 3, 6, 8])
    assert fill(spark, tmp_path, 5) == (True, 9, 7, [1, 3, 6, 8, 10])


def test_stream_waits_for_more_groups(spark, tmp_path):
    group_files(tmp_path / "groups", BATCHES[:1])
    assert fill(spark, tmp_path, 4) == (False, 3, 2, [1, 3])
    group_files(tmp_path / "groups", BATCHES[1:])
    assert fill(spark, tmp_path, 4) == (True, 7, 5, [1, 3, 6, 8])


def test_replayed_batches_replace_themselves(spark, tmp_path):
    """A fresh checkpoint runs all batches again into the same tables; one that was lost half-way runs again alike."""
    group_files(tmp_path / "groups", BATCHES)
    assert fill(spark, tmp_path, 4) == (True, 7, 5, [1, 3, 6, 8])
    assert fill(spark, tmp_path, 4, "fresh") == (True, 7, 5, [1, 3, 6, 8])
    assert fill(spark, tmp_path, 6, "other") == (True, 9, 7, [1, 3, 6, 8, 9, 10])


def test_closed_groups_leave_the_state(spark, tmp_path):
    day = pd.Timestamp("2024-01-01")
    frames = [pd.DataFrame({"uid": np.repeat(np.arange(50), 2), "ts": day, "outcome": 1})]
    frames += [pd.DataFrame({"uid": [1000 + i], "ts": [day + pd.Timedelta(days=i)], "outcome": [0]}) for i in range(1, 5)]
    stream = batches(spark, str(tmp_path / "in"), frames)
    query = R.start_append(R.stream_group_completion(stream, group_size=2, timeout_ms=3_600_000), str(tmp_path / "out"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] <= 8
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.uid < 50 and r.state == "all_success" for r in rows) == 50 and len({r.uid for r in rows}) == len(rows)



def test_manifest_of_nested_files(spark, tmp_path, monkeypatch):
    """Equal base names, an empty file, blank lines, odd names, no line end, lines across chunks."""
    texts = {"a/x.json": "1\n", "b/x.json": "1\n\n \t\r\n2", "b/c d%20/x.json": "é" * 50 + "\n\n" + "z" * 30 + "\n", "e.json": "", "n.json": "\n\n", "skip.txt": "1\n"}
    for name, text in texts.items():
        write(tmp_path / "m" / name, text)
    for chunk in (8 << 20, 7):
        monkeypatch.setattr(A, "CHUNK", chunk)
        for name, text in texts.items():
            raw = text.encode()
            assert A._digest(f"file:{tmp_path}/m/{name}") == (hashlib.sha256(raw).hexdigest(), sum(bool(x.strip()) for x in raw.split(b"\n")), len(raw))
    got = {r.file.split("/m/")[1]: (r.rows, r.bytes) for r in A.file_manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {"a/x.json": (1, 2), "b/x.json": (2, 8), "b/c d%20/x.json": (2, 133), "e.json": (0, 0), "n.json": (0, 2)}


def test_group_state_takes_rows_and_three_calls():
    """A key is one read, one timer and one write of the state; timers are not listed and no frame is built."""

    class State:
        held, calls = None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def registerTimer(self, at):
            self.calls.append(at)

        def getCurrentWatermarkInMs(self):
            return 500

    state, job = State(), R.GroupCompletion(3, 1000)
    job.init(state)
    rows = [Row(ts_ms=m, outcome=o) for m, o in ((100, 1), (900, None), (None, 0), (50, 1))]
    assert [*job.handleInputRows((7,), iter(rows[:2]), state)] == [] and state.calls == ["get", 1900, "update"]
    assert [*job.handleInputRows((7,), iter(rows[2:3]), state)] == [Row(uid=7, samples=3, successes=1, state="mixed")]
    assert [*job.handleInputRows((7,), iter(rows[3:]), state)] == [] and state.calls == ["get", 1900, "update", "get", "update", "get"] and state.held == (3, 1, True)
