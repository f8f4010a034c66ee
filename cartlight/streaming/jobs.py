"""Live monitoring of append-only rollout files (R family).

Every job writes to files below the shared folder and keeps its progress in a
checkpoint there, so a restarted job continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cartlight.functions.ranking import ordered_sum
from cartlight.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_rollouts(spark: SparkSession, path: str, schema: str, *, max_files: int = 100) -> DataFrame:
    """New dump files as rows; a half-written line is kept in ``_corrupt_record``."""
    return (
        spark.readStream.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )


def start_append(df: DataFrame, path: str, *, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append a stream to parquet files, exactly once."""
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_split(df: DataFrame, good_path: str, bad_path: str, *, checkpoint: str) -> StreamingQuery:
    """Valid rows to one table, corrupt lines to a side table.

    Each batch writes its own folder, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        bad = F.col("_corrupt_record").isNotNull()
        batch.filter(~bad).drop("_corrupt_record").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.filter(bad).select("_corrupt_record").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GroupCompletion(StatefulProcessor):
    """Counts a group's samples and wins; emits once complete, or on expiry.

    A closed group stays known until its timer, so that a late sample is not
    taken for a new group, and then leaves the state like any other.
    """

    def __init__(self, group_size: int, timeout_ms: int):
        self.group_size = group_size
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "n int, wins int, closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a key in the state has its timer, which is set with its first rows and takes it out: no call to look for one
        known = self.state.get()
        n, wins, closed = known or (0, 0, False)
        if closed:
            return iter([])
        latest = 0
        for row in rows:
            n += 1
            wins += row.outcome or 0
            if row.ts_ms is not None:
                latest = max(latest, row.ts_ms)
        if known is None:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms)
        full = n >= self.group_size
        self.state.update((n, wins, full))
        return iter([self._row(key, n, wins, False)] if full else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, wins, closed = self.state.get()
        self.state.clear()
        return iter([] if closed else [self._row(key, n, wins, True)])

    def close(self) -> None:
        pass

    def _row(self, key, n: int, wins: int, expired: bool) -> Row:
        state = "expired" if expired else "all_fail" if wins == 0 else "all_success" if wins == n else "mixed"
        return Row(uid=key[0], samples=n, successes=wins, state=state)


def stream_group_completion(
    rows: DataFrame, *, group_size: int = 8, delay: str = "10 minutes", timeout_ms: int = 3_600_000
) -> DataFrame:
    """State of a group once its samples have arrived; short groups expire.

    ``rows``: uid, ts, outcome. The state of a key is three numbers, in the
    RocksDB store, so hot keys cost the same as any other; every key leaves
    the state ``timeout_ms`` of event time after its first samples. A sample
    that comes later still counts for a new group.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # rows, not a frame a key: groups are short, and a frame costs more than all else that is done for one
    keyed = rows.select("uid", "ts", "outcome", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")).withWatermark("ts", delay).groupBy("uid")
    return keyed.transformWithState(
        statefulProcessor=GroupCompletion(group_size, timeout_ms),
        outputStructType="uid bigint, samples int, successes int, state string",
        outputMode="Append",
        timeMode="EventTime",
    )


TARGET_MET = "the ledger has met its target"


def _earlier(spark: SparkSession, ledger: str, batch_id: int) -> int:
    """Groups accepted in the batches before this one."""
    try:
        rows = spark.read.option("basePath", ledger).parquet(ledger).filter(F.col("batch") < batch_id)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return rows.agg(F.coalesce(F.sum("accepted"), F.lit(0))).first()[0]


def fill_mixed_batch(groups: DataFrame, accepted: str, ledger: str, *, checkpoint: str, target: int, order: list[str]) -> bool:
    """Takes mixed groups from a stream until ``target`` of them are accepted; whether they are.

    Runs over what the stream has now and returns. Every batch writes its
    mixed groups below ``accepted`` and a row of counts below ``ledger``; the
    batch that meets the target is cut to the groups still needed, in
    ``order``, whose last column must make it total. The batch after it is
    refused before anything of it is written or committed, which ends the
    query: a later call with a larger target starts with that batch. Both
    tables are partitioned by batch number, and a batch counts only the rows
    before its own, so one that runs again replaces itself: a restart neither
    adds nor loses a group.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        remaining = target - _earlier(spark, ledger, batch_id)
        if remaining <= 0:
            raise RuntimeError(TARGET_MET)
        batch = batch.persist()
        states = [F.count_if(F.col("state") == s).alias(s) for s in ("all_fail", "mixed", "all_success")]
        counts = batch.agg(F.count("*").alias("generated"), *states)
        n_mixed = counts.first()["mixed"]
        mixed = batch.filter("state = 'mixed'")
        if n_mixed > remaining:
            number = ordered_sum(mixed, [F.col(c) for c in order], name="_place")
            mixed = number.filter(F.col("_place") <= remaining).drop("_place")
        mixed.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        # the ledger comes last: a batch without its row runs again
        row = counts.withColumns({"accepted": F.lit(min(n_mixed, remaining)).cast("bigint"), "target": F.lit(target).cast("bigint")})
        row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
        batch.unpersist()

    query = groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if TARGET_MET not in str(error):
            raise
    return _earlier(groups.sparkSession, ledger, 1 << 62) >= target


def accepted_groups(spark: SparkSession, accepted: str, ledger: str) -> DataFrame:
    """The accepted groups of the batches that the ledger lists."""
    return spark.read.option("basePath", accepted).parquet(accepted).join(F.broadcast(spark.read.option("basePath", ledger).parquet(ledger).select("batch")), "batch")


def ledger_progress(spark: SparkSession, ledger: str) -> DataFrame:
    """Totals of the ledger, share of mixed groups and whether the target is met."""
    rows = spark.read.option("basePath", ledger).parquet(ledger)
    out = rows.agg(*(F.sum(c).alias(c) for c in ("generated", "accepted", "mixed", "all_fail", "all_success")), F.max("target").alias("target"))
    rate = F.when(F.col("generated") > 0, F.col("mixed") / F.col("generated")).otherwise(0.0)
    return out.withColumn("acceptance_rate", rate).withColumn("done", F.coalesce(F.col("accepted") >= F.col("target"), F.lit(False)))


def stream_dedupe(rows: DataFrame, *, key: str, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """One rollout per query while the watermark covers it."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_health(
    rows: DataFrame,
    *,
    window: str = "1 day",
    slide: str | None = None,
    session_gap: str | None = None,
    delay: str = "1 hour",
    ts: str = "ts",
    max_failure_rate: float = 0.01,
    by: list[str] = (),
) -> DataFrame:
    """Failure rates per event-time window (and key) against a gate.

    Tumbling by default, sliding with ``slide``, session with ``session_gap``
    (sessions need a key).
    """
    marked = rows.withWatermark(ts, delay)
    span = F.session_window(ts, session_gap) if session_gap else F.window(ts, window, slide)
    failed = F.col("failed").cast("int")
    out = marked.groupBy(*by, span.alias("w")).agg(F.count("*").alias("n"), F.sum(failed).alias("failures"))
    return out.select(
        *by,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "n",
        "failures",
        (F.col("failures") / F.col("n")).alias("failure_rate"),
        (F.col("failures") / F.col("n") > max_failure_rate).alias("above_gate"),
    )


def run_to_table(df: DataFrame, label: str) -> DataFrame:
    """Drain a stream into a fresh table and read it back."""
    spark = df.sparkSession
    path = work_path(spark, label)
    start_append(df, path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
