"""Rejection sampling, voting and merging of runs (I family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_hex
from cartlight.functions.ranking import running

SFT_TOKEN_LIMIT = 16384


def gate_success(*, task: str, mode: str = "strict") -> Column:
    """Whether a run passes its task's gate.

    ``strict`` rejects when any part fails; ``lenient`` (voucher task only)
    rejects when all parts fail.
    """
    rule = F.col("rule") >= 1
    if task == "product":
        return rule
    other = F.col("shop") >= 1 if task == "shop" else F.col("budget") >= 1
    if task not in ("shop", "voucher"):
        raise ValueError(f"invalid task: {task}")
    return rule | other if mode == "lenient" and task == "voucher" else rule & other


def best_of_n(runs: DataFrame, *, by: str, passed: Column, file_order: str = "file_no", score: str = "length_score") -> DataFrame:
    """Shortest terminated passing run per query; the first file wins ties.

    A maximum of a struct keeps one row per query on the map side already.
    """
    rest = [c for c in runs.columns if c != by]
    ok = runs.filter(passed & (F.col(score) > 0))
    best = ok.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(file_order)).alias("_f"))).alias("_b"))
    return best.select(by, "_b.*")


def multi_vote(runs: DataFrame, *, by: str, passed: Column, file_order: str = "file_no", seed: str = "0") -> DataFrame:
    """A random passing run per query, else a random run; random by hash."""
    rest = [c for c in runs.columns if c != by]
    key = F.concat_ws(":", F.col(by).cast("string"), F.col(file_order).cast("string"))
    order = F.struct((~passed).cast("int").alias("_miss"), hash_hex(key, seed).alias("_h"))
    out = runs.withColumn("_passed", passed)
    picked = out.groupBy(by).agg(F.min_by(F.struct(*rest, "_passed"), order).alias("_b"))
    return picked.select(by, *[F.col(f"_b.{c}").alias(c) for c in rest], F.col("_b._passed").alias("passed"))


def flatten_calls(steps: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """One row per (call, observation) pair, renumbered from 1 in order.

    ``steps``: by, step, calls (array), observations (array).
    """
    n = F.least(F.size("calls"), F.size("observations"))
    zipped = F.arrays_zip(F.slice("calls", F.lit(1), n).alias("call"), F.slice("observations", F.lit(1), n).alias("observation"))
    rows = steps.select(by, "step", F.posexplode(F.when(n > 0, zipped)).alias("pos", "z"))
    out = running(
        rows.select(by, "step", "pos", "z.*"), [by], [F.col("step"), F.col("pos")], {"new_step": ("count", F.lit(1))}, upto="current", hot=hot
    )
    return out


def sft_from_best(
    steps: DataFrame, *, format_ok: Column, instruction: Column, input_text: Column, output: Column, tokens: Column, limit: int = SFT_TOKEN_LIMIT
) -> DataFrame:
    """Rows to train on: format-valid, non-empty output, within the token limit."""
    rows = steps.withColumns({"instruction": instruction, "input": input_text, "output": output})
    return rows.filter(format_ok & (F.coalesce(F.col("output"), F.lit("")) != "") & (tokens <= limit))


def stage_funnel(runs: DataFrame, *, by: str, gates: dict[str, Column]) -> DataFrame:
    """Distinct queries left after each gate; each gate also needs the ones before it.

    Flags are reduced per query first, so no distinct count is needed.
    """
    flags, so_far = [], F.lit(True)
    for name, cond in gates.items():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        flags.append(F.max(so_far.cast("int")).alias(name))
    per_query = runs.groupBy(by).agg(*flags)
    return per_query.agg(F.count("*").alias("total"), *[F.sum(n).alias(n) for n in gates])


def fail_cases(runs: DataFrame, *, by: str, passed: Column, sample: int = 50, file_order: str = "file_no", seed: str = "0") -> DataFrame:
    """Success or failure, with the chosen run, for a hash sample of the queries."""
    chosen = runs.select(by).distinct().orderBy(hash_hex(F.col(by), seed), by).limit(sample)
    pool = runs.join(chosen, by, "left_semi")
    best = best_of_n(pool, by=by, passed=passed, file_order=file_order)
    good = best.select(by, file_order, F.lit("success").alias("case"))
    last = pool.join(best, by, "left_anti").groupBy(by).agg(F.max(file_order).alias(file_order))
    return good.unionByName(last.withColumn("case", F.lit("failure")))


def merge_runs(primary: DataFrame, retry: DataFrame, *, query: str = "query", index: str = "idx", success: str = "success") -> tuple[DataFrame, DataFrame]:
    """(merged successes, skipped duplicates) of a primary and a retry run.

    Retry rows are mapped to the primary's index by query; a query without an
    index is an error. The primary wins over the retry, the earlier row wins
    inside a run.
    """
    known = primary.groupBy(query).agg(F.min(index).alias("original_idx"))
    first = primary.filter(success).select("*", F.col(index).alias("original_idx"), F.lit(0).alias("priority"))
    mapped = retry.filter(success).join(known, query, "left").withColumn("priority", F.lit(1))
    unmapped = F.raise_error(F.lit("retry query is not in the primary run")).cast("bigint")
    mapped = mapped.withColumn("original_idx", F.when(F.col("original_idx").isNull(), unmapped).otherwise(F.col("original_idx")))
    both = first.unionByName(mapped)
    keep = both.groupBy("original_idx").agg(F.min(F.struct("priority", index)).alias("_k"))
    marked = both.join(keep, "original_idx").withColumn("_first", F.struct("priority", index) == F.col("_k"))
    return marked.filter("_first").drop("_k", "_first"), marked.filter("not _first").drop("_k", "_first")


def filter_by_length(df: DataFrame, *, length: Column, limit: int) -> DataFrame:
    return df.filter(length <= limit)


def length_filter_report(df: DataFrame, *, length: Column, limit: int, by: list[str] = ()) -> DataFrame:
    kept = length <= limit
    return df.groupBy(*by).agg(
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("dropped"),
        F.max(F.when(kept, length)).alias("max_kept"),
        F.max(length).alias("max_seen"),
    )


def empty_completion(steps: DataFrame, *, by: str, content: str) -> DataFrame:
    """Whether some step of a trajectory has a blank completion."""
    blank = F.trim(F.coalesce(F.col(content), F.lit("")), F.lit(" \n\t\r")) == ""
    return steps.groupBy(by).agg(F.bool_or(blank).alias("has_empty_completion"))


def drop_samples(df: DataFrame, drops: DataFrame, *, key: str = "sample_id") -> DataFrame:
    return df.join(drops.select(key).distinct(), key, "left_anti")
