"""Statistics of grouped rollouts (K family).

A run holds groups (one query, several samples). Everything is aggregated to
one row per group first; bootstrap and ranking start from those rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_index, hash_unit
from cartlight.functions.ranking import neighbour, ordered_sum, running, top_k
from cartlight.functions.stats import var_population

# fixed values: id fields of a rollout row, first present one wins
QUERY_KEY_FIELDS = ["query_id", "prompt_id", "uid", "query", "input"]


def query_key(df: DataFrame, *, fields: list[str] = QUERY_KEY_FIELDS) -> Column:
    """16 hex characters of the sha1 of the first non-empty id field."""
    present = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in df.columns]
    return F.coalesce(F.substring(F.sha1(F.coalesce(*present)), 1, 16), F.lit("missing-query"))


def _binary(x: Column) -> Column:
    return F.when(x.isNotNull(), (x.cast("double") >= 1 - 1e-9).cast("int"))


def outcome_columns(df: DataFrame) -> DataFrame:
    """Paper and terminal outcome (0/1) with fallbacks, and where each came from."""

    def col(name: str) -> Column:
        return _binary(F.col(name)) if name in df.columns else F.lit(None).cast("int")

    product = col("rule") * col("budget")
    ended_success, ended = col("terminate_success"), col("terminate")
    out = df.withColumns(
        {
            "paper_outcome": F.coalesce(col("paper_asr"), product),
            "paper_source": F.when(col("paper_asr").isNotNull(), "paper_asr")
            .when(product.isNotNull(), "rule*budget")
            .otherwise("missing"),
        }
    )
    derived = F.col("paper_outcome") * F.coalesce(ended_success, ended)
    return out.withColumns(
        {
            "terminal_outcome": F.coalesce(col("terminal_asr"), derived),
            "terminal_source": F.when(col("terminal_asr").isNotNull() | F.col("paper_outcome").isNull(), "terminal_asr")
            .when(ended_success.isNotNull(), "paper_asr*terminate_success")
            .when(ended.isNotNull(), "paper_asr*terminate")
            .otherwise("missing"),
        }
    )


def state_of(low: Column, high: Column) -> Column:
    return F.when(high == 0, "all_fail").when(low == 1, "all_success").otherwise("mixed")


def group_state(df: DataFrame, *, by: list[str], outcome: str = "outcome", group_size: int = 8) -> DataFrame:
    """all_fail, mixed or all_success per group; unknown when an outcome is missing."""
    x = F.col(outcome)
    return df.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count(x).alias("known"),
        F.coalesce(F.sum(x), F.lit(0)).alias("successes"),
        F.when(F.count(x) == F.count("*"), state_of(F.min(x), F.max(x))).alias("state"),
        (F.count("*") == group_size).alias("complete"),
    )


def mixed_selection(
    df: DataFrame, *, by: str, order: str, outcome: str = "outcome", group_size: int = 8, max_groups: int | None = None
) -> DataFrame:
    """Rows of the first mixed groups; a group of another size is an error."""
    groups = df.groupBy(by).agg(
        F.count("*").alias("n"), F.min(outcome).alias("lo"), F.max(outcome).alias("hi"), F.min(order).alias("first")
    )
    checked = groups.withColumn(
        "ok",
        F.when(F.col("n") != group_size, F.raise_error(F.concat(F.lit("wrong group size: "), F.col("n").cast("string"))))
        .otherwise(F.lit(True)),
    )
    mixed = checked.filter(F.col("ok") & (F.col("lo") < F.col("hi")))
    if max_groups is not None:
        mixed = mixed.orderBy("first").limit(max_groups)
    return df.join(mixed.select(by), by, "left_semi")


def run_summary(df: DataFrame, *, run: str = "run_id", group: str = "uid", group_size: int = 8, elapsed: str | None = None) -> DataFrame:
    """Rates, pass@G, token and step quantiles, failure counts per run.

    Rows are reduced to groups, then to runs. Token and step quantiles use the
    counts of the distinct integers, which partial aggregation bounds.
    """
    flags = ["server_error", "json_failure", "truncated", "runaway"]
    present = [f for f in flags if f in df.columns]
    any_flag = F.greatest(F.lit(0), *[F.col(f) for f in present])
    infra = F.greatest(F.lit(0), *[F.col(f) for f in present if f != "truncated"])
    groups = df.groupBy(run, group).agg(
        F.count("*").alias("n"),
        F.sum("outcome").alias("won"),
        F.min("outcome").alias("lo"),
        F.max("outcome").alias("hi"),
        F.sum("paper").alias("paper_won"),
        F.min("paper").alias("plo"),
        F.max("paper").alias("phi"),
        F.sum(any_flag).alias("failed"),
        F.sum(infra).alias("infra_failed"),
        *[F.sum(f).alias(f) for f in present],
    )
    by_group = groups.groupBy(run).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("queries"),
        F.avg((F.col("n") == group_size).cast("int")).alias("rollout_complete_rate"),
        (F.sum("paper_won") / F.sum("n")).alias("paper_asr"),
        (F.sum("won") / F.sum("n")).alias("terminal_asr"),
        *[F.count_if(state_of(F.col("lo"), F.col("hi")) == s).alias(f"terminal_{s}") for s in ("all_fail", "mixed", "all_success")],
        F.avg((F.col("lo") < F.col("hi")).cast("int")).alias("mixed_terminal_rate"),
        F.avg((F.col("plo") < F.col("phi")).cast("int")).alias("mixed_paper_rate"),
        F.avg(F.col("phi")).alias("paper_pass_at_g"),
        F.avg(F.col("hi")).alias("terminal_pass_at_g"),
        (F.sum("failed") / F.sum("n")).alias("failure_rate"),
        (F.sum("infra_failed") / F.sum("n")).alias("infrastructure_failure_rate"),
        *[F.sum(f).alias(f"{f}_count") for f in present],
    )
    sizes = df.groupBy(run).agg(
        F.avg("response_tokens").alias("response_tokens_mean"),
        F.percentile("response_tokens", 0.5).alias("response_tokens_p50"),
        F.percentile("response_tokens", 0.95).alias("response_tokens_p95"),
        F.max("response_tokens").alias("response_tokens_max"),
        F.avg("turns").alias("steps_mean"),
        F.percentile("turns", 0.95).alias("steps_p95"),
        F.max("turns").alias("steps_max"),
        F.avg("format").alias("format_mean"),
        F.avg("workflow_valid").alias("workflow_valid_mean"),
        *([F.max(elapsed).alias("elapsed_seconds")] if elapsed else []),
    )
    out = by_group.join(sizes, run)
    if elapsed:
        out = out.withColumn("trajectories_per_second", F.when(F.col("elapsed_seconds") > 0, F.col("rows") / F.col("elapsed_seconds")))
    return out


def poisson_steps() -> list[str]:
    """Eight hex digits each: a draw below the first weighs 0, below the next 1, and so on (mean 1)."""
    steps, term, below, k = [], math.exp(-1), 0.0, 0
    while round((below + term) * 2**32) < 2**32:
        below += term
        steps.append(f"{round(below * 2**32):08x}")
        k += 1
        term /= k
    return steps


def bootstrap_means(values: DataFrame, *, by: list[str], key: str, value: str, draws: int, seed: str = "0") -> DataFrame:
    """``by, draw, mean`` of resamples: every row counts a Poisson(1) number of times, drawn by hash of draw and key.

    The state of a draw is two sums, which every task adds up for its own rows
    before the shuffle: at most draws x partitions (and groups) rows leave the
    map side, whatever the number of rows. Rows of one key count alike. A draw
    in which no row counts has a null mean. Nulls count for nothing.
    """
    # a digest has digits for four draws
    blocks = -(-draws // 4)
    tag = F.concat_ws(":", F.lit(seed), F.col("_block").cast("string"), F.col(key).cast("string"))
    rows = values.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.col(key).alias(key))
    drawn = rows.select(*by, "_v", key, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).select(*by, "_v", "_block", F.md5(tag).alias("_h"))

    def weight(j: int) -> Column:
        digits = F.substring("_h", 8 * j + 1, 8)
        return reduce(lambda a, b: a + b, [(digits >= step).cast("int") for step in poisson_steps()])

    weighted = drawn.select(*by, "_v", "_block", *(weight(j).alias(f"_w{j}") for j in range(4)))
    sums = weighted.groupBy(*by, "_block").agg(*(F.struct(F.sum(F.col(f"_w{j}") * F.col("_v")).alias("s"), F.sum(f"_w{j}").alias("w")).alias(f"_s{j}") for j in range(4)))
    pairs = [F.struct((F.col("_block") * 4 + j + 1).alias("draw"), F.try_divide(F.col(f"_s{j}.s"), F.col(f"_s{j}.w")).alias("mean")) for j in range(4)]
    return sums.select(*by, F.inline(F.array(*pairs))).filter(F.col("draw") <= draws)


def resample_means(values: DataFrame, *, by: list[str], key: str, value: str, draws: int, seed: str = "0") -> DataFrame:
    """``by, draw, mean`` of resamples with replacement: each draws as many rows as its group has.

    Every row stands for one slot of each resample: it draws a position by
    hash and fetches the value there by an equi-join, so nothing is collected
    and a group of any size is spread over all tasks. What is exchanged per
    slot are three numbers and the group; sums by draw are added up in every
    task before the last shuffle. A null value takes a position but does not
    count in the mean.
    """
    keyed = values.select(*by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col(value).alias("_v"))
    numbered = hash_index(keyed, "_k", seed, name="_i", by=tuple(by)).select(*by, "_i", "_v")
    sizes = values.groupBy(*by).agg(F.count("*").alias("_n"))
    with_n = numbered.join(sizes, by) if by else numbered.withColumn("_n", sizes.scalar())
    # a row opens to as many as there are draws: with a number given, short rows are not dealt to few tasks
    with_n = with_n.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_i")
    slots = with_n.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    tag = F.concat_ws(":", F.col("draw").cast("string"), F.col("_i").cast("string"))
    picks = slots.select(*by, "draw", (F.floor(hash_unit(tag, seed) * F.col("_n")) + 1).alias("_i"))
    return picks.join(numbered, [*by, "_i"]).groupBy(*by, "draw").agg(F.avg("_v").alias("mean"))


def bootstrap_ci(values: DataFrame, *, by: list[str], key: str, value: str, draws: int = 10_000, seed: str = "0", level: float = 0.95) -> DataFrame:
    """Mean with the percentile interval of its bootstrap distribution, by resampling with replacement."""
    return _interval(values, resample_means(values, by=by, key=key, value=value, draws=draws, seed=seed), by, value, level)


def _interval(values: DataFrame, means: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and size of every group with the percentile interval of its resamples' means."""
    tail = (1 - level) / 2
    ci = means.groupBy(*by).agg(F.percentile("mean", tail).alias("ci_low"), F.percentile("mean", 1 - tail).alias("ci_high"))
    center = values.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return center.join(ci, by) if by else center.join(F.broadcast(ci))


def paired_bootstrap(left: DataFrame, right: DataFrame, *, by: list[str] = (), key: str, value: str, draws: int = 20_000, seed: str = "0") -> DataFrame:
    """Mean difference right - left per key, interval, share of positive draws."""
    diff = left.select(*by, key, F.col(value).alias("_l")).join(right.select(*by, key, F.col(value).alias("_r")), [*by, key])
    diff = diff.select(*by, key, (F.col("_r") - F.col("_l")).alias("_d"))
    means = resample_means(diff, by=list(by), key=key, value="_d", draws=draws, seed=seed)
    ci = means.groupBy(*by).agg(
        F.percentile("mean", 0.025).alias("ci_low"),
        F.percentile("mean", 0.975).alias("ci_high"),
        F.avg((F.col("mean") > 0).cast("int")).alias("probability_positive"),
    )
    center = diff.groupBy(*by).agg(F.avg("_d").alias("mean_difference"), F.count("*").alias("n"))
    return center.join(ci, list(by)) if by else center.join(F.broadcast(ci))


def bucket_metrics(df: DataFrame, *, model: str, dimensions: list[str], value: str, key: str) -> DataFrame:
    """Mean per model and bucket, one dimension at a time, in one pass."""
    long = df.select(
        model,
        key,
        value,
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dimensions])).alias("_d"),
    ).select(model, key, value, "_d.*")
    # two levels, so the distinct count of keys needs no expansion
    per_key = long.groupBy("dimension", "bucket", model, key).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per_key.groupBy("dimension", "bucket", model).agg(
        F.count("*").alias("queries"), F.sum("_n").alias("trajectories"), (F.sum("_s") / F.sum("_n")).alias("mean")
    )


def gates(
    runs: DataFrame,
    *,
    format_min: float = 0.98,
    max_failure_rate: float = 0.01,
    workflow_drop_max: float = 0.05,
    baseline: Column | None = None,
    failure_column: str = "failure_rate",
) -> DataFrame:
    """Reasons a run is not eligible; the baseline is the mean of the reference runs.

    ``runs`` is one row per run; ``baseline`` marks the reference runs.
    """
    base = runs.filter(baseline).agg(F.avg("workflow_valid_mean")).scalar() if baseline is not None else F.lit(None).cast("double")
    checks = [
        (F.col("rows") == 0, "no_trajectory_rows"),
        (F.col("format_mean").isNull(), "format_missing"),
        (F.col("format_mean") < format_min, "format_below_threshold"),
        (F.coalesce("rollout_complete_rate", F.lit(0.0)) != 1.0, "incomplete_groups"),
        (F.col(failure_column) > max_failure_rate, f"{failure_column}_above_threshold"),
        (F.col("workflow_valid_mean").isNull(), "workflow_missing"),
        (F.col("workflow_valid_mean") < F.col("baseline_workflow") - workflow_drop_max, "workflow_below_baseline_tolerance"),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    return (
        runs.withColumn("baseline_workflow", base)
        .withColumn("gate_reasons", reasons)
        .withColumn("gate_eligible", F.size("gate_reasons") == 0)
    )


def rank_runs(runs: DataFrame, *, keys: list[tuple[str, bool]], eligible: str = "gate_eligible", tie: str = "run_id") -> DataFrame:
    """Rank eligible runs by (column, descending) keys, missing values last.

    There is one row per run, so the ranking window sees run rows only.
    """
    order = [F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c, desc in keys]
    return runs.filter(F.col(eligible)).withColumn("rank", F.row_number().over(Window.orderBy(*order, tie)))


def pool_configs(groups: DataFrame, runs: DataFrame, *, config: list[str], run: str = "run_id", draws: int = 1000) -> DataFrame:
    """Pool the groups of the eligible seeds of each configuration, with interval and rank.

    ``groups``: run, group key ``uid``, ``mixed``, ``known``, ``successes``;
    ``runs``: run, config columns, ``gate_eligible``.
    """
    members = runs.groupBy(*config).agg(
        F.count("*").alias("run_count"), F.count_if("gate_eligible").alias("eligible_run_count")
    )
    good = runs.filter("gate_eligible").select(run, *config)
    pooled = groups.join(good, run)
    rates = pooled.groupBy(*config).agg(
        F.count("*").alias("observations"),
        F.avg("mixed").alias("mixed_rate"),
        (F.sum("successes") / F.sum("known")).alias("terminal_asr"),
    )
    observed = pooled.select(*config, F.concat_ws(":", F.col(run).cast("string"), F.col("uid").cast("string")).alias("_key"), "mixed")
    ci = _interval(observed, bootstrap_means(observed, by=config, key="_key", value="mixed", draws=draws), config, "mixed")
    out = members.join(rates, config, "left").join(ci.select(*config, "ci_low", "ci_high"), config, "left")
    whole = (F.col("run_count") == F.col("eligible_run_count")) & (F.col("eligible_run_count") > 0)
    order = Window.partitionBy("all_runs_eligible").orderBy(
        F.desc_nulls_last("ci_low"), F.desc_nulls_last("mixed_rate"), F.desc_nulls_last("terminal_asr"), *config
    )
    return out.withColumn("all_runs_eligible", whole).withColumn("rank", F.when(F.col("all_runs_eligible"), F.row_number().over(order)))


def group_variance(df: DataFrame, *, by: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), var_population(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max")
    )


def group_variance_report(df: DataFrame, *, run: list[str], group: str, value: str) -> DataFrame:
    """Mean and maximum of the group variances, next to the plain variance."""
    per_group = group_variance(df, by=[*run, group], value=value)
    first = per_group.groupBy(*run).agg(
        F.count("*").alias("prompts"), F.avg("mean").alias("mean_of_means"), F.avg("var").alias("mean_of_vars"), F.max("var").alias("max_var")
    )
    whole = df.groupBy(*run).agg(F.count("*").alias("rows"), F.avg(value).alias("score_mean"), var_population(F.col(value)).alias("score_var"))
    return first.join(whole, run) if run else first.join(F.broadcast(whole))


def top_variance_groups(df: DataFrame, *, run: list[str], group: str, value: str, k: int = 10) -> DataFrame:
    per_group = group_variance(df, by=[*run, group], value=value).withColumn("var", F.round("var", 9))
    return top_k(per_group, run, [F.desc("var"), F.asc(group)], k, name="rank")


def checkpoint_select(checkpoints: DataFrame, *, protocol_min: float = 0.90, protocol_var_max: float = 0.05) -> DataFrame:
    """Among stable checkpoints the one with the largest task variance, tie by task mean."""
    ok = (F.col("protocol_mean") >= protocol_min) & (F.col("protocol_var") <= protocol_var_max)
    best = F.max(F.struct("task_var", "task_mean", "checkpoint"))
    return checkpoints.filter(ok).agg(best.alias("b")).select(
        F.col("b.checkpoint").alias("checkpoint"), F.col("b.task_var").alias("task_var"), F.col("b.task_mean").alias("task_mean")
    )


def best_checkpoint(
    validation: DataFrame, *, by: list[str], health: Column, saved: Column, gain: float = 0.05, recent_gain: float = 0.02
) -> DataFrame:
    """Best healthy saved step per run, whether it beats step 0 by ``gain``, and the extension rule.

    The extension rule: the last saved step improved on the one before by
    ``recent_gain`` while the goal is not met.
    """
    marked = validation.withColumns({"_ok": health & saved, "_saved": saved})
    # larger is better in every field
    key = F.struct("terminal_asr", "paper_asr", -F.col("infra"), -F.col("truncation"), -F.col("tokens"), -F.col("step"))
    steps = neighbour(marked.filter("_saved"), by, [F.col("step")], {"_before": (F.col("terminal_asr"), -1)}, hot=False)
    last = steps.groupBy(*by).agg(F.max(F.struct("step", "terminal_asr", "_before")).alias("l"))
    per = marked.groupBy(*by).agg(
        F.max(F.when(F.col("_ok"), key)).alias("b"),
        F.max(F.when(F.col("step") == 0, F.col("terminal_asr"))).alias("baseline"),
    )
    out = per.join(last, by, "left")
    best_step = -F.col("b")["col6"]
    best_rate = F.col("b")["terminal_asr"]
    met = (best_step > 0) & (best_rate >= F.coalesce("baseline", F.lit(0.0)) + gain)
    improving = F.coalesce(F.col("l.terminal_asr") - F.col("l._before") >= recent_gain, F.lit(False))
    return out.select(
        *by,
        best_step.alias("best_step"),
        best_rate.alias("best_rate"),
        F.coalesce("baseline", F.lit(0.0)).alias("baseline"),
        F.coalesce(met, F.lit(False)).alias("goal_met"),
        (improving & ~F.coalesce(met, F.lit(False))).alias("extend"),
    )


def curve_auc(points: DataFrame, *, by: list[str], x: str, y: str, hot: bool | None = None) -> DataFrame:
    """Trapezoid area over the width; null for fewer than two points."""
    distinct = points.select(*by, x, y).distinct()
    near = neighbour(distinct, by, [F.col(x), F.col(y)], {"_x0": (F.col(x), -1), "_y0": (F.col(y), -1)}, hot=hot)
    area = F.sum((F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2)
    width = F.max(x) - F.min(x)
    return near.groupBy(*by).agg(F.when(width > 0, area / width).alias("auc"), F.count("*").alias("points"))


def pilot_ranking(runs: DataFrame, *, by: str, step: str = "step") -> DataFrame:
    """Curve area, last values and worst truncation and divergence per pilot, ranked."""
    auc = curve_auc(runs, by=[by], x=step, y="terminal_asr", hot=False)
    last = runs.groupBy(by).agg(
        F.max(F.struct(step, "terminal_asr", "paper_asr", "mixed_rate")).alias("l"),
        F.max("truncation").alias("max_truncation"),
        F.max(F.abs("kl")).alias("max_abs_kl"),
    )
    flat = auc.join(last, by).select(
        by,
        "auc",
        F.col("l.terminal_asr").alias("last_terminal"),
        F.col("l.paper_asr").alias("last_paper"),
        F.col("l.mixed_rate").alias("last_mixed"),
        "max_truncation",
        "max_abs_kl",
    )
    order = [F.desc_nulls_last(c) for c in ("auc", "last_terminal", "last_paper", "last_mixed")]
    return flat.withColumn("rank", F.row_number().over(Window.orderBy(*order, by)))


def validation_record(df: DataFrame, *, step: str, group: str) -> DataFrame:
    """One row per step: group rates, row means, token quantiles."""
    groups = df.groupBy(step, group).agg(
        F.avg("outcome").alias("m"), F.min("outcome").alias("lo"), F.max("outcome").alias("hi"), F.count("*").alias("n")
    )
    rates = groups.groupBy(step).agg(
        F.sum("n").alias("trajectories"),
        F.count("*").alias("queries"),
        F.avg("m").alias("terminal_asr"),
        F.avg((F.col("lo") < F.col("hi")).cast("int")).alias("mixed_rate"),
    )
    means = df.groupBy(step).agg(
        F.avg("paper").alias("paper_asr"),
        F.avg("truncated").alias("truncation"),
        F.avg("server_error").alias("server_error"),
        F.avg("json_failure").alias("json_failure"),
        F.percentile("response_tokens", 0.5).alias("response_p50"),
        F.percentile("response_tokens", 0.95).alias("response_p95"),
        F.max("response_tokens").alias("response_max"),
    )
    return rates.join(means, step)


def dynamic_record(df: DataFrame, *, step: str, group: str) -> DataFrame:
    """Group yield per step of a dynamically filtered run."""
    states = group_state(df, by=[step, group])
    return states.groupBy(step).agg(
        F.sum("samples").alias("trajectories"),
        F.count("*").alias("groups"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("all_fail", "mixed", "all_success")],
        (F.count_if(F.col("state") == "mixed") / F.count("*")).alias("mixed_yield"),
        (F.sum("successes") / F.sum("samples")).alias("raw_reward"),
    )


def consecutive_runs(df: DataFrame, *, by: list[str], order: str, value: str, chunk: int = 8, hot: bool | None = None) -> DataFrame:
    """Number the runs of equal adjacent values, and the chunks inside each run."""
    order_cols = [F.col(order)]
    near = neighbour(df, by, order_cols, {"_prev": (F.col(value), -1)}, hot=hot)
    starts = near.withColumn("_start", F.when(F.col("_prev").eqNullSafe(F.col(value)), 0).otherwise(1)).drop("_prev")
    runs = running(starts, by, order_cols, {"run_no": ("sum", F.col("_start"))}, upto="current", hot=hot)
    placed = running(runs, [*by, "run_no"], order_cols, {"_n": ("count", F.lit(1))}, upto="before", hot=hot)
    return placed.withColumn("chunk_no", F.floor(F.coalesce("_n", F.lit(0)) / chunk).cast("int")).drop("_start", "_n")


def splice_baseline(current: DataFrame, reused: DataFrame, *, step: str = "step") -> DataFrame:
    """Steps of the current run, those of the reused record replacing equal ones."""
    return reused.unionByName(current.join(reused.select(step), step, "left_anti"))


def align_runs(left: DataFrame, right: DataFrame, *, step: str, value: str) -> DataFrame:
    """Two runs side by side by step."""
    a = left.select(step, F.col(value).alias(f"left_{value}"))
    b = right.select(step, F.col(value).alias(f"right_{value}"))
    return a.join(b, step, "full_outer")


def all_ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Global position of every row, spread by range."""
    return ordered_sum(df, order, name="rank")
