"""Group-relative advantages and resampling as table jobs (L family, S3).

Input rows are ``group, sample, score [, length]``. Group statistics are
aggregates joined back, so a hot group combines on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_hex, hash_unit
from cartlight.functions.ranking import ordered_sum, running, with_group_stats

ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}


def register_advantage(name: str):
    """Add a named estimator; a name can be taken once."""

    def wrap(fn: Callable[..., DataFrame]):
        if name in ADVANTAGES:
            raise ValueError(f"advantage {name} is registered already")
        ADVANTAGES[name] = fn
        return fn

    return wrap


def advantage(name: str, df: DataFrame, **options) -> DataFrame:
    """Run a registered estimator; an unknown name is an error."""
    if name not in ADVANTAGES:
        raise KeyError(f"unknown advantage estimator: {name}")
    return ADVANTAGES[name](df, **options)


def _mean_or_zero(df: DataFrame, by: str, score: str) -> DataFrame:
    """Group size and mean; a group of one has mean 0."""
    out = with_group_stats(df, [by], _n=F.count("*"), _m=F.avg(score))
    return out.withColumn("_m", F.when(F.col("_n") > 1, F.col("_m")).otherwise(0.0))


@register_advantage("grpo")
def grpo(df: DataFrame, *, by: str = "uid", score: str = "score", scale: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """(x - mean) / (std + eps), sample std; a group of one keeps x / (1 + eps)."""
    out = with_group_stats(df, [by], _n=F.count("*"), _m=F.avg(score), _s=F.stddev_samp(score))
    many = F.col("_n") > 1
    mean = F.when(many, F.col("_m")).otherwise(0.0)
    std = F.when(many, F.col("_s")).otherwise(1.0)
    centred = F.col(score) - mean
    return out.withColumn("advantage", centred / (std + epsilon) if scale else centred).drop("_n", "_m", "_s")


@register_advantage("grpo_passk")
def grpo_passk(df: DataFrame, *, by: str = "uid", sample: str = "sample", score: str = "score", scale: bool = True, epsilon: float = 1e-6) -> DataFrame:
    """Only the best sample gets max - second max; a group below two is an error."""
    # the two best rows of a group as a bounded aggregate
    pair = F.struct(F.col(score).alias("x"), (-F.col(sample)).alias("s"))
    best = with_group_stats(df, [by], _best=F.max(pair), _n=F.count("*"), _s=F.stddev_samp(score))
    is_best = -F.col("_best.s") == F.col(sample)
    second = best.filter(~is_best).groupBy(by).agg(F.max(score).alias("_second"))
    out = best.join(second, by, "left")
    gain = F.col(score) - F.col("_second")
    value = F.when(is_best, gain / (F.col("_s") + epsilon) if scale else gain).otherwise(0.0)
    # checked first, whatever the statistics of the group are
    small = F.raise_error(F.lit("pass@k needs at least two samples per group")).cast("double")
    return out.withColumn("advantage", F.when(F.col("_n") < 2, small).otherwise(value)).drop("_best", "_n", "_s", "_second")


@register_advantage("rloo")
def rloo(df: DataFrame, *, by: str = "uid", score: str = "score") -> DataFrame:
    """Score against the mean of the other samples."""
    out = _mean_or_zero(df, by, score)
    n = F.col("_n")
    value = (F.col(score) - F.col("_m")) * n / (n - 1)
    return out.withColumn("advantage", F.when(n > 1, value).otherwise(F.col(score))).drop("_n", "_m")


@register_advantage("opo")
def opo(df: DataFrame, *, by: str = "uid", score: str = "score", length: str = "response_tokens") -> DataFrame:
    """Length-weighted baseline."""
    out = with_group_stats(
        df, [by], _n=F.count("*"), _b=F.sum(F.col(score) * F.col(length)) / F.sum(length)
    )
    base = F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0)
    return out.withColumn("advantage", F.col(score) - base).drop("_n", "_b")


@register_advantage("gpg")
def gpg(df: DataFrame, *, by: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """alpha (x - mean) / f, alpha = rows / rows with a non-zero score."""
    alpha = df.agg(F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).scalar()
    out = _mean_or_zero(df, by, score)
    return out.withColumn("advantage", alpha * (F.col(score) - F.col("_m")) / f_norm).drop("_n", "_m")


@register_advantage("rfpp_baseline")
def rfpp_baseline(df: DataFrame, *, by: str = "uid", score: str = "score", length: str = "response_tokens") -> DataFrame:
    """Centre by group, then whiten over all tokens (a row counts once per token)."""
    centred = _mean_or_zero(df, by, score).withColumn("_x", F.col(score) - F.col("_m"))
    w, x = F.col(length), F.col("_x")
    mean = F.sum(w * x) / F.sum(w)
    var = (F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / F.sum(w)) / (F.sum(w) - 1)
    stats = centred.agg(F.struct(mean.alias("m"), var.alias("v"))).scalar()
    return centred.withColumn("advantage", (x - stats["m"]) / F.sqrt(stats["v"] + 1e-8)).drop("_n", "_m", "_x")


def discounted_return(rewards: Column, mask: Column, *, gamma: float = 1.0) -> Column:
    """Returns per position of a reward array, reset after the end (mask 0)."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("x"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        value = p["x"] + gamma * acc["run"]
        return F.struct((value * p["m"]).alias("run"), F.concat(acc["out"], F.array(value)).alias("out"))

    return F.reverse(F.aggregate(pairs, start, step)["out"])


def remax(tokens: DataFrame, *, by: str, pos: str, reward: str, mask: str, baseline: str, hot: bool | None = None) -> DataFrame:
    """Reward still to come minus the baseline, per token row."""
    out = running(tokens, [by], [F.desc(pos)], {"_r": ("sum", F.col(reward) * F.col(mask))}, upto="current", hot=hot)
    return out.withColumns(
        {"returns": F.col("_r"), "advantage": F.col("_r") - F.col(baseline) * F.col(mask)}
    ).drop("_r")


def gae(rewards: Column, values: Column, mask: Column, *, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Advantages per position from the reverse recursion; masked positions are passed over."""
    triples = F.reverse(F.arrays_zip(rewards.alias("x"), values.alias("v"), mask.alias("m")))
    start = F.struct(
        F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        delta = p["x"] + gamma * acc["next"] - p["v"]
        fresh = delta + gamma * lam * acc["last"]
        last = fresh * p["m"] + (1 - p["m"]) * acc["last"]
        following = p["v"] * p["m"] + (1 - p["m"]) * acc["next"]
        return F.struct(following.alias("next"), last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    return F.reverse(F.aggregate(triples, start, step)["out"])


def whiten(df: DataFrame, *, value: str, mask: str) -> Column:
    """(x - mean) / sqrt(var + 1e-8) over rows with mask 1; sample variance."""
    kept = df.filter(F.col(mask) == 1)
    stats = kept.agg(F.struct(F.avg(value).alias("m"), F.var_samp(value).alias("v"))).scalar()
    return (F.col(value) - stats["m"]) / F.sqrt(stats["v"] + 1e-8)


def reweight(df: DataFrame, *, score: str = "score", method: str = "pow", power: float = 2.0) -> DataFrame:
    """Resampling weight per row: ``pow``, ``max_min`` or ``max_random``."""
    x = F.col(score)
    if method == "pow":
        weight = F.pow(F.abs(x), F.lit(power))
    else:
        ends = df.agg(F.struct(F.max(score).alias("hi"), F.min(score).alias("lo"))).scalar()
        if method == "max_min":
            weight = F.when((x == ends["hi"]) | (x == ends["lo"]), 1.0).otherwise(0.0)
        elif method == "max_random":
            weight = F.when(x == ends["hi"], 0.4).otherwise(0.1)
        else:
            raise ValueError(f"unsupported reweight method: {method}")
    return df.withColumn("weight", F.greatest(weight + 1e-8, F.lit(1e-8)))


def resample(df: DataFrame, *, key: str, weight: str = "weight", seed: str = "0") -> DataFrame:
    """As many draws with replacement as there are rows: ``key, copies`` (rows never drawn are absent).

    The cumulative weights cut [0, total) into one interval per row, in hash
    order so that light rows spread evenly. Intervals and draws meet in an
    equi-join on equal-width cells (as many cells as rows), which replaces
    the range join; an interval is repeated once per cell it touches.
    """
    ordered = ordered_sum(
        df.select(key, F.col(weight).alias("_wt")).withColumn("_h", hash_hex(F.col(key), seed)),
        [F.col("_h"), F.col(key)],
        weight=F.col("_wt"),
        name="_hi",
    )
    totals = ordered.agg(F.struct(F.max("_hi").alias("total"), F.count("*").alias("n"))).scalar()
    width = totals["total"] / totals["n"]
    low = F.floor((F.col("_hi") - F.col("_wt")) / width)
    cells = ordered.select(
        key, "_hi", (F.col("_hi") - F.col("_wt")).alias("_lo"), F.explode(F.sequence(low, F.floor(F.col("_hi") / width))).alias("_cell")
    )
    draws = df.select((hash_unit(F.col(key), f"{seed}:draw") * totals["total"]).alias("_d")).withColumn(
        "_cell", F.floor(F.col("_d") / width)
    )
    hits = draws.join(cells, "_cell").filter((F.col("_lo") <= F.col("_d")) & (F.col("_d") < F.col("_hi")))
    return hits.groupBy(key).agg(F.count("*").alias("copies"))


def overlong_penalty(length: Column, *, max_length: int, buffer: int, factor: float = 1.0) -> Column:
    """Linear penalty inside the last ``buffer`` tokens of the budget."""
    exceed = length - (max_length - buffer)
    return F.least(-exceed / buffer * factor, F.lit(0.0))


def data_metrics(df: DataFrame, *, stats: list[str], clip: dict[str, int] = {}, values: tuple[str, str] | None = None, by: list[str] = ()) -> DataFrame:
    """Mean, max, min per column; share at the length limit; explained variance of (return, value)."""
    aggs = []
    for c in stats:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    for c, limit in clip.items():
        aggs.append(F.avg((F.col(c) == limit).cast("int")).alias(f"{c}_clip_ratio"))
    if values:
        ret, val = values
        explained = 1 - F.var_samp(F.col(ret) - F.col(val)) / (F.var_samp(ret) + 1e-5)
        aggs.append(explained.alias("explained_variance"))
    return df.groupBy(*by).agg(*aggs)


def reduce_by_name(metrics: DataFrame, *, key: str = "key", value: str = "value") -> DataFrame:
    """Maximum for names with "max", minimum for names with "min", else the mean."""
    name = F.col(key)
    return (
        metrics.groupBy(key)
        .agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_m"))
        .select(
            key,
            F.when(F.contains(name, F.lit("max")), F.col("_hi").cast("double"))
            .when(F.contains(name, F.lit("min")), F.col("_lo").cast("double"))
            .otherwise(F.col("_m"))
            .alias(value),
        )
    )


def throughput(tokens: DataFrame, timings: DataFrame, *, by: str, workers: int) -> DataFrame:
    """Per stage: seconds, milliseconds per token; per step: tokens per second and worker.

    ``tokens``: by, prompt_tokens, response_tokens; ``timings``: by, stage, seconds
    with a stage ``step``. The generation stage counts response tokens only.
    """
    sums = tokens.groupBy(by).agg(
        F.sum("response_tokens").alias("response"), F.sum(F.col("prompt_tokens") + F.col("response_tokens")).alias("total")
    )
    used = F.when(F.col("stage") == "gen", F.col("response")).otherwise(F.col("total"))
    per_token = F.when(F.col("stage") != "step", F.col("seconds") * 1000 / used)
    rate = F.when(F.col("stage") == "step", F.col("total") / (F.col("seconds") * workers))
    return timings.join(sums, by).select(
        by, "stage", "seconds", per_token.alias("ms_per_token"), rate.alias("tokens_per_second")
    )
