"""Validation metrics over repeated answers (M family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_hex, hash_index, hash_unit
from cartlight.functions.ranking import has_hot_group, running


def numeric_values(df: DataFrame, variables: list[str], *, keys: list[str]) -> DataFrame:
    """``keys, variable, x``: finite numbers only, other values are dropped."""
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).try_cast("double").alias("x")) for v in variables])).alias("_v"),
    ).select(*keys, "_v.*")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    return long.filter(finite)


def mean_std(values: DataFrame, *, source: str, prompt: str) -> DataFrame:
    """mean@n and std@n per prompt, then the mean over prompts."""
    per = values.groupBy(source, prompt, "variable").agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")
    )
    return per.groupBy(source, "variable", "n").agg(
        F.count("*").alias("prompts"),
        F.avg("m").alias("mean"),
        F.avg(F.when(F.col("n") > 1, F.col("s"))).alias("std"),
    )


def best_worst(values: DataFrame, *, keys: list[str], hot: bool | None = None) -> DataFrame:
    """Mean and std of the best and worst of n draws with replacement, n = 2, 4, ... , N.

    Exact: with c values up to and including x among N, the best of n draws is
    at most x with probability (c/N)^n. Equal values are counted first, so the
    running count is over distinct values.
    """
    counts = values.groupBy(*keys, "x").agg(F.count("*").alias("c"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("total"))
    upto = running(counts, keys, [F.col("x")], {"hi": ("sum", F.col("c"))}, upto="current", hot=hot)
    ns = F.array_distinct(
        F.concat(
            F.filter(F.array(*[F.lit(2**i) for i in range(1, 31)]), lambda n: n < F.col("total")),
            F.array(F.col("total").cast("int")),
        )
    )
    rows = upto.join(sizes.filter("total > 1").withColumn("n", F.explode(ns)), keys)
    lo, hi, n, total = F.col("hi") - F.col("c"), F.col("hi"), F.col("n"), F.col("total")
    p_best = F.pow(hi / total, n) - F.pow(lo / total, n)
    p_worst = F.pow((total - lo) / total, n) - F.pow((total - hi) / total, n)
    x = F.col("x")
    moments = rows.groupBy(*keys, "total", "n").agg(
        F.sum(x * p_best).alias("best_mean"),
        F.sum(x * x * p_best).alias("_b2"),
        F.sum(x * p_worst).alias("worst_mean"),
        F.sum(x * x * p_worst).alias("_w2"),
    )

    def std(second: str, mean: str):
        return F.sqrt(F.greatest(F.col(second) - F.col(mean) * F.col(mean), F.lit(0.0)))

    return moments.withColumns({"best_std": std("_b2", "best_mean"), "worst_std": std("_w2", "worst_mean")}).drop("_b2", "_w2")


#: Samples of a key up to which its draws are made within its row.
KEY_SAMPLES = 1000


def majority_vote(df: DataFrame, *, keys: list[str], sample: str, pred: str, value: str, n: int, draws: int, seed: str = "0") -> DataFrame:
    """maj@n: mean and std over draws of the value of the most frequent answer.

    Each draw takes n answers with replacement by hash; ties go to the answer
    drawn first, and its first drawn value counts. A key's samples meet in one
    row, where all draws are made, so that samples are shuffled and draws are
    not. Keys above KEY_SAMPLES samples join their draws instead; the result
    is the same.
    """
    if not has_hot_group(df, keys, KEY_SAMPLES):
        return _votes_in_rows(df, keys, sample, pred, value, n, draws, seed)
    hot = df.groupBy(*keys).count().filter(F.col("count") > KEY_SAMPLES).select(*keys)
    usual = _votes_in_rows(df.join(hot, keys, "left_anti"), keys, sample, pred, value, n, draws, seed)
    return usual.unionByName(_votes_by_join(df.join(hot, keys, "left_semi"), keys, sample, pred, value, n, draws, seed))


def _tag(keys: list[str], draw: Column, slot: Column) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys], draw.cast("string"), slot.cast("string"))


def _votes_in_rows(df: DataFrame, keys: list[str], sample: str, pred: str, value: str, n: int, draws: int, seed: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(hash_hex(F.col(sample), seed).alias("h"), F.col(sample).alias("s"), F.col(pred).alias("p"), F.col(value).alias("v"))))
    rows = df.groupBy(*keys).agg(ordered.alias("_a")).withColumn("_n", F.size("_a"))

    def winner(draw: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda slot: F.get("_a", F.floor(hash_unit(_tag(keys, draw, slot), seed) * F.col("_n")).cast("int")))
        # bound once: the list of picks is read n times
        votes = F.transform(F.array(picked), lambda p: F.array_max(F.transform(p, lambda x, i: F.struct(F.size(F.filter(p, lambda y: y["p"].eqNullSafe(x["p"]))).alias("votes"), (-i).alias("f"), x["v"].alias("v"))))["v"])
        return F.get(votes, F.lit(0))

    won = rows.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(draws)), winner)).alias("v"))
    return won.groupBy(*keys).agg(F.avg("v").alias("maj_mean"), F.stddev_pop("v").alias("maj_std"))


def _votes_by_join(df: DataFrame, keys: list[str], sample: str, pred: str, value: str, n: int, draws: int, seed: str) -> DataFrame:
    numbered = hash_index(df.select(*keys, sample, pred, value), sample, seed, name="_i", by=tuple(keys))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    picks = slots.select(*keys, "draw", "slot", (F.floor(hash_unit(_tag(keys, F.col("draw"), F.col("slot")), seed) * F.col("_n")) + 1).alias("_i"))
    drawn = picks.join(numbered, [*keys, "_i"])
    votes = drawn.groupBy(*keys, "draw", pred).agg(F.count("*").alias("votes"), F.min("slot").alias("first"), F.min(F.struct("slot", value))[value].alias("v"))
    winners = votes.groupBy(*keys, "draw").agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), "v"))["v"].alias("v"))
    return winners.groupBy(*keys).agg(F.avg("v").alias("maj_mean"), F.stddev_pop("v").alias("maj_std"))


def score_by_source(df: DataFrame, *, source: str, item: str, score: str) -> DataFrame:
    """Mean over the responses of an item, then over the items of a source."""
    per_item = df.groupBy(source, item).agg(F.avg(score).alias("m"))
    return per_item.groupBy(source).agg(F.avg("m").alias("test_score"), F.count("*").alias("items"))
