"""Named quantile and variance rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.ranking import ordered_sum


def var_population(x: Column) -> Column:
    """Population variance, 0 below two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.var_pop(x))


def var_sample(x: Column) -> Column:
    """Sample variance, 0 below two values."""
    return F.when(F.count(x) < 2, 0.0).otherwise(F.var_samp(x))


def quantiles(
    df: DataFrame,
    value: str,
    qs: list[float],
    by: tuple[str, ...] = (),
    rule: str = "linear",
) -> DataFrame:
    """Exact quantiles, one row per (by, q), for groups of any size.

    ``rule`` is ``upper_median`` (s[n div 2], qs ignored), ``nearest_rank``
    (s[round((n-1)q)], half to even) or ``linear`` (interpolation).

    Equal values are counted first, so a hot value is one row. Positions come
    from a range-partitioned running sum, so no task holds a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = ordered_sum(counts, [F.col(value)], by=by, weight=F.col("_n"), name="_hi")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    qs = [0.5] if rule == "upper_median" else qs
    want = totals.select(*by, "_total", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    if rule == "upper_median":
        low = high = F.floor(F.col("_total") / 2)
    elif rule == "nearest_rank":
        low = high = F.bround((F.col("_total") - 1) * F.col("q"))
    else:
        pos = (F.col("_total") - 1) * F.col("q")
        low, high = F.floor(pos), F.ceil(pos)
    want = want.withColumn("_lo", low.cast("bigint")).withColumn("_hi_pos", high.cast("bigint"))
    join_on = list(by)
    pairs = ranked.join(want, join_on) if join_on else ranked.join(F.broadcast(want))
    start = F.col("_hi") - F.col("_n")
    hit_lo = (F.col("_lo") >= start) & (F.col("_lo") < F.col("_hi"))
    hit_hi = (F.col("_hi_pos") >= start) & (F.col("_hi_pos") < F.col("_hi"))
    picked = pairs.filter(hit_lo | hit_hi).groupBy(*by, "q", "_total", "_lo").agg(
        F.max(F.when(hit_lo, F.col(value))).cast("double").alias("_a"),
        F.max(F.when(hit_hi, F.col(value))).cast("double").alias("_b"),
    )
    frac = (F.col("_total") - 1) * F.col("q") - F.col("_lo") if rule == "linear" else F.lit(0.0)
    return picked.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("value"))
