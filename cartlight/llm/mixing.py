"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated a Poisson number of times with mean
``weight_s * total / size_s``. The number comes from inverting the
distribution at a uniform value hashed from seed and row key, so it does
not depend on partitions, retries or order. All of it is built-in expressions.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.functions.ranking import is_small, ordered_sum
from cartlight.session import materialize

#: A larger mean is split into equal parts, each drawn alone: the sum has the wanted distribution.
PART = 16.0


def hashed_unit(*parts: Column) -> Column:
    """Uniform value in [0, 1) on a grid of 2**-52, from the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """Parts and the distribution function of one part at 0, 1, 2, ..., up to the grid of the uniform value."""
    parts = max(1, math.ceil(mean / PART))
    each = mean / parts
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(each) - each - math.lgamma(k + 1)) if each > 0 else 1.0
        steps.append(total)
        if each <= 0 or (k > each and 1 - total < 2.0**-53):
            return parts, steps[:-1] if total >= 1 else steps
        if k > each + 40 * math.sqrt(each) + 60:
            return parts, steps
        k += 1


def poisson_count(key: Column, mean: float, seed: str) -> Column:
    """Steps of the distribution function at or below the uniform value, summed over the parts."""
    parts, steps = poisson_steps(mean)
    if mean <= 0 or not steps:
        return F.lit(0)
    table = F.array(*(F.lit(x) for x in steps))
    below = lambda j: F.size(F.filter(table, lambda step: step <= hashed_unit(F.lit(seed), key, j.cast("string"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(parts)), F.lit(0), lambda total, j: total + below(j))


def source_sizes(df: DataFrame, named: list[str], source_col: str, text_col: str) -> dict[str | None, int]:
    """Characters plus one for each document, by named source; None stands for all others.

    One row for each named source and one more come to the driver, however many sources there are.
    """
    group = F.when(F.col(f"`{source_col}`").isin(named), F.col(f"`{source_col}`"))
    size = F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).cast("bigint") + 1
    rows = df.groupBy(group.alias("source")).agg(F.sum(size).alias("size")).collect()
    return {row["source"]: row["size"] for row in rows}


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, and that column's name: the id, or the id and a number where rows share it.

    Ids are counted first, and only rows of shared ids are shuffled. They are
    numbered over range pieces, so an id that a third of all rows have is
    spread over many tasks.
    """
    hidden = "row key " + uuid.uuid4().hex[:8]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    keyed = df.withColumn(hidden, key)
    shared = materialize(keyed.groupBy(hidden).count().filter(F.col("count") > 1).select(hidden, F.lit(True).alias("shared " + hidden)), "shared-ids")
    if shared.isEmpty():
        return keyed, hidden
    marked = keyed.join(F.broadcast(shared) if is_small(shared) else shared, hidden, "left")
    mark = F.col(f"`shared {hidden}`")
    alone, together = marked.filter(mark.isNull()).drop(f"shared {hidden}"), marked.filter(mark).drop(f"shared {hidden}")
    others = [f.name for f in df.schema.fields if f.name not in (id_col, text_col) and isinstance(f.dataType, T.AtomicType)]
    # equal rows are told apart by their place only: which of them has which number changes nothing
    order = [F.col(f"`{text_col}`"), *(F.col(f"`{c}`") for c in others), F.monotonically_increasing_id()]
    numbered = ordered_sum(together.withColumnRenamed(hidden, "_shared"), order, by=("_shared",), name="_number")
    numbered = numbered.withColumn(hidden, F.concat_ws("#", "_shared", F.col("_number").cast("string"))).drop("_shared", "_number")
    return alone.select(*(F.col(f"`{c}`") for c in keyed.columns)).unionByName(numbered.select(*(F.col(f"`{c}`") for c in keyed.columns))), hidden


def mix_sources(
    df: DataFrame,
    weights: dict[str, float],
    other: float = 0.0,
    factor: float = 1.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Rows repeated so that sources have their target share of characters, in one global random order.

    ``weights`` names sources; ``other`` is the weight of all further ones
    together, a null source included. ``factor`` is the wanted size as a
    multiple of the input's. Adds ``copy`` (from 1) and ``shuffle_key`` (32
    hex digits: the rows are dealt to partitions by it and sorted by it
    within). Every row is drawn and ordered by itself: rows that share an id,
    or have none, are numbered among each other, by text and then the other
    columns. A null or empty text counts one character, an empty table gives
    an empty one. Input columns with these two names are replaced. Nothing is
    capped: a small source with a large weight is repeated as often as that
    takes.
    """
    named = sorted(weights)
    names = df.columns
    df, hidden = with_row_key(df, id_col, text_col)
    sizes = source_sizes(df, named, source_col, text_col)
    total = sum(sizes.values())
    asked = sum(w for s, w in weights.items() if s in sizes) + (other if None in sizes else 0.0)
    key = F.col(hidden)
    means = {s: factor * w / asked * total / sizes[s] for s, w in [*weights.items(), (None, other)] if s in sizes and asked > 0}
    count = poisson_count(key, means.get(None, 0.0), seed)
    for source in named:
        if source in means:
            count = F.when(F.col(f"`{source_col}`") == source, poisson_count(key, means[source], seed)).otherwise(count)
    keep = [F.col(f"`{c}`") for c in names if c.lower() not in ("copy", "shuffle_key")]
    copies = df.select(*keep, hidden, count.alias("copy")).filter("copy > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", order).drop(hidden).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
