"""Positions and running sums over any order, safe for hot groups.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group
in one task. Here the rows are range-partitioned by (group, order), so a hot
group is spread over many tasks, and each piece gets the total of the pieces
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.session import cut_lineage


def ordered_sum(
    df: DataFrame,
    order: list[Column],
    by: tuple[str, ...] = (),
    weight: Column | None = None,
    name: str = "idx",
    partitions: int | None = None,
) -> DataFrame:
    """Running sum of ``weight`` (default 1, so a row number) in ``order``.

    The last order column must make the order total.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    weight = F.lit(1) if weight is None else weight
    ranged = df.withColumn("_w", weight).repartitionByRange(n, *keys, *order)
    # the partition number is part of the data from here on, so it must not
    # change when a lost task is run again
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *by).agg(F.sum("_w").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # only a group that continues from an earlier piece has an offset: at most
    # one per piece, so this side has at most n rows and may be broadcast
    offsets = (
        sizes.withColumn("_off", F.sum("_size").over(before))
        .filter("_off is not null")
        .select("_part", *by, "_off")
    )
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(offsets), ["_part", *by], "left")
    if partitions:
        joined = joined.repartition(n, "_part", *by)  # as many pieces in the window's tasks as in the ranges
    return joined.withColumn(name, F.sum("_w").over(inside) + F.coalesce("_off", F.lit(0))).drop(
        "_part", "_off", "_w"
    )


BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of short rows may be broadcast; stops counting at the limit."""
    return df.limit(rows + 1).count() <= rows


def with_group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregate then join instead of a window: the aggregate combines on the map
    side and AQE can split the join of a hot group, where a window would send
    the group to one task.
    """
    stats = df.groupBy(*by).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.join(stats, by)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """First k rows per group; the rank limit is applied before the shuffle."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col(rank) <= k
    )
    return out if name else out.drop(rank)


HOT_GROUP_ROWS = 2_000_000
_RUNNING = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "max": (F.max, F.max),
    "min": (F.min, F.min),
}


def has_hot_group(df: DataFrame, by: list[str], limit: int = HOT_GROUP_ROWS) -> bool:
    """Whether some group is too large to sort in one task."""
    return not df.groupBy(*by).count().filter(F.col("count") > limit).isEmpty()


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    columns: dict[str, tuple[str, Column]],
    *,
    upto: str = "before",
    hot: bool | None = None,
) -> DataFrame:
    """Running sum, count, max or min per group, up to the row or before it.

    Small groups use a window. When a group is hot (checked unless the caller
    knows), its rows are spread by range and the pieces are combined by their
    totals, so no task sorts the whole group.
    """
    end = -1 if upto == "before" else 0
    if hot is None:
        hot = has_hot_group(df, by)
    frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    if not hot:
        w = frame.partitionBy(*by)
        return df.withColumns({n: _RUNNING[fn][0](c).over(w) for n, (fn, c) in columns.items()})
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *[F.col(c) for c in by], *order)
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *by).agg(
        F.count("*").alias("_n"), *[_RUNNING[fn][0](c).alias(f"_t_{n}") for n, (fn, c) in columns.items()]
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *by,
        F.sum("_n").over(before).alias("_seen"),
        *[_RUNNING[fn][1](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (fn, _) in columns.items()],
    ).filter("_seen is not null")
    # at most one continued group per piece, so at most n_parts rows
    joined = ranged.join(F.broadcast(offsets), ["_part", *by], "left")
    inside = frame.partitionBy("_part", *by)

    def combine(name: str, fn: str, col: Column) -> Column:
        own, offset = _RUNNING[fn][0](col).over(inside), F.col(f"_o_{name}")
        if fn in ("max", "min"):
            return F.greatest(own, offset) if fn == "max" else F.least(own, offset)
        both = F.coalesce(own, F.lit(0)) + F.coalesce(offset, F.lit(0))
        return F.when(own.isNotNull() | offset.isNotNull(), both)

    out = joined.withColumns({n: combine(n, fn, c) for n, (fn, c) in columns.items()})
    return out.drop("_part", "_seen", *[f"_o_{n}" for n in columns])


def neighbour(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    columns: dict[str, tuple[Column, int]],
    *,
    hot: bool | None = None,
) -> DataFrame:
    """Values of the row ``offset`` places away (negative is earlier) in the group.

    Hot groups are numbered piecewise and joined on (group, number), a key
    that no longer repeats.
    """
    if hot is None:
        hot = has_hot_group(df, by)
    if not hot:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns(
            {n: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) for n, (c, k) in columns.items()}
        )
    numbered = ordered_sum(df, order, by=tuple(by), name="_i")
    out = numbered
    for name, (col, k) in columns.items():
        other = numbered.select(*by, (F.col("_i") - k).alias("_i"), col.alias(name))
        out = out.join(other, [*by, "_i"], "left")
    return out.drop("_i")
