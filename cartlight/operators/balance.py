"""Load balancing by total length (P family)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlight.functions.ranking import BROADCAST_ROWS, ordered_sum


#: Rows that a range piece is meant to hold.
PIECE_ROWS = 1_000_000


def balance_by_length(df: DataFrame, *, key: str, length: str, k: int) -> DataFrame:
    """Deal rows into k bins with near-equal totals and counts.

    Rows sorted by length are dealt forth and back over the bins; the sort
    position comes from a range-partitioned running count.
    """
    ranked = ordered_sum(df, [F.desc(length), F.asc(key)], name="_rank")
    m = (F.col("_rank") - 1) % (2 * k)
    return ranked.withColumn("bin", F.when(m < k, m).otherwise(2 * k - 1 - m).cast("int")).drop("_rank")


def first_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int]]:
    """First fit decreasing on counts: (length, before, upto, first_bin, each).

    Rows ``before + 1`` to ``upto`` of a length go, ``each`` to a bin, to the
    bins from ``first_bin`` on. Bins of equal content are held as one run, so
    the work grows with the number of lengths, not of rows or bins.
    """
    out = []
    room, first, many = (np.zeros(0, dtype=np.int64) for _ in range(3))  # runs of bins in their order
    bins = 0
    for length, count in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        done = 0
        fits = np.flatnonzero(room >= length)
        each = room[fits] // length if length else np.full(len(fits), count)
        held = np.cumsum(each * many[fits])
        full = int(np.searchsorted(held, count, side="right"))  # runs that fill up
        for run, per, upto in zip(fits[:full].tolist(), each[:full].tolist(), held[:full].tolist()):
            out.append((length, done, upto, int(first[run]), per))
            done = upto
        room[fits[:full]] -= each[:full] * length
        if done < count and full < len(fits):  # the next run takes the rest, and comes apart
            run, per = int(fits[full]), int(each[full])
            whole, over = divmod(count - done, per)
            out.append((length, done, count, int(first[run]), per))
            parts = [(whole, room[run] - per * length), (int(over > 0), room[run] - over * length), (many[run] - whole - (over > 0), room[run])]
            parts = [(m, r) for m, r in parts if m]
            starts = first[run] + np.cumsum([0, *(m for m, _ in parts[:-1])])
            room, first, many = (
                np.concatenate([old[:run], new, old[run + 1 :]]) for old, new in ((room, [r for _, r in parts]), (first, starts), (many, [m for m, _ in parts]))
            )
            done = count
        if done < count:  # new bins
            per = limit // length if length else count
            whole, over = divmod(count - done, per)
            out.append((length, done, count, bins, per))
            parts = [(m, r) for m, r in ((whole, limit - per * length), (int(over > 0), limit - over * length)) if m]
            starts = bins + np.cumsum([0, *(m for m, _ in parts[:-1])])
            room, first, many = (np.concatenate([old, new]).astype(np.int64) for old, new in ((room, [r for _, r in parts]), (first, starts), (many, [m for m, _ in parts])))
            bins += sum(m for m, _ in parts)
    return out


def pack_micro_batches(df: DataFrame, *, key: str, length: str, max_tokens: int) -> DataFrame:
    """Rows in bins of at most ``max_tokens``: ``bin`` and ``bin_count`` on every row.

    First fit decreasing, the longest rows first and equal ones by key: at
    most 11/9 of the least possible number of bins, and one more. The driver
    holds the counts of the distinct lengths, at most ``max_tokens`` + 1
    numbers whatever the rows; a row finds its bin by its number among the
    rows of its length, which comes from range pieces, so a hot length is
    spread. A null length counts as 0; one that is negative or above the
    limit is an error, since no bin could hold it.
    """
    size = F.coalesce(F.col(length).cast("bigint"), F.lit(0))
    wrong = F.raise_error(F.lit("a length is negative or above max_tokens")).cast("bigint")
    sized = df.withColumn("_len", F.when((size < 0) | (size > max_tokens), wrong).otherwise(size))
    classes = sized.groupBy("_len").count().toPandas()
    found = first_fit_decreasing(classes["_len"].to_numpy(dtype=np.int64), classes["count"].to_numpy(dtype=np.int64), max_tokens)
    bin_count = max((start + -(-(upto - before) // each) for _, before, upto, start, each in found), default=0)
    # a row a length and run of bins; lists by length, so that a row meets one list
    runs = df.sparkSession.createDataFrame(found, "_len bigint, before bigint, upto bigint, first_bin bigint, each bigint")
    runs = runs.groupBy("_len").agg(F.array_sort(F.collect_list(F.struct("upto", "before", "first_bin", "each"))).alias("_runs"))
    # a task sorts its rows: their number is bounded, not that of the tasks
    pieces = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(classes["count"].sum()) // PIECE_ROWS))
    numbered = ordered_sum(sized, [F.col(key)], by=("_len",), name="_i", partitions=pieces)
    run = F.get(F.filter("_runs", lambda r: F.col("_i") <= r["upto"]), F.lit(0))
    placed = numbered.join(F.broadcast(runs) if len(found) <= BROADCAST_ROWS else runs, "_len").withColumn("_run", run)
    at = F.col("_run.first_bin") + F.floor((F.col("_i") - F.col("_run.before") - 1) / F.col("_run.each"))
    return placed.withColumns({"bin_count": F.lit(bin_count).cast("bigint"), "bin": at}).drop("_len", "_i", "_runs", "_run")


def imbalance_report(df: DataFrame, *, bins: dict[str, str], length: str) -> DataFrame:
    """Smallest and largest bin total and their spread for each way of binning."""
    long = df.select(
        length,
        F.explode(F.array(*[F.struct(F.lit(n).alias("binning"), F.col(c).cast("bigint").alias("bin")) for n, c in bins.items()])).alias("_b"),
    ).select(length, "_b.*")
    totals = long.groupBy("binning", "bin").agg(F.sum(length).alias("total"))
    return totals.groupBy("binning").agg(
        F.count("*").alias("bins"),
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
        (F.max("total") - F.min("total")).alias("spread"),
    )
