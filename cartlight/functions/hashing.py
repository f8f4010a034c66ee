"""Deterministic randomness: every draw is a hash of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def hash_hex(key: Column, seed: str = "0") -> Column:
    """32 hex digits that order rows the same way on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(key: Column, seed: str = "0") -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("bigint")


def hash_unit(key: Column, seed: str = "0") -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(key, seed) / F.lit(4294967296.0)


def hash_range(key: Column, low: Column, high: Column, seed: str = "0") -> Column:
    """Uniform integer in [low, high]."""
    return (low + F.floor(hash_unit(key, seed) * (high - low + 1))).cast("bigint")


def stable_id(text: Column, lower: bool = False) -> Column:
    """sha256 of the whitespace-normalised text."""
    norm = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+", " ")
    return F.sha2(F.lower(norm) if lower else norm, 256)


def hash_index(df: DataFrame, key: str, seed: str = "0", name: str = "idx", by: tuple[str, ...] = ()) -> DataFrame:
    """1-based position of every row in hash order, without a one-task sort.

    Rows fall into 4096 buckets by the first three hex digits. The bucket
    counts (at most 4096 rows per group) give each bucket its offset, and the
    rank inside a bucket needs only that bucket.
    """
    hashed = df.withColumn("_h", hash_hex(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(*by, "_b").count()
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    return (
        hashed.join(offsets, [*by, "_b"])
        .withColumn(name, F.row_number().over(inside) + F.col("_off"))
        .drop("_h", "_b", "_off")
    )
