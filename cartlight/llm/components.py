"""Connected components of a table of links, all in Spark.

Alternating large-star and small-star steps: a node's neighbours are linked to
the smallest node near it until every component is a star. Sums are combined
before the shuffle, lineage is cut by reliable checkpoints, and only two
numbers a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlight.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step; ``links`` has columns a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; any order); component is the smallest node reachable.

    Links with a null end or equal ends are ignored; repeated links do no
    harm; an empty table gives an empty one.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(ends)
    state = None
    for _ in range(max_rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
