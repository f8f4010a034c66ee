"""Assignment of rows to their nearest candidates by proposals (J7).

Rows of equal features have the same distances, so distances are taken between
classes of features, not between rows. Every row proposes to the nearest class
that may still take it; a class keeps as many proposers as it has candidates,
the smallest keys first, and turns the others away, who move on. This is
deferred acceptance with one order of priority, and its end is what a serial
pass over the keys would give, each taking its nearest unused candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_hex, hash_index
from cartlight.functions.ranking import ordered_sum
from cartlight.session import materialize

#: How a feature counts in a distance: 0 or 1, or the size of the difference.
EQUAL, NUMBER = "equal", "number"


def feature_class(columns: list[str]) -> Column:
    """One string for a combination of features; nulls are a value of their own."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))


def _distance(kind: str, name: str) -> Column:
    if kind == EQUAL:
        return (~F.col(f"w.{name}").eqNullSafe(F.col(f"c.{name}"))).cast("double")
    if kind == NUMBER:
        gap = F.abs(F.col(f"w.{name}").cast("double") - F.col(f"c.{name}").cast("double"))
        both_null = F.col(f"w.{name}").isNull() & F.col(f"c.{name}").isNull()
        return F.when(both_null, 0.0).otherwise(F.coalesce(gap, F.lit(float("inf"))))
    raise ValueError(f"unknown kind of distance {kind!r}")


def match_nearest(wanted: DataFrame, candidates: DataFrame, *, key: str, stratum: list[str], distance: list[tuple[str, str]], seed: str = "0") -> DataFrame:
    """``key, match, exact``: a candidate for every wanted row, as near as the keys before it leave.

    In order of ``key``: a candidate of the same ``stratum``, else one of
    least ``distance`` (names with their kind, the weightiest first), ties by
    hash of the class and of the candidate. No candidate is used twice; when
    none is left, ``match`` and ``exact`` are null. Keys must be distinct.
    Distances are held between classes: the product of the numbers of distinct
    feature combinations on both sides, whatever the number of rows.
    """
    names = list(dict.fromkeys([*stratum, *(n for n, _ in distance)]))
    wanted = wanted.select(F.col(key).alias("key"), *names).withColumn("from", feature_class(names))
    supply = candidates.select(F.col(key).alias("match"), *names).withColumn("to", feature_class(names))
    sides = wanted.groupBy("from", *names).agg(F.count("*")).alias("w"), supply.groupBy("to", *names).agg(F.count("*").alias("room")).alias("c")
    other = F.lit(False)
    for name in stratum:
        other = other | ~F.col(f"w.{name}").eqNullSafe(F.col(f"c.{name}"))
    # classes, not rows: every pair of feature combinations once
    pairs = sides[0].crossJoin(sides[1]).select(
        "from", "to", "room", F.struct(other.alias("other"), *(_distance(kind, n).alias(f"d{i}") for i, (n, kind) in enumerate(distance)), hash_hex(F.col("to"), f"{seed}:class").alias("h")).alias("far")
    )
    order = Window.partitionBy("from").orderBy("far", "to")
    choices = pairs.withColumn("at", F.row_number().over(order)).withColumn("upto", F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    choices = materialize(choices.select("from", "to", "room", "at", "upto", F.col("far.other").alias("other")), "class-choices")
    rooms = materialize(supply.groupBy("to").agg(F.count("*").alias("room")), "class-rooms")
    # a row's elders of its own class have the same choices and go first: it may start where they leave room
    ranked = ordered_sum(wanted.select("key", "from"), [F.col("key")], by=("from",), name="elder")
    reach = choices.groupBy("from").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    start = F.size(F.filter(F.coalesce("upto", F.array().cast("array<bigint>")), lambda u: u < F.col("elder"))) + 1
    state = materialize(ranked.join(reach, "from", "left").select("key", "from", start.alias("at")), "proposals")
    while True:
        proposed = state.join(choices.select("from", "at", "to"), ["from", "at"])
        placed = ordered_sum(proposed.select("key", "from", "at", "to"), [F.col("key")], by=("to",), name="place").join(rooms, "to")
        placed = materialize(placed, "placed")
        refused = placed.filter("place > room")
        if refused.isEmpty():
            break
        # the last that a full class keeps: whoever comes after it need not ask there, now or later
        last = placed.filter("place = room").select("to", F.col("key").alias("last"))
        doors = choices.join(last, "to", "left").groupBy("from").agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("doors"))
        may = F.filter("doors", lambda d: (d["at"] > F.col("at")) & (d["last"].isNull() | (F.col("key") < d["last"])))
        onward = F.coalesce(F.get(may, F.lit(0))["at"], F.size("doors") + 1)
        moved = refused.select("key", "from", "at").join(doors, "from").select("key", "from", onward.alias("at"))
        done = state.join(refused.select("key"), "key", "left_anti").select("key", "from", "at")
        state = materialize(done.unionByName(moved), "proposals")
    numbered = hash_index(supply.select("match", "to"), "match", f"{seed}:candidate", name="place", by=("to",))
    matched = placed.join(numbered, ["to", "place"]).join(choices.select("from", "at", "other"), ["from", "at"])
    found = matched.select("key", "match", (~F.col("other")).alias("exact"))
    return state.select("key").join(found, "key", "left").select(F.col("key").alias(key), "match", "exact")
