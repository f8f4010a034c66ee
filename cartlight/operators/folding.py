"""History compression of trajectories (H family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.ranking import running, top_k
from cartlight.functions.text import word_count


def fold_state(
    found: DataFrame,
    calls: DataFrame,
    *,
    by: str = "traj_id",
    max_items: int | None = None,
) -> DataFrame:
    """State before each step from all earlier steps, in one pass.

    ``found``: by, step, pos, rank_in_result, product_id (search results);
    ``calls``: by, step, pos, name, product_ids, status. Each product counts at
    its first appearance only, so the lists grow by new ids, and a running
    window replaces the replay of every prefix. ``max_items`` keeps the most
    recent candidates.
    """
    order = F.struct("step", "pos", "rank_in_result")
    first = found.groupBy(by, "product_id").agg(F.min(order).alias("o"))
    new_ids = first.groupBy(by, F.col("o.step").alias("step")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "product_id"))), lambda x: x["product_id"]).alias("new_ids")
    )
    name = F.col("name")

    def last(cond: Column) -> Column:
        return F.max(F.when(cond, F.struct("step", "pos", "product_ids")))

    viewed = (
        calls.filter(name == "view_product_information")
        .select(by, "step", "pos", F.posexplode(F.split("product_ids", ",")).alias("rank_in_result", "product_id"))
        .groupBy(by, "product_id")
        .agg(F.min(order).alias("o"))
        .groupBy(by, F.col("o.step").alias("step"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "product_id"))), lambda x: x["product_id"]).alias("new_views"))
    )
    steps = calls.groupBy(by, "step").agg(
        F.count_if(name == "find_product").alias("searches"),
        last(name == "budget_check").alias("budget"),
        last(name == "recommend_product").alias("recommend"),
        F.max(F.when(name == "terminate", F.col("status"))).alias("status"),
    )
    rows = steps.join(new_ids, [by, "step"], "left").join(viewed, [by, "step"], "left")
    before = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c: str) -> Column:
        return F.flatten(F.collect_list(c).over(before))

    candidates = so_far("new_ids")
    if max_items:
        candidates = cap_recent(candidates, max_items)
    budget = F.max("budget").over(before)["product_ids"]
    recommended = F.max("recommend").over(before)["product_ids"]
    return rows.select(
        by,
        "step",
        F.coalesce(F.sum("searches").over(before), F.lit(0)).alias("n_searches"),
        candidates.alias("candidates"),
        so_far("new_views").alias("viewed"),
        F.coalesce(recommended, budget, F.lit("")).alias("selected_ids"),
        F.coalesce(F.last("status", ignorenulls=True).over(before), F.lit("")).alias("termination"),
    )


def cap_recent(items: Column, max_items: int) -> Column:
    """Last n items of a list."""
    return F.when(F.size(items) > max_items, F.slice(items, -max_items, max_items)).otherwise(items)


def cap_by_priority(items: DataFrame, priority: DataFrame, *, key: list[str], item: str, order: str, k: int) -> DataFrame:
    """k items per key: prioritised ones first (in priority order), then the newest.

    Output order ``place``: priority order, then age.
    """
    ranked = priority.groupBy(*key, item).agg(F.min("priority").alias("priority"))
    joined = items.join(ranked, [*key, item], "left")
    chosen = top_k(joined, key, [F.asc_nulls_last("priority"), F.desc(order)], k)
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last("priority"), F.asc(order))
    return chosen.withColumn("place", F.row_number().over(w))


def focused_candidates(hits: DataFrame, focus: DataFrame, *, key: list[str], n: int = 10, extra: int = 3) -> DataFrame:
    """First n hits of each search plus up to three further ones from focus shops.

    ``hits``: key, rank (from 1), product_id, shop_id; ``focus``: key, shop_id.
    """
    shops = focus.select(*key, "shop_id").distinct().withColumn("_focus", F.lit(1))
    marked = hits.join(shops, [*key, "shop_id"], "left")
    first = marked.filter(F.col("rank") <= n).withColumn("place", F.col("rank"))
    more = top_k(marked.filter((F.col("rank") > n) & (F.col("_focus") == 1)), key, [F.col("rank")], extra, name="_x")
    more = more.withColumn("place", F.col("_x") + n).drop("_x")
    return first.unionByName(more).drop("_focus")


def shop_groups(candidates: DataFrame, *, by: str = "traj_id", groups: int = 6, ids: int = 8) -> DataFrame:
    """Largest shops among the candidates: count, first ids, distinct services.

    ``candidates``: by, place, product_id, shop_id, services (comma list).
    """
    known = candidates.filter(F.coalesce("shop_id", F.lit("")) != "")
    sizes = known.groupBy(by, "shop_id").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = top_k(sizes, [by], [F.desc("n"), F.asc("first")], groups, name="group_rank")
    kept = known.join(best, [by, "shop_id"])
    listed = top_k(kept, [by, "shop_id"], [F.col("place")], ids)
    names = listed.groupBy(by, "shop_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "product_id"))), lambda x: x["product_id"]), ",").alias("product_ids")
    )
    services = (
        kept.select(by, "shop_id", F.explode(F.split("services", ",")).alias("s"))
        .filter("s <> ''")
        .groupBy(by, "shop_id")
        .agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("services"))
    )
    return best.join(names, [by, "shop_id"]).join(services, [by, "shop_id"], "left").drop("first")


def balanced_candidates(candidates: DataFrame, *, by: list[str], source: str, order: str, k: int) -> DataFrame:
    """Round robin over the sources until k are taken; short lists stay whole.

    ``source`` numbers the searches, ``order`` the hits of a search.
    """
    # no source can contribute more than k
    ranked = top_k(candidates, [*by, source], [F.col(order)], k, name="_round")
    placed = top_k(ranked, by, [F.col("_round"), F.col(source)], k, name="place")
    return placed.drop("_round")


def folding_savings(steps: DataFrame, *, by: str, order: str, raw_text: str, folded_text: str, hot: bool | None = None) -> DataFrame:
    """Tokens of the whole history against the folded prompt, per step."""
    sized = steps.withColumns({"_raw": word_count(F.col(raw_text)), "folded_tokens": word_count(F.col(folded_text))})
    summed = running(sized, [by], [F.col(order)], {"raw_tokens": ("sum", F.col("_raw"))}, upto="current", hot=hot)
    saving = F.when(F.col("raw_tokens") > 0, 1 - F.col("folded_tokens") / F.col("raw_tokens")).otherwise(0.0)
    return summed.select(by, order, "raw_tokens", "folded_tokens", saving.alias("saving"))


def savings_summary(savings: DataFrame, *, by: list[str] = ()) -> DataFrame:
    return savings.groupBy(*by).agg(
        F.count("*").alias("n_steps"),
        F.avg("raw_tokens").alias("mean_raw"),
        F.avg("folded_tokens").alias("mean_folded"),
        F.max("raw_tokens").alias("max_raw"),
        F.max("folded_tokens").alias("max_folded"),
        F.avg("saving").alias("mean_saving"),
        F.min("saving").alias("min_saving"),
    )


def view_shortlist(hits: DataFrame, originals: DataFrame, *, by: str, per_search: int, max_ids: int) -> DataFrame:
    """Ids to view: the asked ids always, then interleaved top hits while there is room.

    ``hits``: by, source, rank, product_id; ``originals``: by, place, product_id.
    """
    top = hits.filter(F.col("rank") <= per_search)
    first = top.groupBy(by, "product_id").agg(F.min(F.struct("rank", "source")).alias("at"))
    asked = originals.groupBy(by, "product_id").agg(F.min("place").alias("asked_at"))
    n_asked = asked.groupBy(by).agg(F.count("*").alias("n_asked"))
    room = F.greatest(F.lit(0), F.lit(max_ids) - F.coalesce("n_asked", F.lit(0)))
    ranked = (
        top_k(first, [by], [F.col("at")], max_ids, name="turn")
        .join(n_asked, by, "left")
        .filter(F.col("turn") <= room)
        .select(by, "product_id", "turn")
    )
    both = ranked.join(asked, [by, "product_id"], "full_outer")
    return both.select(by, "product_id", F.col("asked_at").isNotNull().alias("asked"))


def folding_report(rows: DataFrame, *, by: list[str], texts: dict[str, str], check: str) -> DataFrame:
    """Characters and tokens per variant, saving of the last against the others, all checks."""
    aggs = []
    for name, c in texts.items():
        aggs.append(F.sum(F.length(c)).alias(f"{name}_chars"))
        aggs.append(F.sum(word_count(F.col(c))).alias(f"{name}_tokens"))
    out = rows.groupBy(*by).agg(*aggs, F.bool_and(check).alias("all_ok"), F.count("*").alias("n_steps"))
    *others, last = list(texts)
    for name in others:
        for unit in ("chars", "tokens"):
            whole, folded = F.col(f"{name}_{unit}"), F.col(f"{last}_{unit}")
            pct = F.when(whole > 0, F.round((whole - folded) / whole * 100, 2)).otherwise(0.0)
            out = out.withColumn(f"{name}_{unit}_savings_pct", pct)
    return out
