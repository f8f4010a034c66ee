"""Constraint matching, evaluation and reward audits (F family)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.functions.ranking import top_k
from cartlight.functions.stats import var_population, var_sample
from cartlight.functions.text import normalize_space, word_count

FIELDS = ["title", "price", "service", "sku_attrs"]
# fixed values: weights of the progress components
PROGRESS_WEIGHTS = {
    "find_correct": 0.20,
    "view_confirmed": 0.20,
    "budget_correct": 0.20,
    "recommend_correct": 0.30,
    "terminate_complete": 0.10,
}
STEP_PENALTY = 0.005
#: Rows that a task is meant to hold.
PIECE_ROWS = 500_000
#: Tasks that the items of one key may be dealt to.
SALTS = 64


def ground_truth_match(product_id: Column, wanted_id: Column) -> Column:
    return F.coalesce(product_id == wanted_id, F.lit(False)).cast("int")


def _attribute_pairs(attributes: Column) -> Column:
    return F.flatten(
        F.transform(
            F.map_entries(attributes),
            lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("k"), v.alias("v"))),
        )
    )


def _sku_pairs(options: Column) -> Column:
    return F.transform(F.map_entries(options), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda, a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sku_attr_hits(product: Column, constraint: Column) -> tuple[Column, Column]:
    """(best hits over SKU variants together with the attributes, total wanted).

    What the attributes hold counts whichever variant is taken, so variants
    are looked through for the rest only.
    """
    wanted = F.concat(
        F.flatten(F.transform(constraint["sku_options"], _sku_pairs)),
        F.flatten(F.transform(constraint["attributes"], _attribute_pairs)),
    )
    attrs = _attribute_pairs(product["attributes"])
    no_pairs = F.array().cast("array<struct<k:string,v:string>>")
    variants = F.concat(
        F.array(no_pairs), F.transform(F.map_values(product["sku_options"]), _sku_pairs)
    )

    def best(given: Column) -> Column:
        def missing(z: Column) -> Column:
            return F.filter(z["wanted"], lambda w: ~F.coalesce(F.array_contains(z["attrs"], w), F.lit(False)))

        def hits(z: Column) -> Column:
            in_variants = F.transform(variants, lambda s: F.size(F.filter(z["rest"], lambda w: F.array_contains(s, w))))
            return z["total"] - F.size(z["rest"]) + F.array_max(in_variants)

        return _once(F.struct(F.size(given["wanted"]).alias("total"), missing(given).alias("rest")), hits)

    return _once(F.struct(wanted.alias("wanted"), attrs.alias("attrs")), best), F.size(wanted)


def rule_score(
    df: DataFrame,
    *,
    product: str = "product",
    constraint: str = "constraint",
    similarity: str = "title_similarity",
    title_threshold: float = 0.5,
) -> DataFrame:
    """Share of satisfied requirements, with hits and totals per field.

    ``similarity`` is an array with one value per wanted title. An equal id
    scores 1 with empty counters. No requirement at all scores 0.
    """
    p, c = F.col(product), F.col(constraint)
    exact = ground_truth_match(p["product_id"], c["product_id"]) == 1
    none = F.array()

    def total(x: Column) -> Column:
        return F.size(F.coalesce(x, none.cast("array<string>")))

    title_total = total(c["title"])
    title_hits = F.size(F.filter(F.coalesce(F.col(similarity), none.cast("array<double>")), lambda s: s >= title_threshold))
    prices = F.coalesce(c["price"], none.cast("array<struct<mode:string,lo:double,hi:double>>"))
    price = p["price"]
    price_hits = F.size(
        F.filter(
            prices,
            lambda b: ((b["mode"] == "less than") & (price <= b["hi"]))
            | ((b["mode"] == "greater than") & (price >= b["lo"]))
            | ((b["mode"] == "between") & (price >= b["lo"]) & (price <= b["hi"])),
        )
    )
    service_hits = F.size(
        F.filter(
            F.coalesce(c["service"], none.cast("array<string>")), lambda s: F.array_contains(p["service"], s)
        )
    )
    sku_hits, sku_total = sku_attr_hits(p, c)
    counted = {
        "title": (title_hits, title_total),
        "price": (price_hits, F.size(prices)),
        "service": (service_hits, total(c["service"])),
        "sku_attrs": (sku_hits, sku_total),
    }
    columns = {}
    for field, (hit, tot) in counted.items():
        columns[f"{field}_hits"] = F.when(exact, 0).otherwise(hit)
        columns[f"{field}_total"] = F.when(exact, 0).otherwise(tot)
    scored = df.withColumns(columns)
    hits = sum((F.col(f"{f}_hits") for f in FIELDS[1:]), F.col("title_hits"))
    totals = sum((F.col(f"{f}_total") for f in FIELDS[1:]), F.col("title_total"))
    return scored.withColumn("gt", exact.cast("int")).withColumn(
        "rule", F.when(exact, 1.0).when(totals == 0, 0.0).otherwise(hits / totals)
    )


def field_score(field: str) -> Column:
    """Share of a field's requirements that hold; 1 when it has none."""
    return F.when(F.col(f"{field}_total") > 0, F.col(f"{field}_hits") / F.col(f"{field}_total")).otherwise(1.0)


def pair_by_position(
    constraints: DataFrame, recommended: DataFrame, products: DataFrame, *, key: str = "order_id"
) -> DataFrame:
    """i-th constraint with the i-th recommended product, null where missing."""
    recs = recommended.select(key, "slot", F.col("product_id").alias("rec_id"))
    known = products.select(F.col("product.product_id").alias("rec_id"), "product")
    return constraints.join(recs, [key, "slot"], "left").join(known, "rec_id", "left")


def eval_baskets(scored: DataFrame, *, key: str = "order_id") -> DataFrame:
    """Mean scores over the constraints of a query, after ``rule_score``.

    Also ``shop`` (every constraint answered, one shop) and the totals that
    the budget test needs.
    """
    found = F.col("product").isNotNull()
    n = F.count("*")

    def share(x: Column) -> Column:
        return F.sum(F.when(found, x).otherwise(0.0)) / n

    shop = F.when(found, F.col("product.shop_id"))
    return scored.groupBy(key).agg(
        n.alias("n_items"),
        F.count_if(~found).alias("n_missing"),
        F.count_if(found).alias("n_known"),
        F.round(F.coalesce(F.sum("product.price"), F.lit(0.0)), 2).alias("total"),
        F.min(shop).alias("shop_min"),
        F.max(shop).alias("shop_max"),
        (F.count_if(found) / n).alias("product_score"),
        share(F.col("gt")).alias("gt"),
        share(F.col("rule")).alias("rule"),
        *[share(field_score(f)).alias(f) for f in FIELDS],
        (
            (F.count_if(found) == n) & F.coalesce(F.min(shop) == F.max(shop), F.lit(False))
        ).cast("int").alias("shop"),
    )


def eval_product(scored: DataFrame) -> DataFrame:
    """Scores of the first recommended product only, after ``rule_score``."""
    found = F.col("product").isNotNull()
    return scored.select(
        "order_id",
        found.cast("int").alias("product_score"),
        F.when(found, F.col("gt")).otherwise(0).alias("gt"),
        F.when(found, F.col("rule")).otherwise(0.0).alias("rule"),
        *[F.when(found, field_score(f)).otherwise(0.0).alias(f) for f in FIELDS],
    )


def eval_web(
    df: DataFrame,
    *,
    wanted_id: str,
    recommended: str,
    keyword: str,
    title: str,
    description: str,
    response: str,
    similarity: str,
    title_threshold: float = 0.8,
) -> DataFrame:
    """Keyword, title and response scores of one recommended product."""

    def has(text: str) -> Column:
        return F.coalesce(F.contains(F.lower(F.col(text)), F.lower(F.col(keyword))), F.lit(False)).cast("int")

    known = F.col(title).isNotNull()
    exact = F.coalesce(F.col(wanted_id) == F.col(recommended), F.lit(False)) & known
    scored = df.withColumns(
        {
            "have_recommend": (F.coalesce(F.col(recommended), F.lit("")) != "").cast("int"),
            "gt": F.coalesce(F.contains(F.col(recommended), F.col(wanted_id)), F.lit(False)).cast("int"),
            "kw": F.when(exact, 1).when(known, F.greatest(has(title), has(description))).otherwise(0),
            "title_score": F.when(exact, 1)
            .when(known, (F.coalesce(F.col(similarity), F.lit(0.0)) >= title_threshold).cast("int"))
            .otherwise(0),
        }
    )
    return scored.withColumn("response_score", F.greatest("kw", has(response))).withColumn(
        "rule", (F.col("kw") + F.col("title_score")) / 2.0
    )


def success_rates(df: DataFrame) -> DataFrame:
    """``paper_asr`` (rule and budget) and ``terminal_asr`` (also ended with success)."""
    paper = ((F.col("rule") >= 1) & (F.col("within_budget") >= 1)).cast("int")
    return df.withColumn("paper_asr", paper).withColumn(
        "terminal_asr", F.col("paper_asr") * F.coalesce(F.col("terminate_success").cast("int"), F.lit(0))
    )


def evaluation_report(df: DataFrame, *, task: str, by: list[str] = ()) -> DataFrame:
    """Rates and means over scored queries; success depends on the task."""
    gate = {
        "product": F.col("rule") >= 1,
        "shop": (F.col("rule") >= 1) & (F.col("shop") >= 1),
        "voucher": (F.col("rule") >= 1) & (F.col("within_budget") >= 1),
    }[task]
    means = [F.avg(f).alias(f"{f}_score") for f in ["product_score", "rule", *FIELDS] if f != "product_score"]
    return df.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        F.avg((F.col("gt") >= 1).cast("int")).alias("gt_rate"),
        F.avg(gate.cast("int")).alias("success_rate"),
        F.avg("product_score").alias("product_score"),
        *means,
    )


def numeric_summary(df: DataFrame, metrics: list[str], *, by: list[str] = ()) -> DataFrame:
    """Mean, both variances, min, max and missing count per metric.

    Metrics are unpivoted inside the row, so all of them take one shuffle.
    """
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
        ).alias("_m"),
    ).select(*by, "_m.*")
    x = F.col("x")
    return long.groupBy(*by, "metric").agg(
        F.count(x).alias("n"),
        F.count_if(x.isNull()).alias("missing"),
        F.avg(x).alias("mean"),
        var_population(x).alias("variance"),
        var_sample(x).alias("sample_variance"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def aggregate_reports(reports: DataFrame, *, model: str, weight: str, metrics: list[str]) -> DataFrame:
    """Means per model weighted by the number of scored queries; 0 without any."""
    total = F.sum(weight)
    return reports.groupBy(model).agg(
        total.alias("num_scored"),
        *[
            F.when(total > 0, F.sum(F.col(m) * F.col(weight)) / total).otherwise(0.0).alias(f"{m}_weighted_mean")
            for m in metrics
        ],
    )


def set_overlap(left: DataFrame, right: DataFrame, *, key: str, item: str, partitions: int | None = None) -> DataFrame:
    """Recall, precision and F1 of two item sets per key, zero-safe.

    Both sides are counted as rows, so no set is ever held in memory. A key's
    items are dealt by hash to at most ``SALTS`` tasks, and only their counts
    meet. Rows lie in ``partitions`` pieces if given: with a number that grows
    with the rows, a task's memory does not.
    """
    tagged = left.select(key, item, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, item, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    pieces = [partitions] if partitions else []
    dealt = tagged.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(SALTS))).repartition(*pieces, key, "_salt")
    items = dealt.groupBy(key, "_salt", item).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    parts = items.groupBy(key, "_salt").agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("n_both")
    )
    sums = parts.repartition(*pieces, key).groupBy(key).agg(*[F.sum(c).alias(c) for c in ["n_left", "n_right", "n_both"]])
    recall = F.when(F.col("n_right") > 0, F.col("n_both") / F.col("n_right")).otherwise(0.0)
    precision = F.when(F.col("n_left") > 0, F.col("n_both") / F.col("n_left")).otherwise(0.0)
    out = sums.withColumns({"recall": recall, "precision": precision})
    both = F.col("recall") + F.col("precision")
    return out.withColumn(
        "f1", F.when(both > 0, 2 * F.col("recall") * F.col("precision") / both).otherwise(0.0)
    )


def attribute_match(product: Column, constraint: Column) -> Column:
    """All wanted attribute values and SKU values are present (text normalised)."""

    def norm(x: Column) -> Column:
        return F.lower(normalize_space(x))

    wanted = F.filter(
        F.transform(
            F.flatten(F.transform(constraint["attributes"], _attribute_pairs)),
            lambda w: F.struct(w["k"].alias("k"), norm(w["v"]).alias("v")),
        ),
        lambda w: w["v"] != "",
    )
    have = F.transform(
        _attribute_pairs(product["attributes"]), lambda w: F.struct(w["k"].alias("k"), norm(w["v"]).alias("v"))
    )
    wanted_sku = F.filter(
        F.transform(F.flatten(F.transform(constraint["sku_options"], F.map_values)), norm), lambda v: v != ""
    )
    have_sku = F.transform(F.flatten(F.transform(F.map_values(product["sku_options"]), F.map_values)), norm)
    return F.forall(wanted, lambda w: F.array_contains(have, w)) & F.forall(
        wanted_sku, lambda v: F.array_contains(have_sku, v)
    )


def greedy_match_count(matches: Column) -> Column:
    """Matched pairs when each product takes the first unused fitting constraint.

    ``matches`` holds, per recommended product in order, the ascending numbers
    of the constraints it fits.
    """
    none = F.array().cast("array<int>")
    used = F.aggregate(
        matches,
        none,
        lambda acc, fits: F.concat(acc, F.slice(F.array_except(fits, acc), 1, 1)),
    )
    return F.size(used)


def progress_score(df: DataFrame) -> DataFrame:
    """Chained minima over find, view, budget, recommend, terminate; weighted sum."""
    staged = (
        df.withColumn("find_correct", F.least("workflow_valid", "search_gold_recall"))
        .withColumn("view_confirmed", F.least("find_correct", "verify_relevance_f1"))
        .withColumn(
            "budget_correct",
            F.least(
                "view_confirmed",
                "budget_ids_viewed",
                "shop_constraint_correct",
                "budget_attempt_quality",
                "budget_recomputed_correct",
                "budget_numeric_alignment",
                "within_budget_correct",
            ),
        )
        .withColumn(
            "recommend_correct", F.least("budget_correct", "recommended_ids_budgeted", "recommend_relevance_f1")
        )
        .withColumn(
            "terminate_complete",
            F.least("recommend_correct", "terminate_after_valid_recommend", "terminate_success"),
        )
    )
    return staged.withColumn("progress", _weighted(PROGRESS_WEIGHTS))


def _weighted(weights: dict[str, float]) -> Column:
    terms = [F.col(c) * w for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def protocol_weight(
    global_step: Column, total_steps: Column, *, start: float = 0.2, fraction: float = 0.1, anneal_steps: float = 0.0
) -> Column:
    """Weight that falls to 0 over the first part of a run."""
    span = F.lit(float(anneal_steps)) if anneal_steps > 0 else F.coalesce(total_steps, F.lit(0)) * fraction
    left = start * (1 - F.coalesce(global_step, F.lit(0)) / span)
    return F.when(span <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), left))


def task_reward(df: DataFrame) -> DataFrame:
    """Progress minus penalties, at most 0 when protocol or workflow is broken."""
    has_rec = F.col("recommended_count") > 0
    distance = F.abs(F.col("recommended_count") - F.col("expected_count"))
    penalties = (
        STEP_PENALTY * F.greatest(F.lit(1), F.col("steps"))
        + F.when(has_rec & (F.col("recommend_relevance_f1") == 0), 0.15).otherwise(0.0)
        + F.when(has_rec & (F.col("expected_count") > 0), F.least(F.lit(0.24), 0.08 * distance)).otherwise(0.0)
        + F.when((F.col("terminate_success") >= 1) & ~has_rec, 0.10).otherwise(0.0)
        + 0.05 * (1 - F.col("tool_valid"))
    )
    raw = F.col("progress") - F.col("penalties")
    broken = (F.col("protocol") < 1) | (F.col("workflow_valid") < 1)
    return (
        df.withColumn("penalties", penalties)
        .withColumn("task", F.when(broken, F.least(raw, F.lit(0.0))).otherwise(raw))
        .withColumn("reward", F.col("task") + F.col("protocol_weight") * F.col("protocol"))
    )


def failure_mode() -> Column:
    """First reason a trajectory did not succeed."""
    done = F.col("terminate_success") >= 1
    return (
        F.when(F.col("final_success") >= 1, "success")
        .when(F.col("workflow_valid") < 1, "workflow_invalid")
        .when(F.col("protocol") < 1, "protocol_invalid")
        .when(F.col("search_gold_recall") < 1, "search_recall_gap")
        .when(F.col("recommended_count") <= 0, "no_recommendation")
        .when((F.col("recommend_relevance_f1") < 1) & done, "final_selection_after_full_recall_gap")
        .when(F.col("recommend_relevance_f1") < 1, "selection_after_full_recall_gap")
        .when(F.col("recommended_within_budget") < 1, "budget_gap")
        .when(~done, "termination_gap")
        .otherwise("other_failure")
    )


def failure_mode_summary(df: DataFrame, metrics: list[str], *, mode: str = "failure_mode", by: list[str] = ()) -> DataFrame:
    """Count and mean metrics per failure mode; a missing mode is named so."""
    name = F.coalesce(F.col(mode), F.lit("missing")).alias(mode)
    return df.groupBy(*by, name).agg(
        F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics]
    )


def skiplist_problems(report: DataFrame, skips: DataFrame, *, key: str) -> DataFrame:
    """Skip entries that are listed twice or unknown to the report."""
    dup = skips.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("problem"))
    unknown = skips.select(key).distinct().join(report, key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    return dup.unionByName(unknown)


def with_skiplist(report: DataFrame, skips: DataFrame, metrics: list[str], *, key: str) -> DataFrame:
    """Summary rows ``full``, ``kept`` and ``skipped``."""
    flagged = report.join(skips.select(key).distinct().withColumn("_skip", F.lit(True)), key, "left")
    scope = F.array(F.lit("full"), F.when(F.col("_skip"), "skipped").otherwise("kept"))
    return (
        flagged.withColumn("scope", F.explode(scope))
        .groupBy("scope")
        .agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics])
    )


# conditions of the reward audit, by name
AUDIT_CLASSES = {
    "wrong_final_high": "recommended_count > 0 and recommend_gold_f1 = 0 and new_task > 0.20",
    "long_list_high": "recommended_count > expected_count and recommend_gold_f1 > 0 and new_task > 0.35",
    "partial_signal_lost": "(search_gold_recall > 0 or select_gold_f1 > 0 or verify_gold_f1 > 0 or recommend_gold_f1 > 0)"
    " and new_task < -0.05",
    "old_wrong_final_high": "old_task is not null and recommended_count > 0 and recommend_gold_f1 = 0 and old_task > 1.0",
}


def reward_design_audit(df: DataFrame, *, classes: dict[str, str] = AUDIT_CLASSES, by: list[str] = ()) -> DataFrame:
    """Counts per contradiction class in one pass."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg("new_task").alias("task_mean"),
        var_population(F.col("new_task")).alias("task_var"),
        F.avg("old_task").alias("old_task_mean"),
        *[F.count_if(F.expr(cond)).alias(f"{name}_count") for name, cond in classes.items()],
    )


def reward_design_examples(
    df: DataFrame, *, key: str, k: int = 12, classes: dict[str, str] = AUDIT_CLASSES
) -> DataFrame:
    """First k rows of each contradiction class."""
    names = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in classes.items()]))
    return top_k(df.withColumn("audit_class", F.explode(names)), ["audit_class"], [F.asc(key)], k, name="rank")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared items over all items, counting repeats; 1 for equal lists, 0 for one empty list."""

    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    shared = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x))
    )
    return (
        F.when(a == b, 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def _overlap(a: list, b: list) -> float:
    if a == b:
        return 1.0
    shared = sum((Counter(a) & Counter(b)).values())
    return shared / (len(a) + len(b) - shared) if a and b else 0.0


def _pair_score(wanted: dict, given: dict) -> float:
    """Overlap of parameter names plus overlap of the values' words."""
    score = _overlap(list(wanted), list(given))
    for name in wanted.keys() & given.keys():
        a, b = wanted[name], given[name]
        if isinstance(a, str) and isinstance(b, str):
            score += _overlap(a.replace(",", " ").split(" "), b.replace(",", " ").split(" "))
        elif type(a) is int and type(b) is int:
            score += float(a == b)
    return score


@F.pandas_udf(T.DoubleType())
def tool_call_similarity(wanted: pd.Series, given: pd.Series) -> pd.Series:
    """Similarity of two JSON call lists in [-3, 3]; greedy best pairing by name."""

    def one(wanted_json: str, given_json: str) -> float:
        left, right = json.loads(wanted_json), json.loads(given_json)
        if left == right:
            return 3.0
        reached = _overlap([c["name"] for c in left], [c["name"] for c in right])
        possible = 1.0 + sum(1.0 + len(c["parameters"]) for c in left)
        free = dict(enumerate(right))
        for call in left:
            scores = [
                (_pair_score(call["parameters"], other["parameters"]), -i)
                for i, other in free.items()
                if other["name"] == call["name"]
            ]
            best, index = max(scores, default=(0.0, 0))
            if best > 0:
                reached += best
                del free[-index]
        return 6.0 * reached / possible - 3.0

    return pd.Series([one(a, b) for a, b in zip(wanted, given)], dtype="float64")


def length_score(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """1 / steps when the last step terminates, else 0."""
    steps = calls.groupBy(by, "step").agg(F.max((F.col("name") == "terminate").cast("int")).alias("ends"))
    per = steps.groupBy(by).agg(F.count("*").alias("n_steps"), F.max(F.struct("step", "ends")).alias("last"))
    return per.select(
        by, "n_steps", F.when(F.col("last.ends") == 1, 1.0 / F.col("n_steps")).otherwise(0.0).alias("length_score")
    )


def think_length_score(text: Column, *, low: float = 0.0, high: float = 1.0, full_words: int = 512) -> Column:
    """Words between the last think tag and its end, over 512, at most 1, scaled."""
    tagged = F.contains(text, F.lit("<think>")) & F.contains(text, F.lit("</think>"))
    inner = F.substring_index(F.substring_index(text, "<think>", -1), "</think>", 1)
    share = F.least(F.round(word_count(inner) / full_words, 2), F.lit(1.0))
    return F.when(tagged, share * (high - low) + low).otherwise(low)


def rescore_from_columns(df: DataFrame, truth: DataFrame, *, key: str = "expected_ids") -> DataFrame:
    """Progress and task from stored metric columns, next to the old values."""

    def metric(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    out = (
        df.withColumn("approx_find_correct", metric("search_gold_recall"))
        .withColumn("approx_view_confirmed", F.least(F.col("approx_find_correct"), metric("verify_relevance_f1")))
        .withColumn(
            "approx_budget_correct",
            F.least(
                F.col("approx_view_confirmed"),
                metric("shop_constraint_correct"),
                metric("budget_attempt_quality"),
                metric("budget_recomputed_correct"),
                metric("budget_numeric_alignment"),
                metric("within_budget_correct"),
            ),
        )
        .withColumn("approx_recommend_correct", F.least(F.col("approx_budget_correct"), metric("recommend_relevance_f1")))
        .withColumn(
            "approx_terminate_complete",
            F.least(F.col("approx_recommend_correct"), metric("terminate_after_valid_recommend")),
        )
    )
    out = out.withColumn("approx_progress", _weighted({f"approx_{c}": w for c, w in PROGRESS_WEIGHTS.items()}))
    raw = F.col("approx_progress") - metric("penalties")
    out = out.withColumn("approx_task", F.when(metric("protocol") < 1, F.least(raw, F.lit(0.0))).otherwise(raw))
    known = truth.select(key).distinct().withColumn("_known", F.lit(1))
    return out.join(known, key, "left").withColumn("missing_truth", F.col("_known").isNull().cast("int")).drop("_known")
