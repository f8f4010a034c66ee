"""Splits, query features, audits and leakage (J family)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_hex, hash_index
from cartlight.functions.ranking import BROADCAST_ROWS, ordered_sum, top_k
from cartlight.functions.text import normalize_space, tokens, word_count
from cartlight.operators.matching import EQUAL, match_nearest
from cartlight.session import materialize

# fixed values: required openers of a generated query
OPENERS = {
    "im_looking": "I'm looking for",
    "looking_for": "Looking for",
    "show_me": "Show me",
    "find": "Find",
}
SUFFIX_MARKS = ("My budget is only", "voucher with the following rules")


def largest_remainder(strata: DataFrame, *, total: Column | int, exact: Column, cap: Column | None = None, tie: list[Column]) -> DataFrame:
    """Add ``quota``: floor of ``exact``, the rest to the largest fractions.

    One row per stratum; the ranking window sees strata, not data rows.
    """
    base = F.floor(exact) if cap is None else F.least(F.floor(exact), cap)
    out = strata.withColumns({"_exact": exact, "_base": base})
    left = (total if isinstance(total, Column) else F.lit(total)) - F.sum("_base").over(Window.partitionBy())
    can = F.lit(True) if cap is None else F.col("_base") < cap
    order = Window.partitionBy(can).orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), *tie)
    extra = can & (F.row_number().over(order) <= left)
    return out.withColumn("quota", (F.col("_base") + extra.cast("int")).cast("bigint")).drop("_exact", "_base")


def stratified_split(df: DataFrame, *, key: str, strata: list[str], val_size: float, seed: str = "0") -> DataFrame:
    """``split`` is ``val`` for a proportional share of every stratum, else ``train``."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    n = df.agg(F.count("*")).scalar()
    want = F.when(F.lit(val_size) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n * val_size))).cast("bigint")
    quotas = largest_remainder(
        sizes,
        total=want,
        exact=F.col("_size") * want / n,
        cap=F.col("_size"),
        tie=[F.desc("_size"), *[F.desc(c) for c in strata]],
    )
    ranked = hash_index(df, key, seed, name="_rank", by=tuple(strata))
    joined = ranked.join(quotas.select(*strata, "quota"), strata)
    return joined.withColumn("split", F.when(F.col("_rank") <= F.col("quota"), "val").otherwise("train")).drop("_rank", "quota")


def trajectory_split(df: DataFrame, *, key: str, val_size: float, seed: str = "0") -> DataFrame:
    """Whole trajectories on one side, chosen by hash order of their id."""
    ids = df.select(key).distinct()
    n = ids.agg(F.count("*")).scalar()
    want = F.when(F.lit(val_size) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n * val_size)))
    ranked = hash_index(ids, key, seed, name="_rank").withColumn(
        "split", F.when(F.col("_rank") <= want, "val").otherwise("train")
    )
    return df.join(ranked.select(key, "split"), key)


def query_features(df: DataFrame) -> DataFrame:
    """Slack and threshold ratios, difficulty buckets and constraint complexity.

    Columns used: budget, price_after_voucher, threshold, total_price,
    constraint_count.
    """
    slack = F.coalesce("budget", F.lit(0.0)) - F.coalesce("price_after_voucher", F.lit(0.0))
    ratio = F.when(F.col("budget") != 0, slack / F.col("budget"))
    threshold = F.when(F.col("total_price") != 0, F.coalesce("threshold", F.lit(0.0)) / F.col("total_price"))
    n = F.col("constraint_count")
    return df.withColumns(
        {
            "budget_slack": slack,
            "budget_slack_ratio": ratio,
            "threshold_ratio": threshold,
            "budget_difficulty": F.when(ratio <= 0.03, "hard").when(ratio <= 0.06, "medium").otherwise("easy"),
            "threshold_difficulty": F.when(threshold >= 0.80, "hard").when(threshold >= 0.50, "medium").otherwise("easy"),
            "constraint_complexity": F.when(n <= 5, "low").when(n <= 9, "medium").otherwise("high"),
        }
    )


def distribution(df: DataFrame, dimensions: list[str], *, by: list[str] = ()) -> DataFrame:
    """Counts per bucket over several dimensions, in one pass."""
    cells = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("None")).alias("bucket")) for d in dimensions]
    )
    return df.select(*by, F.explode(cells).alias("c")).groupBy(*by, "c.dimension", "c.bucket").agg(F.count("*").alias("n"))


def product_overlap(lines: DataFrame, *, split: str, test: str = "test", query: str = "query_id", product: str = "product_id") -> DataFrame:
    """Test lines whose product also occurs outside the test split."""
    outside = lines.filter(F.col(split) != test).select(product).distinct()
    return lines.filter(F.col(split) == test).join(outside, product, "left_semi").select(query, product)


def swap_repair(
    features: DataFrame,
    lines: DataFrame,
    *,
    split: str,
    stratum: list[str],
    distance: list[tuple[str, str]] | None = None,
    reserved: tuple[str, ...] = (),
    query: str = "query_id",
    seed: str = "0",
) -> DataFrame:
    """A replacement for every conflicting test query: ``removed, replacement, exact``.

    Candidates are outside the test split and the ``reserved`` ones, and all
    their products occur once. In order of their ids the conflicts take the
    nearest unused candidate: one of their stratum, else by ``distance`` (see
    ``match_nearest``; the stratum's columns by default). Conflicts beyond the
    number of candidates have a null replacement.
    """
    conflicts = product_overlap(lines, split=split, query=query).select(query).distinct()
    counts = lines.groupBy("product_id").agg(F.count("*").alias("_c"))
    shared = lines.join(counts.filter("_c > 1"), "product_id", "left_semi").select(query).distinct()
    candidates = features.filter(~F.col(split).isin("test", *reserved)).join(shared, query, "left_anti")
    wanted = features.join(conflicts, query, "left_semi")
    found = match_nearest(wanted, candidates, key=query, stratum=stratum, distance=distance or [(c, EQUAL) for c in stratum], seed=seed)
    return found.select(F.col(query).alias("removed"), F.col("match").alias("replacement"), "exact")


def assert_partition(parts: DataFrame, universe: DataFrame, *, key: str, split: str, lines: DataFrame | None = None) -> DataFrame:
    """Counts that must be zero: rows in two splits, missing rows, foreign rows, leaked products."""
    twice = parts.groupBy(key).count().filter("count > 1").agg(F.lit("in_two_splits").alias("rule"), F.count("*").alias("n"))
    missing = universe.join(parts, key, "left_anti").agg(F.lit("missing").alias("rule"), F.count("*").alias("n"))
    foreign = parts.join(universe, key, "left_anti").agg(F.lit("foreign").alias("rule"), F.count("*").alias("n"))
    out = twice.unionByName(missing).unionByName(foreign)
    if lines is not None:
        leaked = product_overlap(lines, split=split).select("product_id").distinct()
        out = out.unionByName(leaked.agg(F.lit("leaked_products").alias("rule"), F.count("*").alias("n")))
    return out


def require_zero(checks: DataFrame) -> DataFrame:
    """The same checks, failing when a count is not zero."""
    bad = F.raise_error(F.concat(F.lit("partition rule broken: "), F.col("rule"))).cast("bigint")
    return checks.withColumn("n", F.when(F.col("n") > 0, bad).otherwise(F.col("n")))


def candidate_audit(
    queries: DataFrame,
    plans: DataFrame,
    plan_products: DataFrame,
    excluded: DataFrame,
    *,
    model: str,
    min_title: int = 20,
    order: str = "position",
) -> DataFrame:
    """Named reasons against each generated query.

    ``queries``: sample_id, position, query, reward, voucher (comparable text),
    model, status, opener. ``plans``: sample_id, plan_reward, plan_voucher, the
    voucher columns, total, price_after_voucher, n_shops. ``plan_products``:
    sample_id, product_id, title.
    """
    q = queries.withColumn("_norm", F.lower(normalize_space(F.coalesce("query", F.lit("")))))
    first = q.groupBy("_norm").agg(F.min(order).alias("_first"))
    banned = excluded.select("product_id").distinct().withColumn("_banned", F.lit(1))
    title = F.lower(normalize_space(F.coalesce("title", F.lit(""))))
    hits = (
        plan_products.join(banned, "product_id", "left")
        .join(q.select("sample_id", "query", "_norm"), "sample_id")
        .groupBy("sample_id")
        .agg(
            F.max(F.coalesce("_banned", F.lit(0))).alias("_overlap"),
            F.max(F.contains("query", "product_id").cast("int")).alias("_leak"),
            F.max(((F.length(title) >= min_title) & F.contains(F.col("_norm"), title)).cast("int")).alias("_copied"),
        )
    )
    joined = q.join(first, "_norm").join(plans.withColumn("_plan", F.lit(1)), "sample_id", "left").join(hits, "sample_id", "left")
    text = F.coalesce("query", F.lit(""))
    voucher = F.col("_plan").isNotNull() & F.col("voucher_type").isNotNull()
    expected = F.when(F.col("discount_type") == "fixed", F.col("total") - F.col("face_value")).otherwise(
        F.greatest(F.col("total") * (1 - F.col("discount")), F.col("total") - F.col("cap"))
    )
    opener_ok = F.lit(True)
    for name, start in OPENERS.items():
        opener_ok = F.when(F.col("opener") == name, text.startswith(start)).otherwise(opener_ok)
    # fixed values: the names of the reasons
    rules = [
        ("missing_plan", F.col("_plan").isNull()),
        ("empty_query", F.trim(text) == ""),
        ("duplicate_query", F.col(order) > F.col("_first")),
        ("wrong_generator_model", ~F.col("model").eqNullSafe(F.lit(model))),
        ("generator_status_not_accepted", ~F.col("status").eqNullSafe(F.lit("accepted"))),
        ("reward_changed_by_generator", ~F.col("reward").eqNullSafe(F.col("plan_reward"))),
        ("voucher_changed_by_generator", ~F.col("voucher").eqNullSafe(F.col("plan_voucher"))),
        ("missing_programmatic_voucher_suffix", ~(F.contains(text, F.lit(SUFFIX_MARKS[0])) & F.contains(text, F.lit(SUFFIX_MARKS[1])))),
        ("opener_mismatch", ~opener_ok),
        ("test_product_overlap", F.col("_overlap") == 1),
        ("product_id_leakage", F.col("_leak") == 1),
        ("full_title_copied", F.col("_copied") == 1),
        ("voucher_price_mismatch", voucher & (F.abs(expected - F.col("price_after_voucher")) > 1e-6)),
        ("budget_infeasible", voucher & (F.col("price_after_voucher") > F.col("budget"))),
        ("threshold_infeasible", voucher & (F.col("threshold") > F.col("total"))),
        ("shop_scope_infeasible", voucher & (F.col("voucher_type") == "shop") & (F.col("n_shops") != 1)),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return joined.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0).drop(
        "_norm", "_first", "_plan", "_overlap", "_leak", "_copied"
    )


def audit_reasons(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def audit_report(audit: DataFrame) -> DataFrame:
    """Totals and nearest-rank word counts of the eligible queries.

    Word counts are small integers, so they are counted before they are ranked.
    """
    # the audit is read once
    seen = audit.select("eligible", F.when(F.col("eligible"), word_count(F.col("query"))).alias("w"))
    classes = materialize(seen.groupBy("eligible", "w").agg(F.count("*").alias("n")), "audit-words")
    counts = classes.filter("eligible").select("w", "n")
    # ranking over the distinct word counts
    hi = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("w"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    ranked = counts.select("w", hi.alias("hi"), (hi - F.col("n")).alias("lo"), total.alias("total"))

    def pick(q: float) -> Column:
        at = F.bround((F.col("total") - 1) * q)
        return F.max(F.when((F.col("lo") <= at) & (at < F.col("hi")), F.col("w")))

    lengths = ranked.agg(F.min("w").alias("min_words"), pick(0.5).alias("p50_words"), pick(0.95).alias("p95_words"), F.max("w").alias("max_words"))
    generated, eligible, repair = (F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) for which in (F.lit(True), F.col("eligible"), ~F.col("eligible")))
    rate = F.when(eligible + repair > 0, eligible / (eligible + repair))
    sums = classes.agg(generated.alias("generated"), eligible.alias("static_eligible"), repair.alias("repair"), rate.alias("eligible_rate"))
    return sums.join(F.broadcast(lengths))


def coverage_select(features: DataFrame, *, key: str, dimensions: list[str], bonus: Column, k: int, tie: list[Column], classes: int | None = None, depth: int = 2) -> DataFrame:
    """k rows chosen one by one for what they add: sum of 1/(1 + times covered) plus a bonus; ties by ``tie``, then key.

    Exact for any k, in about log(k) jobs. Rows alike in the dimensions (a
    class) differ by bonus and tie only, so they can be chosen in that order
    alone, and at most k of them. A class never gains: what its first row adds
    at the start bounds it for good. So the classes that start best come to
    the driver first (``classes`` of them, 4 * k by default, ``depth`` rows
    each); twice as many come when a bound of the others reaches the best row
    held, and twice the rows when a class runs out. Null is a value like any
    other. Bonuses count to nine places.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")).alias(f"_d{i}") for i, d in enumerate(dimensions)]
    names, ties = [f"_d{i}" for i in range(len(dimensions))], [f"_t{i}" for i in range(len(tie))]
    rows = features.select(F.col(key).alias("_key"), F.round(bonus, 9).alias("_bonus"), *cells, *(t.alias(n) for t, n in zip(tie, ties)))
    ranked = top_k(rows, names, [F.desc_nulls_last("_bonus"), *(F.asc(t) for t in ties), F.asc("_key")], k, name="_rank")
    ranked = materialize(ranked, "class-rows")
    heads = ranked.filter("_rank = 1").select(*names, F.col("_bonus").alias("_first"))
    n_classes, classes = heads.count(), classes or 4 * k

    def order(row) -> tuple:
        return tuple((row[t] is not None, row[t]) for t in ties) + (row["_key"],)

    def fetch() -> tuple[dict, float | None]:
        """Rows of the best classes by class, best first, and what the first class left out starts with."""
        best = heads.orderBy(F.desc_nulls_last("_first"), *names).limit(classes + 1).collect()
        left = best[classes]["_first"] if len(best) > classes else None
        wanted = features.sparkSession.createDataFrame(best[:classes], heads.schema).select(*names) if best else heads.select(*names)
        held: dict = {}
        for row in ranked.filter(F.col("_rank") <= depth).join(F.broadcast(wanted), names).collect():  # classes x depth rows at most
            held.setdefault(tuple(row[n] for n in names), []).append(row)
        return {c: sorted(rs, key=lambda r: r["_rank"]) for c, rs in held.items()}, left

    held, left = fetch()
    taken: dict = {}  # rows chosen of a class
    covered: dict = {}
    chosen: list = []
    while len(chosen) < k and held:
        open_ = [(c, rs[taken.get(c, 0)]) for c, rs in held.items() if taken.get(c, 0) < len(rs)]
        best = None
        for c, row in open_:
            score = round(sum(1.0 / (1.0 + covered.get((i, v), 0)) for i, v in enumerate(c)) + (row["_bonus"] or 0.0), 9)
            place = (-score, order(row))
            if best is None or place < best[0]:
                best = (place, c, row)
        score = -best[0][0] if best else None
        short = any(taken.get(c, 0) == len(rs) == depth for c, rs in held.items()) and depth < k
        outside = classes < n_classes and (score is None or len(dimensions) + (left or 0.0) >= score - 1e-9)
        if short or outside:
            depth, classes = depth * (2 if short else 1), classes * (2 if outside else 1)
            held, left = fetch()
            continue
        if best is None:
            break
        chosen.append(best[2]["_key"])
        taken[best[1]] = taken.get(best[1], 0) + 1
        for cell in enumerate(best[1]):
            covered[cell] = covered.get(cell, 0) + 1
    schema = f"_picked {features.schema[key].dataType.simpleString()}, pick int"
    picks = features.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(chosen)], schema)
    return features.join(F.broadcast(picks), F.col(key) == F.col("_picked")).drop("_picked")


def joint_panels(features: DataFrame, *, key: str, strata: list[str], size: int, panels: tuple[str, str] = ("calibration", "validation"), seed: str = "0") -> DataFrame:
    """Two disjoint panels of ``size`` rows, each with its proportional share of every stratum."""
    sizes = features.groupBy(*strata).agg(F.count("*").alias("_size"))
    n = features.agg(F.count("*")).scalar()
    quotas = largest_remainder(
        sizes, total=size, exact=F.col("_size") * size / n, cap=F.floor(F.col("_size") / 2), tie=[F.desc("_size"), *[F.desc(c) for c in strata]]
    )
    ranked = hash_index(features, key, seed, name="_rank", by=tuple(strata)).join(quotas.select(*strata, "quota"), strata)
    first = F.col("_rank") <= F.col("quota")
    second = F.col("_rank") <= 2 * F.col("quota")
    return ranked.withColumn("panel", F.when(first, panels[0]).when(second, panels[1])).filter("panel is not null").drop("_rank", "quota")


def balanced_counts(sizes: np.ndarray, member: np.ndarray, size: int) -> np.ndarray:
    """Rows that two panels of ``size`` take of every cell, so that sums over groups of cells stay near their shares.

    ``sizes``: rows of a cell; ``member``: cells x groups of 0 and 1, every
    cell in one group of each margin. Both panels start with the whole part of
    their share of each cell, take units one by one where the groups miss most
    (the panels in turns), and then exchange units, within a panel or between
    the two, as long as the squares of all deviations fall. Work a step is in
    proportion to the cells.
    """
    share = member.T @ sizes * (size / sizes.sum())
    width = int(member[0].sum())
    got = np.tile(np.floor(sizes * (size / sizes.sum())).astype(np.int64), (2, 1))
    got[1] = np.minimum(got[1], sizes - got[0])
    off = got @ member - share  # panels x groups
    for turn in range(2 * size):
        for panel in (turn % 2, 1 - turn % 2):
            if got[panel].sum() < size:
                cost = np.where(sizes - got.sum(axis=0) > 0, member @ off[panel], np.inf)
                at = int(cost.argmin())
                got[panel, at] += 1
                off[panel] += member[at]
        if (got.sum(axis=1) >= size).all():
            break

    def best_move(pull: np.ndarray, gives: np.ndarray, takes: np.ndarray, weight: int) -> tuple[float, int, int]:
        """Cheapest unit from a cell that gives to one that takes; ``pull`` is each cell's sum of deviations."""
        out = np.where(gives, pull, -np.inf).argsort()[::-1][:64]
        out = out[gives[out]]
        if not len(out) or not takes.any():
            return 0.0, 0, 0
        change = 2 * (pull[None, :] - pull[out, None]) + 2 * weight * (width - member[out] @ member.T)
        change = np.where(takes[None, :], change, np.inf)
        a, b = divmod(int(change.argmin()), change.shape[1])
        return float(change[a, b]), int(out[a]), b

    while True:
        free = sizes - got.sum(axis=0) > 0
        moves = [(*best_move(member @ off[p], got[p] > 0, free, 1), p) for p in (0, 1)]
        moves.append((*best_move(member @ (off[0] - off[1]), got[0] > 0, got[1] > 0, 2), 2))
        change, a, b, kind = min(moves)
        if change > -1e-9:
            return got
        step = member[b] - member[a]
        for panel, sign in {0: [(0, 1)], 1: [(1, 1)], 2: [(0, 1), (1, -1)]}[kind]:
            got[panel, a] -= sign
            got[panel, b] += sign
            off[panel] += sign * step


def _cells(dimensions: list[str]) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")).alias(f"_d{i}") for i, d in enumerate(dimensions)]


def margin_panels(
    features: DataFrame, *, key: str, margins: list[list[str]], size: int, panels: tuple[str, str] = ("calibration", "validation"), seed: str = "0"
) -> DataFrame:
    """Two disjoint panels of ``size`` rows in which every margin, of one or several columns, is close to its share.

    Only the counts of the cells (distinct combinations of all columns) come to
    the driver; ``balanced_counts`` says how many rows a panel takes of each,
    and rows are taken by position in hash order, so a hot cell is spread.
    Proportional parts of cells round each margin by much more than one row
    where cells are many and small; here a group is off by less than one row
    unless the margins contradict each other (``margin_report`` tells). Null is
    a value like any other. Too few rows for both panels are an error.
    """
    dimensions = sorted({d for margin in margins for d in margin})
    names = [f"_d{i}" for i in range(len(dimensions))]
    marked = features.select("*", *_cells(dimensions))
    counts = marked.groupBy(*names).count().orderBy(*names).collect()
    sizes = np.array([row["count"] for row in counts], dtype=np.int64)
    if 2 * size > sizes.sum():
        raise ValueError(f"two panels of {size} rows need {2 * size} rows, there are {sizes.sum()}")
    groups: dict = {}
    held = [[groups.setdefault((m, *(row[names[dimensions.index(d)]] for d in margin)), len(groups)) for m, margin in enumerate(margins)] for row in counts]
    member = np.zeros((len(counts), len(groups)))
    for cell, columns in enumerate(held):
        member[cell, columns] = 1
    got = balanced_counts(sizes, member, size) if len(counts) else np.zeros((2, 0), dtype=np.int64)
    rows = [(*(row[n] for n in names), int(a), int(b)) for row, a, b in zip(counts, *got) if a + b]
    quotas = features.sparkSession.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", _first bigint, _second bigint")
    numbered = hash_index(marked, key, seed, name="_place", by=tuple(names))
    taken = numbered.join(F.broadcast(quotas) if len(rows) <= BROADCAST_ROWS else quotas, names).filter(F.col("_place") <= F.col("_first") + F.col("_second"))
    return taken.withColumn("panel", F.when(F.col("_place") <= F.col("_first"), panels[0]).otherwise(panels[1])).drop(*names, "_place", "_first", "_second")


def margin_report(features: DataFrame, chosen: DataFrame, *, margins: list[list[str]], size: int, panels: tuple[str, str] = ("calibration", "validation")) -> DataFrame:
    """Every group of every margin: margin, value, n rows, share of a panel, and how far each panel is off."""
    dimensions = sorted({d for margin in margins for d in margin})
    names = [F.coalesce(F.col(d).cast("string"), F.lit("null")).alias(f"_v{i}") for i, d in enumerate(dimensions)]
    # rows are read once, whatever the number of margins: cells and the chosen rows' cells are few
    taken = chosen.groupBy(*names).agg(F.lit(0).alias("_rows"), *(F.count_if(F.col("panel") == p).alias(f"_{i}") for i, p in enumerate(panels)))
    every = features.groupBy(*names).agg(F.count("*").alias("_rows"), *(F.lit(0).alias(f"_{i}") for i in range(len(panels))))
    cells = materialize(every.unionByName(taken), "margin-cells")
    total = F.broadcast(cells.agg(F.sum("_rows").alias("_total")))
    out = None
    for margin in margins:
        value = F.concat_ws("|", *(F.col(f"_v{dimensions.index(d)}") for d in margin)).alias("value")
        sums = cells.groupBy(value).agg(F.sum("_rows").alias("n"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(panels)))).filter("n > 0")
        share = F.lit(size) * F.col("n") / F.col("_total")
        off = [(F.col(f"_{i}") - share).alias(f"{p}_off") for i, p in enumerate(panels)]
        part = sums.join(total).select(F.lit(",".join(margin)).alias("margin"), "value", "n", share.alias("share"), *off)
        out = part if out is None else out.unionByName(part)
    return out


def overlong_filter(df: DataFrame, *, tokens_col: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, report of both sides)."""
    ok = F.col(tokens_col) <= limit
    report = df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"), F.max(tokens_col).alias("max_tokens"))
    return df.filter(ok), report


def to_rl_example(
    df: DataFrame, *, source: str, system_prompt: str, query: str, ground_truth: Column, extra: Column, agent: str = "tool_agent", ability: str = "shopping"
) -> DataFrame:
    """Nested training example with the ground truth as JSON text."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.select(
        F.lit(source).alias("data_source"),
        F.array(message("system", F.lit(system_prompt)), message("user", F.col(query))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.to_json(ground_truth).alias("ground_truth")).alias("reward_model"),
        extra.alias("extra_info"),
        F.lit(agent).alias("agent_name"),
    )


def enrich_example(examples: DataFrame, *, fields: dict[str, Column], split: str, key: str, seed: str = "0") -> DataFrame:
    """Features added to ``extra_info`` and a position in hash order per split."""
    extra = F.col("extra_info")
    for name, value in fields.items():
        extra = extra.withField(name, value)
    out = examples.withColumn("extra_info", extra)
    ranked = hash_index(out, key, seed, name="_i", by=(split,))
    return ranked.withColumn("extra_info", F.col("extra_info").withField("index", F.col("_i") - 1)).drop("_i")


def priority_view(train: DataFrame, groups: DataFrame, *, query: str, min_mixed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training rows of queries seen mixed often enough, report)."""
    stats = groups.groupBy(query).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "mixed").alias("mixed"))
    good = stats.filter(F.col("mixed") >= min_mixed)
    view = train.join(good, query, "left_semi")
    used = good.join(train, query, "left_semi")
    report = used.agg(
        F.count("*").alias("queries"),
        F.sum("n").alias("groups"),
        F.sum("mixed").alias("mixed_groups"),
        (F.sum("mixed") / F.sum("n")).alias("mixed_rate"),
    )
    return view, report


def contamination_scan(docs: DataFrame, titles: DataFrame, *, doc_id: str, text: str, title_id: str, title: str, words: int = 5) -> DataFrame:
    """Documents that hold a whole title of at least ``words`` words, word for word.

    The first words of each title are its anchor; documents meet titles in an
    equi-join on the anchor, and only those pairs are compared in full.
    """

    def spaced(x: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))

    t = titles.select(title_id, tokens(F.col(title)).alias("_w")).filter(F.size("_w") >= words)
    t = t.select(title_id, F.array_join(F.slice("_w", 1, words), " ").alias("_anchor"), spaced(F.col("_w")).alias("_title"))
    d = docs.select(doc_id, tokens(F.col(text)).alias("_w")).filter(F.size("_w") >= words)
    starts = F.sequence(F.lit(1), F.size("_w") - words + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, words), " ")))
    cells = d.select(doc_id, F.explode(grams).alias("_anchor"))
    # only ids travel through the anchor join; texts are fetched for its hits
    pairs = cells.join(t.select(title_id, "_anchor"), "_anchor").select(doc_id, title_id)
    full = pairs.join(d.select(doc_id, spaced(F.col("_w")).alias("_doc")), doc_id).join(t.select(title_id, "_title"), title_id)
    return full.filter(F.contains("_doc", "_title")).select(doc_id, title_id)


def strata_panel(df: DataFrame, *, strata: list[str], order: str) -> DataFrame:
    """First row of every cell."""
    rest = [c for c in df.columns if c not in strata]
    return df.groupBy(*strata).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*strata, "_r.*")


def deterministic_sample(df: DataFrame, *, key: str, k: int, seed: str = "0") -> DataFrame:
    """The k rows first in hash order; sort by the original index to show them."""
    return df.orderBy(hash_hex(F.col(key), seed), key).limit(k)


def exclusion_list(test_lines: DataFrame) -> DataFrame:
    return test_lines.select("product_id").distinct()


def exclusion_check(plan_lines: DataFrame, excluded: DataFrame) -> DataFrame:
    """Plan lines on excluded products, and products that a plan uses twice."""
    hit = plan_lines.join(excluded, "product_id", "left_semi").agg(F.lit("excluded_used").alias("rule"), F.count("*").alias("n"))
    reused = plan_lines.groupBy("product_id").count().filter("count > 1").agg(F.lit("reused").alias("rule"), F.count("*").alias("n"))
    return hit.unionByName(reused)


def hard_budget_subset(df: DataFrame, *, order: str, start: int = 1, factor: float = 1.02) -> DataFrame:
    """Rows whose budget is at most 1.02 times the price after voucher, numbered, from ``start``."""
    hard = df.filter(F.col("budget") <= F.col("price_after_voucher") * factor + 1e-9)
    numbered = ordered_sum(hard, [F.col(order)], name="hard_index")
    return numbered.filter(F.col("hard_index") >= start)
