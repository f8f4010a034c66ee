"""Planning of synthetic queries and vouchers (D family).

Random choices are hashes of a seed and a key, so a plan is the same on any
partitioning. Rows are matched by numbers instead of a serial "used" set.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.hashing import hash_index, hash_int, hash_range, hash_unit
from cartlight.functions.ranking import ordered_sum
from cartlight.functions.vectors import dot
from cartlight.session import cut_lineage, materialize

# fixed values: share of (number of products, voucher type)
PRODUCT_VOUCHER_WEIGHTS = {
    (1, "platform"): 0.15,
    (2, "platform"): 0.07,
    (2, "shop"): 0.18,
    (3, "platform"): 0.09,
    (3, "shop"): 0.21,
    (4, "platform"): 0.09,
    (4, "shop"): 0.21,
}
# fixed values: share of discount types and of difficulty buckets, ranges of the buckets
DISCOUNT_WEIGHTS = {"fixed": 0.40, "percentage": 0.60}
DIFFICULTY_WEIGHTS = {"easy": 0.25, "medium": 0.45, "hard": 0.30}
THRESHOLD_RATIO = {"easy": (0.20, 0.55), "medium": (0.50, 0.80), "hard": (0.80, 0.95)}
BUDGET_SLACK = {"easy": (1.06, 1.12), "medium": (1.03, 1.07), "hard": (1.00, 1.03)}
COMPLEXITY_WEIGHTS = {"low": 0.25, "medium": 0.50, "high": 0.25}
OPENER_WEIGHTS = {"im_looking": 0.25, "looking_for": 0.25, "show_me": 0.25, "find": 0.25}
# fixed values: (number of fields, cumulative weight) per complexity
FIELD_COUNTS = {
    "low": [(1, 0.35), (2, 1.0)],
    "medium": [(2, 0.45), (3, 1.0)],
    "high": [(3, 0.30), (4, 0.75), (5, 1.0)],
}
# fixed values: requirement text of a service; services without text are not offered
SERVICE_TEXT = {
    "freeShipping": "The product offer with free shipping service.",
    "COD": "The product offer with cash on delivery service.",
    "flashsale": "The product offer with flash sale deals.",
}
MIN_TOTAL = 100


def sampling_pool(products: DataFrame) -> DataFrame:
    """Products with an id and a positive price."""
    return products.filter((F.coalesce("product_id", F.lit("")) != "") & (F.col("price") > 0))


def quota_numbers(total: int, weights: dict) -> dict:
    """Largest-remainder quotas of a handful of weights."""
    raw = {k: total * w for k, w in weights.items()}
    quotas = {k: math.floor(v) for k, v in raw.items()}
    by_fraction = sorted(weights, key=lambda k: (raw[k] - quotas[k], raw[k]), reverse=True)
    for k in by_fraction[: total - sum(quotas.values())]:
        quotas[k] += 1
    return quotas


def expand_quota(df: DataFrame, *, key: str, name: str, weights: dict, seed: str, total: int | None = None) -> DataFrame:
    """Give every row a value so that each value has exactly its quota.

    The rows are numbered in hash order and the numbers cut into ranges, one
    per value; only the row count reaches the driver (unless given).
    """
    quotas = quota_numbers(df.count() if total is None else total, weights)
    ranked = hash_index(df, key, seed, name="_q")
    value, upto = None, 0
    for v, n in quotas.items():
        upto += n
        value = F.when(F.col("_q") <= upto, F.lit(v)) if value is None else value.when(F.col("_q") <= upto, F.lit(v))
    return ranked.withColumn(name, value).drop("_q")


def build_specs(base: DataFrame, *, key: str, seed: str = "0", complexity: bool = True) -> DataFrame:
    """Independent quota dimensions zipped into one spec per row of ``base``."""
    pairs = {f"{n}:{v}": w for (n, v), w in PRODUCT_VOUCHER_WEIGHTS.items()}
    total = base.count()
    out = expand_quota(base, key=key, name="_pair", weights=pairs, seed=f"{seed}:pair", total=total)
    out = out.withColumns(
        {
            "n_products": F.split_part("_pair", F.lit(":"), F.lit(1)).cast("int"),
            "voucher_type": F.split_part("_pair", F.lit(":"), F.lit(2)),
        }
    ).drop("_pair")
    dims = [("discount_type", DISCOUNT_WEIGHTS), ("difficulty_bucket", DIFFICULTY_WEIGHTS)]
    if complexity:
        dims.append(("constraint_complexity", COMPLEXITY_WEIGHTS))
    for name, weights in dims:
        out = expand_quota(out, key=key, name=name, weights=weights, seed=f"{seed}:{name}", total=total)
    return out


def assign_openers(df: DataFrame, *, key: str, seed: str = "0") -> DataFrame:
    """Balanced opener buckets."""
    return expand_quota(df, key=key, name="opener_bucket", weights=OPENER_WEIGHTS, seed=f"{seed}:opener")


def _sizes(specs: DataFrame) -> list[tuple[int, int]]:
    """(basket size, number of specs), the largest size first; a handful of rows on the driver."""
    rows = specs.filter("n_products > 0").groupBy("n_products").count().collect()
    return sorted(((r["n_products"], r["count"]) for r in rows), reverse=True)


def _shop_baskets(specs: DataFrame, ranked: DataFrame, *, seed: str) -> tuple[list[DataFrame], DataFrame]:
    """Baskets of one shop for the specs, size by size, and how many products each shop gave.

    ``ranked``: product_id, shop_id, place in the shop, products of the shop.
    A shop gives its products in order of their place, so what it has left is
    one number. After a size either all its specs are served or every shop
    has fewer products left than a basket of it, and later sizes only take
    more: no spec stays without products while a shop could serve it.
    """
    given = materialize(ranked.select("shop_id").distinct().withColumn("given", F.lit(0).cast("bigint")), "given")
    chunks = []
    for n, asked in _sizes(specs):
        rest = ranked.join(given, "shop_id").withColumn("turn", F.col("place") - F.col("given") - 1).filter("turn >= 0")
        basket = F.floor(F.col("turn") / n)
        rest = rest.withColumns({"basket": basket, "pos": (F.col("turn") % n + 1).cast("int")})
        rest = rest.filter((F.col("basket") + 1) * n <= F.col("products") - F.col("given"))
        name = F.concat_ws(":", F.col("shop_id").cast("string"), F.col("basket").cast("string"))
        whole = rest.filter("pos = 1").select("shop_id", "basket", name.alias("basket_id"))
        # which shops give: as many whole baskets as are asked for, by hash over all of them
        share = hash_index(whole, "basket_id", f"{seed}:{n}:shop", name="i").filter(F.col("i") <= asked).groupBy("shop_id").agg(F.count("*").alias("baskets"))
        share = materialize(share, "basket-shares")
        used = whole.join(share, "shop_id").filter("basket < baskets")
        numbered = hash_index(used, "basket_id", f"{seed}:{n}:basket", name="i")
        wanted = hash_index(specs.filter(F.col("n_products") == n), "sample_id", f"{seed}:{n}:spec", name="i")
        won = wanted.join(numbered, "i").select("sample_id", "shop_id", "basket")
        chunks.append(materialize(rest.join(won, ["shop_id", "basket"]).select("sample_id", "pos", "product_id", "shop_id"), "baskets"))
        given = materialize(given.join(share, "shop_id", "left").select("shop_id", (F.col("given") + F.coalesce("baskets", F.lit(0)) * n).alias("given")), "given")
    return chunks, given


def assign_products(specs: DataFrame, products: DataFrame, *, excluded: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """``sample_id, pos, product_id, shop_id``; no product is used twice.

    Shop specs take baskets of one shop, the largest first. Platform specs
    then take numbered slots of the unused products, the largest first. A spec
    is absent from the result (``unassigned`` lists them) only if at its turn,
    and so at the end, no shop holds enough unused products, or, for a
    platform spec, all shops together do not. Which specs of one size stay
    without products when these run short is settled by hash.
    """
    pool = products.select("product_id", "shop_id")
    if excluded is not None:
        pool = pool.join(excluded.select("product_id").distinct(), "product_id", "left_anti")
    known = pool.filter("shop_id is not null")
    counts = known.groupBy("shop_id").agg(F.count("*").alias("products"))
    ranked = materialize(hash_index(known, "product_id", f"{seed}:shop", name="place", by=("shop_id",)).join(counts, "shop_id"), "ranked-products")
    chunks, given = _shop_baskets(specs.filter("voucher_type = 'shop'"), ranked, seed=seed)
    unused = ranked.join(given, "shop_id").filter("place > given").select("product_id", "shop_id").unionByName(pool.filter("shop_id is null"))
    free = materialize(hash_index(unused, "product_id", f"{seed}:free", name="_slot"), "free-products")
    wide, first, last = specs.filter("voucher_type = 'platform'"), 0, free.count()
    for n, asked in _sizes(wide):
        served = min(asked, (last - first) // n)
        numbered = hash_index(wide.filter(F.col("n_products") == n).select("sample_id"), "sample_id", f"{seed}:platform", name="_i").filter(F.col("_i") <= served)
        slots = numbered.select("sample_id", "_i", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos"))
        slots = slots.withColumn("_slot", F.lit(first) + (F.col("_i") - 1) * n + F.col("pos"))
        chunks.append(slots.join(free, "_slot").select("sample_id", F.col("pos").cast("int").alias("pos"), "product_id", "shop_id"))
        first += served * n
    if not chunks:
        return ranked.limit(0).select(F.lit(None).cast(specs.schema["sample_id"].dataType).alias("sample_id"), F.lit(0).alias("pos"), "product_id", "shop_id")
    # the assignment is an artefact that plans and checks read many times
    return materialize(reduce(DataFrame.unionByName, chunks), "assigned-products")


def unassigned(specs: DataFrame, lines: DataFrame) -> DataFrame:
    """Specs without products."""
    return specs.join(lines.select("sample_id").distinct(), "sample_id", "left_anti")


def _by_bucket(table: dict[str, tuple[float, float]], side: int) -> Column:
    b = F.col("difficulty_bucket")
    return F.when(b == "easy", table["easy"][side]).when(b == "medium", table["medium"][side]).otherwise(table["hard"][side])


def build_voucher(df: DataFrame, *, key: str = "sample_id", total: str = "total", seed: str = "0") -> DataFrame:
    """Threshold, discount and budget per basket; baskets below 100 are dropped.

    Columns used: ``voucher_type, discount_type, difficulty_bucket`` and the total.
    """
    k, t = F.col(key), F.col(total)
    low = F.greatest(F.lit(1), F.ceil(t * _by_bucket(THRESHOLD_RATIO, 0)))
    high = F.greatest(low, F.floor(t * _by_bucket(THRESHOLD_RATIO, 1)))
    threshold = F.least(hash_range(k, low, high, f"{seed}:threshold"), F.floor(t))
    out = df.filter(t >= MIN_TOTAL).withColumn("threshold", threshold)
    th = F.col("threshold")
    face_low = F.greatest(F.lit(1), F.floor(th * 0.1))
    face = hash_range(k, face_low, F.greatest(face_low, F.floor(th * 0.5)), f"{seed}:face")
    percent = hash_range(k, F.lit(10), F.lit(50), f"{seed}:percent")
    min_cap = F.floor(th * percent / 100.0)
    cap = hash_range(k, min_cap + 1, th, f"{seed}:cap")
    fixed = F.col("discount_type") == "fixed"
    out = out.filter(fixed | (min_cap < th)).withColumns(
        {
            "face_value": F.when(fixed, face),
            "discount": F.when(~fixed, percent / 100.0),
            "cap": F.when(~fixed, cap),
        }
    )
    after = F.when(fixed, t - F.col("face_value")).otherwise(
        F.greatest(t * (1 - F.col("discount")), t - F.col("cap"))
    )
    out = out.withColumn("price_after_voucher", after)
    p = F.col("price_after_voucher")
    lower = F.greatest(F.ceil(p), F.ceil(p * _by_bucket(BUDGET_SLACK, 0)))
    upper = F.greatest(lower, F.floor(p * _by_bucket(BUDGET_SLACK, 1)))
    # every later step reads these draws several times; as a written table they
    # stay plain columns instead of ever larger nested expressions
    return cut_lineage(out.withColumn("budget", hash_range(k, lower, upper, f"{seed}:budget")))


def _number_text(x: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def describe_voucher() -> Column:
    """Three numbered sentences about the voucher columns."""
    scope = F.when(
        F.col("voucher_type") == "shop", "1. The voucher only applies to the products from the same shop."
    ).otherwise("1. The voucher applies to all products.")
    threshold = F.concat(
        F.lit("2. It is valid only when the total price of the products exceeds `"), _number_text(F.col("threshold")), F.lit("`.")
    )
    fixed = F.concat(F.lit("3. It provides a fixed discount of `"), _number_text(F.col("face_value")), F.lit("`."))
    percent = F.concat(
        F.lit("3. It provides a percentage discount of `"),
        F.round(F.col("discount") * 100).cast("int").cast("string"),
        F.lit("%` with a cap of `"),
        _number_text(F.col("cap")),
        F.lit("`."),
    )
    return F.concat_ws("\n", scope, threshold, F.when(F.col("discount_type") == "fixed", fixed).otherwise(percent))


def budget_sentence() -> Column:
    return F.concat(
        F.lit("My budget is only `"),
        _number_text(F.col("budget")),
        F.lit("`, but I have a voucher with the following rules:\n"),
        describe_voucher(),
    )


# fixed values: phrases that open the voucher part of a query, in order of preference
VOUCHER_MARKERS = [
    "but i have a voucher",
    "i have a voucher",
    "voucher with the following rules",
    "voucher rules",
]


def parse_voucher_text(df: DataFrame, *, text: str) -> DataFrame:
    """Voucher columns read back from a query, with ``parse_ok``."""
    t = F.col(text)
    low = F.lower(t)
    at = F.lit(0)
    for marker in reversed(VOUCHER_MARKERS):
        at = F.when(F.locate(marker, low) > 0, F.locate(marker, low)).otherwise(at)
    last = F.length(t) - F.length(F.substring_index(low, "voucher", -1)) - len("voucher") + 1
    at = F.when(at > 0, at).when(F.contains(low, F.lit("voucher")), last).otherwise(1)
    part = F.substr(t, at)
    number = r"`?([0-9]+(?:\.[0-9]+)?)`?"

    def find(pattern: str, where: Column) -> Column:
        return F.nullif(F.regexp_extract(where, "(?i)" + pattern, 1), F.lit("")).cast("double")

    fixed = find("fixed discount of " + number, part)
    percent = find(r"percentage discount of `?([0-9]+(?:\.[0-9]+)?)%`?", part)
    kind = F.when(fixed.isNotNull(), "fixed").when(percent.isNotNull(), "percentage")
    lowered = F.lower(part)
    out = df.withColumns(
        {
            "scope": F.when(F.contains(lowered, F.lit("same shop")), "shop").when(
                F.contains(lowered, F.lit("applies to all products")), "platform"
            ),
            "parsed_threshold": find("(?:exceeds|exceeding|over|above) " + number, part),
            "parsed_budget": find("budget is only " + number, t),
            "parsed_type": kind,
            "parsed_value": fixed,
            "parsed_rate": F.when(fixed.isNull(), percent / 100),
            "parsed_cap": F.when(fixed.isNull() & percent.isNotNull(), find("cap of " + number, part)),
        }
    )
    complete = F.col("scope").isNotNull() & F.col("parsed_threshold").isNotNull() & F.col("parsed_budget").isNotNull()
    discount = (F.col("parsed_type") == "fixed") | ((F.col("parsed_type") == "percentage") & F.col("parsed_cap").isNotNull())
    return out.withColumn("parse_ok", complete & F.coalesce(discount, F.lit(False)))


def target_field_count(complexity: Column, key: Column, *, seed: str = "0") -> Column:
    """Number of fields by weighted choice; without a complexity 2, 3-4 or 5-7."""
    u = hash_unit(key, f"{seed}:fields")
    out = None
    for name, steps in FIELD_COUNTS.items():
        pick = None
        for n, upto in steps:
            pick = F.when(u < upto, n) if pick is None else pick.when(u < upto, n)
        out = F.when(complexity == name, pick) if out is None else out.when(complexity == name, pick)
    spread = hash_int(key, f"{seed}:spread")
    free = F.when(u < 0.10, 5 + spread % 3).when(u < 0.35, F.lit(2)).otherwise(3 + spread % 2)
    return out.otherwise(free).cast("int")


def sample_constraints(df: DataFrame, *, key: str = "product_id", target: str = "target", seed: str = "0") -> DataFrame:
    """Fields a query asks for, and the numbered requirement texts.

    Candidate groups (a SKU option, one value of an attribute, a service) are
    taken in hash order until the target is reached; a group that repeats a
    key already taken is passed over. All of it is a fold over the few groups
    of the row.
    """
    k = F.col(key)

    def group(kind: str, keys: Column, values: Column, tag: Column) -> Column:
        return F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), k, F.lit(f":{kind}:"), tag)).alias("h"),
            F.lit(kind).alias("kind"),
            keys.alias("keys"),
            values.alias("vals"),
        )

    sku = F.transform(
        F.map_entries("sku_options"),
        lambda e: group("sku_options", F.map_keys(e["value"]), F.map_values(e["value"]), e["key"].cast("string")),
    )
    attr = F.transform(
        F.filter(F.map_entries("attributes"), lambda e: F.size(e["value"]) > 0),
        lambda e: group(
            "attributes",
            F.array(e["key"]),
            F.array(
                F.element_at(
                    e["value"],
                    (F.pmod(F.conv(F.substring(F.md5(F.concat(k, F.lit(":"), e["key"])), 1, 8), 16, 10).cast("bigint"), F.size(e["value"])) + 1).cast("int"),
                )
            ),
            e["key"],
        ),
    )
    service = F.transform(
        F.filter("service", lambda s: s.isin(list(SERVICE_TEXT))), lambda s: group("service", F.array(s), F.array(s), s)
    )
    groups = F.array_sort(F.concat(sku, attr, service))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(1).alias("n"), empty.alias("keys"), F.slice(groups, 1, 0).alias("taken"))

    def step(acc: Column, g: Column) -> Column:
        take = (acc["n"] < F.col(target)) & ~F.arrays_overlap(acc["keys"], g["keys"])
        return F.struct(
            F.when(take, acc["n"] + F.size(g["keys"])).otherwise(acc["n"]).alias("n"),
            F.when(take, F.concat(acc["keys"], g["keys"])).otherwise(acc["keys"]).alias("keys"),
            F.when(take, F.concat(acc["taken"], F.array(g))).otherwise(acc["taken"]).alias("taken"),
        )

    out = df.withColumn("_f", F.aggregate(groups, start, step))
    texts = F.flatten(
        F.transform(
            F.col("_f.taken"),
            lambda g: F.transform(
                F.arrays_zip(g["keys"].alias("a"), g["vals"].alias("b")),
                lambda z: F.when(g["kind"] == "service", _service_text(z["a"])).otherwise(
                    F.concat(F.lit("The `"), z["a"], F.lit("` is `"), z["b"], F.lit("`."))
                ),
            ),
        )
    )
    title = F.array(F.concat(F.lit("The `title` is `"), F.col("title"), F.lit("`.")))
    numbered = F.transform(
        F.concat(title, texts), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    )
    return out.withColumns({"chosen": F.col("_f.taken"), "field_count": F.col("_f.n"), "requirements": numbered}).drop("_f")


def _service_text(name: Column) -> Column:
    out = None
    for service, text in SERVICE_TEXT.items():
        out = F.when(name == service, text) if out is None else out.when(name == service, text)
    return out


def price_band(df: DataFrame, *, key: str = "product_id", price: str = "price", seed: str = "0") -> DataFrame:
    """``mode, lo, hi`` around the price; null when the bounds would miss it."""
    k, p = F.col(key), F.col(price)
    mode = hash_int(k, f"{seed}:mode") % 3
    down = F.floor(p - hash_range(k, F.lit(0), F.floor(p), f"{seed}:down"))
    up = F.floor(p + hash_range(k, F.lit(0), F.floor(p), f"{seed}:up"))
    lo = F.when(mode == 0, F.lit(0)).otherwise(down)
    hi = F.when(mode != 1, up)
    ok = (lo >= 0) & (p > lo) & (hi.isNull() | (p < hi))
    name = F.when(mode == 0, "less than").when(mode == 1, "greater than").otherwise("between")
    return df.withColumns({"mode": F.when(ok, name), "lo": F.when(ok, lo), "hi": F.when(ok, hi)})


def render_prompt(items: DataFrame, *, by: str, pos: str, requirements: str, template: str) -> DataFrame:
    """Template filled with the requirement blocks of a basket, numbered when there are several."""
    block = F.array_join(requirements, "\n")
    grouped = items.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), block.alias("b")))).alias("blocks")
    )
    numbered = F.transform(
        "blocks", lambda x, i: F.concat(F.lit("## Product "), (i + 1).cast("string"), F.lit("\n"), x["b"])
    )
    text = F.when(F.size("blocks") == 1, F.get("blocks", F.lit(0))["b"]).otherwise(F.array_join(numbered, "\n\n"))
    filled = F.replace(
        F.replace(F.lit(template), F.lit("<|task|>"), F.lit("one or more products")), F.lit("<|requirements|>"), text
    )
    return grouped.select(by, filled.alias("prompt"))


def title_only_cap(df: DataFrame, *, order: str, title_only: str, products: str, max_share: float) -> DataFrame:
    """Accept rows while the running count of title-only products stays within its share."""
    limit = df.agg(F.ceil(F.sum(products) * max_share)).scalar()
    summed = ordered_sum(df, [F.col(order)], weight=F.col(title_only), name="_sum")
    return summed.withColumn("accepted", (F.col(title_only) == 0) | (F.col("_sum") <= limit)).drop("_sum")


#: Choices that are made by a round each.
ROUNDS = 64


def maximin_select(vectors: DataFrame, *, key: str, embedding: str, k: int, every: int = 8) -> list:
    """Keys of k vectors, each the farthest (by cosine) from those before it.

    The first is the smallest key. One row per round reaches the driver; the
    nearest similarity so far is kept as a column and checkpointed every few
    rounds. Above 64 rounds ``maximin_coreset`` chooses.
    """
    if k > ROUNDS:
        rows = maximin_coreset(vectors, key=key, embedding=embedding, k=k).collect()
        return [r[key] for r in sorted(rows, key=lambda r: r["pick"])]
    norm = F.sqrt(dot(F.col(embedding), F.col(embedding)))
    unit = vectors.filter(norm > 0).select(key, F.transform(embedding, lambda x: x.cast("double") / norm).alias("_u"))
    state = unit.withColumn("_near", F.lit(-2.0))
    first = unit.orderBy(key).limit(1).collect()
    chosen = []
    point = first[0] if first else None
    while point is not None and len(chosen) < k:
        chosen.append(point[key])
        if len(chosen) == k:
            break
        at = F.array(*[F.lit(float(x)) for x in point["_u"]])
        state = state.filter(F.col(key) != point[key]).withColumn("_near", F.greatest("_near", F.round(dot(F.col("_u"), at), 9)))
        if len(chosen) % every == 0:
            state = cut_lineage(state)
        best = state.orderBy(F.asc("_near"), key).limit(1).collect()
        point = best[0] if best else None
    return chosen


#: Vectors that are spread out in one task.
PIECE_ROWS = 50_000


def maximin_coreset(vectors: DataFrame, *, key: str, embedding: str, k: int, piece_rows: int | None = None) -> DataFrame:
    """``key, pick``: k vectors far from one another (by angle), in about log(n) jobs for any k.

    Vectors are dealt by hash to pieces; a piece keeps k of its own, each the
    farthest from those before it, and what the pieces keep is dealt again
    until one piece holds it, which chooses the k in the same way. A table of
    one piece gives what ``maximin_select`` gives. Else the least angle
    between two chosen vectors is at least a sixth of the largest possible
    with one level of pieces (such selections are core-sets of factor 3, the
    last one adds a factor of 2), and a third of that for every further
    level; a level divides the rows by ``piece_rows`` / k, so there are few.
    Vectors without a length are left out.
    """
    piece_rows = max(piece_rows or PIECE_ROWS, 4 * k)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("_key"), F.col(embedding).cast("array<double>").alias("_v")).filter(dot(F.col("_v"), F.col("_v")) > 0)

    def farthest(table: pa.Table) -> pa.Table:
        keys = table.column("_key").to_pylist()
        v = np.array(table.column("_v").to_pylist())
        unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        unit, near, chosen = unit[order], np.full(len(keys), -2.0), [0]
        while len(chosen) < min(k, len(keys)):
            near = np.maximum(near, np.round(unit @ unit[chosen[-1]], 9))
            near[chosen] = 9.0
            chosen.append(int(near.argmin()))  # ties to the smaller key
        return table.take(pa.array(order[chosen])).select(["_key", "_v"]).append_column("pick", pa.array(range(1, len(chosen) + 1), pa.int32()))

    schema = f"_key {kind}, _v array<double>, pick int"
    left = rows.count()
    while left > piece_rows:
        pieces = -(-left // piece_rows)
        dealt = rows.withColumn("_piece", F.pmod(F.xxhash64("_key", F.lit(pieces)), F.lit(pieces)))
        rows = materialize(dealt.groupBy("_piece").applyInArrow(lambda t: farthest(t.drop_columns(["_piece"])), schema).drop("pick"), "core-set")
        left = rows.count()
    last = rows.withColumn("_piece", F.lit(0)).groupBy("_piece").applyInArrow(lambda t: farthest(t.drop_columns(["_piece"])), schema)
    return last.filter(F.col("pick") <= k).select(F.col("_key").alias(key), "pick")


def validate_plan(plans: DataFrame, lines: DataFrame) -> DataFrame:
    """``sample_id, failed``: names of the broken rules per plan (empty when fine).

    ``plans``: sample_id, prompt, n_products, voucher columns and
    price_after_voucher; ``lines``: sample_id, product_id, shop_id, title.
    """
    reuse = lines.groupBy("product_id").agg(F.count("*").alias("_uses"))
    per = (
        lines.join(reuse, "product_id")
        .groupBy("sample_id")
        .agg(
            F.count("*").alias("_n"),
            F.max("_uses").alias("_uses"),
            F.min("shop_id").alias("_s0"),
            F.max("shop_id").alias("_s1"),
            F.count_if(F.coalesce("title", F.lit("")) == "").alias("_untitled"),
        )
    )
    p = plans.join(per, "sample_id", "left")
    rules = [
        ("missing_prompt", F.coalesce("prompt", F.lit("")) == ""),
        ("invalid_voucher_type", ~F.coalesce(F.col("voucher_type").isin("platform", "shop"), F.lit(False))),
        ("invalid_discount_type", ~F.coalesce(F.col("discount_type").isin("fixed", "percentage"), F.lit(False))),
        ("price_exceeds_budget", F.col("price_after_voucher") > F.col("budget")),
        ("fixed_without_face_value", (F.col("discount_type") == "fixed") & F.col("face_value").isNull()),
        ("percentage_incomplete", (F.col("discount_type") == "percentage") & (F.col("discount").isNull() | F.col("cap").isNull())),
        ("product_count", ~F.col("_n").eqNullSafe(F.col("n_products").cast("bigint"))),
        ("untitled_product", F.col("_untitled") > 0),
        ("several_shops", (F.col("voucher_type") == "shop") & ~F.col("_s0").eqNullSafe(F.col("_s1"))),
        ("product_reused", F.col("_uses") > 1),
    ]
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return p.select("sample_id", failed.alias("failed"))


def validate_final(queries: DataFrame, *, text: str = "query") -> DataFrame:
    """Names of the broken rules of generated queries."""
    t = F.coalesce(F.col(text), F.lit(""))
    rules = [
        ("empty_query", F.trim(t) == ""),
        ("missing_suffix", ~(F.contains(t, F.lit("My budget is only")) & F.contains(t, F.lit("voucher with the following rules")))),
        ("no_reward", F.coalesce("n_rewards", F.lit(0)) <= 0),
    ]
    return queries.withColumn("failed", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))
